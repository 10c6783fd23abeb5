"""The corpus operators on small and odd tables, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import content_sort, language, mixing, near_dedup, ogg, packing, pii, randomness, suffix_sort, superkmers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, group_size string"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, base = words(rng, 130), words(rng, 90)
    out = []
    for i in range(40):
        t = words(rng, rng.randrange(0, 160))
        if i % 4 == 0:
            t += "\n" + passage + "\t" + words(rng, 10)
        if i % 5 == 0:
            t = base + " " + words(rng, i % 3 * 8)
        out.append((i, t, "en" if i % 2 else "de", f"src{i % 6}"))
    again = words(rng, 40)
    out += [(50, again + " x " + again, "en", "src1"), (45, "y " + " ".join(again.split()[3:33]), "en", "src1")]
    out += [(40, None, None, None), (41, "", "en", "src1"), (42, " \t ", "en", "x"), (43, out[3][1], "en", "src1"), (44, words(rng, 6000), "en", "src2"), (None, out[4][1], "en", "src3")]
    out += [out[7], ] * 2  # a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_dedup(docs, rows):
    for ranges in (1, 4, 40):  # with 40, most groups of copies are cut into runs
        out = content_sort.exact_dedup(docs, ranges=ranges).collect()
        assert len(out) == len(rows)
        groups = Counter(re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows)
        shas = {hashlib.sha256(g.encode()).hexdigest(): n for g, n in groups.items()}
        assert all(r.group_size == shas[r.text_sha256] for r in out)
        assert Counter(r.text_sha256 for r in out if r.kept) == Counter(dict.fromkeys(shas, 1))
    kept = content_sort.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_cuts_and_merges_a_text_in_half_the_rows(spark):
    rng = random.Random(4)
    rows = [(i, "same text" + " " * rng.randrange(3)) if i % 2 else (i, words(rng, 5)) for i in range(400)]
    rows += [(None, "same text  "), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i is None, i))
    want = Counter((i, min(g)[2], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, _, i in g)
    for ranges in (1, 16):
        out = content_sort.exact_dedup(docs, ranges=ranges)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out.collect()) == want
        assert Counter(r.doc_id for r in out.collect() if r.kept) == Counter(min(g)[2] for g in groups.values())


def plain_windows(rows, w=13):
    big = 1 << 62
    first = {}
    split = [(big if i is None else i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, ws in split:
        for p in range(len(ws) - w + 1):
            k = tuple(ws[p : p + w])
            first[k] = min(first.get(k, big), i)
    out = []
    for (i, ws), r in zip(split, rows, strict=True):
        gone = set()
        for p in range(len(ws) - w + 1):
            if first[tuple(ws[p : p + w])] < i:
                gone.update(range(p, p + w))
        kept = b" ".join(x for p, x in enumerate(ws) if p not in gone)
        out.append((r[0], len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(docs, rows, monkeypatch):
    assert got(superkmers.substring_dedup(docs)) == plain_windows(rows)
    monkeypatch.setattr(superkmers, "HOT_ROWS", 0)
    assert got(superkmers.substring_dedup(docs)) == plain_windows(rows)


def test_suffix_dedup(docs, rows, monkeypatch):
    want = sorted(brute.suffixes([(r[0], r[1]) for r in rows]), key=str)
    assert got(suffix_sort.suffix_dedup(docs)) == want
    monkeypatch.setattr(suffix_sort, "HOT_ROWS", 1)
    assert got(suffix_sort.suffix_dedup(docs)) == want


def plain_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup(docs, rows):
    want = plain_components(rows)
    out = near_dedup.near_dedup(docs).collect()
    assert len(out) == len(rows)
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id) for r in out if r.doc_id is not None)
    assert near_dedup.without_near_copies(docs).columns == docs.columns


def test_near_dedup_of_one_large_bucket(spark, monkeypatch):
    """Many texts about one boilerplate, few of them linked: the rarest shingles find all."""
    rng = random.Random(30)
    boiler = words(rng, 120, 5000)
    rows = []
    for i in range(150):
        own = words(rng, rng.randrange(20, 70), 5000)
        rows.append((i, boiler + " " + own))
        if i % 10 == 0:
            rows.append((1000 + i, boiler + " " + own + " " + words(rng, rng.randrange(1, 40), 5000)))
    want = plain_components(rows)
    assert 20 < len(set(want.values())) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for large in (near_dedup.LARGE, 5):
        monkeypatch.setattr(near_dedup, "LARGE", large)
        assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()} == want


def test_ogg_round_trip_and_broken_pages(docs, rows):
    out = ogg.ogg_features(ogg.ogg_column(docs)).collect()
    assert Counter(r.n_bytes for r in out) == Counter(len((t or "").encode()) for _, t, *_ in rows)
    for n in (1, 2, 3, 64, 129, 500):
        payload = random.Random(n).randbytes(n * ogg.PACKET)
        media = ogg.write(payload)
        assert ogg.read(media)[0] == payload
        for at in (30, len(media) // 2, len(media) - 1):
            with pytest.raises(ValueError):
                ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ValueError):
            ogg.read(media[:-5])


def test_ogg_columns_against_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", "a", "\x00\x00", "\u00e9" * 288, "b" * 576, "c" * 577, words(rng, 400), "\U0001f600 " * 900, "again", "again", words(rng, 400_000)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "again")], "doc_id long, text string")
    out = {r.doc_id: r for r in ogg.ogg_features(ogg.ogg_column(docs)).collect()}
    assert len(out) == len(texts) + 1
    for i, r in out.items():
        raw = ("again" if i is None else texts[i] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-576:])
        packets = [payload[k : k + 576] for k in range(0, len(payload), 576)]
        streams = [packets[k::2] for k in range(min(2, len(packets)))]
        pages = sum(1 + -(-len(s) // 64) for s in streams)
        assert r.media_bytes == len(payload) + 3 * len(packets) + 27 * pages + 9 * len(streams)
        n = Counter(payload)
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in n.values())
        loudest = max(sum(x * x for x in p) for p in packets) // 576
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        told = dict(f.split("=") for f in r.feature.split(";"))
        assert abs(float(told.pop("entropy")) - entropy) < 0.001
        want = {"streams": len(streams), "pages": pages, "packets": len(packets), "ms": len(payload) * 1000 // 48_000, "mean": sum(payload) // len(payload), "peak": max(payload), "loudest": loudest, "crossings": crossings}
        assert told == {k: str(v) for k, v in want.items()}
    assert out[9][1:] == out[10][1:] == out[None][1:]
    # the query writes the column and reads it back
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(ogg.op3_media_columns(spark, str(tmp_path)).collect()) == Counter(out.values())


def test_ogg_query_digests_the_last_32_bytes(spark, tmp_path):
    """op3's contract: tail_crc32 is of the last 32 payload bytes."""
    texts = [None, "", "a", "b" * 543, "c" * 544, "d" * 545, "e" * 576, "f" * 577, "\u00e9" * 288, "\U0001f600 words " * 900]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in ogg.op3_media_columns(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert tuple(out[i])[:5] == want


def test_ogg_packets_that_run_over_pages():
    rng = random.Random(9)
    a, b, c = (rng.randbytes(576) for _ in range(3))
    head = ogg._page(ogg.FIRST, 0, 1, 0, b"\x08", (48_000).to_bytes(4, "little") + (576).to_bytes(4, "little"))
    one = bytes([255, 255, 66])
    first = ogg._page(0, 576, 1, 1, one + b"\xff", a + b[:255])
    middle = ogg._page(ogg.CONTINUED, -1, 1, 2, b"\xff", b[255:510])
    last = ogg._page(ogg.CONTINUED | ogg.LAST, 1728, 1, 3, b"\x42" + one, b[510:] + c)
    payload, facts = ogg.read(head + first + middle + last)
    assert payload == a + b + c and facts == {"streams": 1, "pages": 4, "packets": 3, "ms": 36}
    for broken in (head + first + last, head + first + middle, head + middle + last, first + middle + last, head + first + first + middle + last):
        with pytest.raises(ValueError):
            ogg.read(broken)
    unmarked = ogg._page(0, -1, 1, 2, b"\xff", b[255:510])
    with pytest.raises(ValueError):
        ogg.read(head + first + unmarked + last)


def test_page_checksum_is_the_formats():
    crc = 0
    data = b"OggS and more"
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    assert ogg.page_checksum(data) == crc


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b@x.org, 10.0.0.1 or 999.0.0.1", "email:5:14,ip:16:24"),
        ("mail jоhn@exаmple.com", "email:5:21"),
        ("jane [at] site [dot] org", "email:0:24"),
        ("jane at site dot org", "email:0:20"),
        ("4111 1111 1111 1111", "card:0:19"),
        ("call plus one two one two five five five oh one nine nine", "phone:5:57"),
        ("call +1 (212) 555-0199 now", "phone:5:22"),
        ("meet at noon, four five", ""),
    ],
)
def test_pii_spans(text, want):
    assert pii._join(pii.spans(text)[1]) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("jane at mail dot example dot com", "email:0:32"),
        ("ann.lee at cs.uni dot edu dot au!", "email:0:32"),
        ("jane dot doe at mail dot com", "email:0:28"),
        ("from 192 dot 168 dot 0 dot 1 on", "ip:5:28"),
        ("call +1 2l2 555 O199", "phone:5:20"),
        ("jane @ site . org", "email:0:17"),
        ("jane @site.org. Then", "email:0:14"),
        ("\U0001d423\U0001d428\U0001d421\U0001d427@\U0001d4ce.org", "email:0:10"),
        ("\uff4aane\uff20site\uff0eorg", "email:0:13"),
        ("plus one two one two double five five oh triple nine", "phone:0:52"),
        ("looked at noon. Dot came at ten.", ""),
        ("at 5 . 6 dot 7", ""),
        ("a" * 70 + " at " + "b" * 70 + " dot " * 1 + "org", "email:0:152"),
        ("x at y dot z" + " dot z" * 12, f"email:0:{12 + 72}"),
        ("one two", ""),
    ],
)
def test_pii_chains_and_forms(text, want):
    assert pii._join(pii.spans(text)[1]) == want


def test_pii_planted_disguises():
    """Each disguise over random identifiers: recall, and no span in clean text."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghkmnpqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    names = {v: k for k, v in pii.SPELLED.items() if k != "oh"}
    swap = lambda t: "".join({"a": "\u0430", "e": "\u0435", "o": "\u043e"}.get(c, c) for c in t)
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) for c in t)
    mail = [lambda a, b, c: f"{a} at {b} dot {c} dot com", lambda a, b, c: f"{a}[at]{b}(dot){c}[dot]com", lambda a, b, c: f"{a} @ {b} . {c} . com", lambda a, b, c: swap(f"{a}o@{b}.{c}.com"), lambda a, b, c: wide(f"{a}@{b}.{c}.com")]
    found = n = 0
    for i in range(500):
        x = mail[i % 5](word(), word(), word())
        found += f"email:6:{6 + len(x)}" in pii._join(pii.spans(f"Write {x}, now")[1])
        digits = "".join(rng.choice("0123456789") for _ in range(11))
        y = ["plus " + " ".join(names[d] for d in digits), "+" + wide(digits), "+" + digits[:4] + " " + digits[4:].replace("0", "O").replace("1", "l")][i % 3]
        found += f"phone:5:{5 + len(y)}" in pii._join(pii.spans(f"Call {y} now")[1])
        n += 2
    assert found >= 0.97 * n
    clean = [" ".join(rng.choice(["at", "dots", "one", "plus", "two", "word", "the", "look", "10", "3.5", "e.g.", "point", "Ol"]) for _ in range(60)) for _ in range(200)]
    assert sum(bool(pii.spans(t)[1]) for t in clean) <= 10


def test_pii_base_spans_are_the_patterns(docs, rows):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789.@+- ()ab") for _ in range(300)) for _ in range(300)] + ["4111 1111 1111 1111", "4111-1111-1111-1112"]
    for t in texts:
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.spans(t)[0] == sorted(want)


def test_pii_long_runs_are_linear():
    assert pii.spans("one " * 500_000)[0] == pii.spans("a dot " * 300_000 + "at b")[1] == pii.spans("1 " * 500_000)[0] == []
    assert len(pii.spans("a at b dot c " * 50_000)[1]) == 50_000
    assert pii.spans("a" * 300_000 + "@" + "1" * 300_000)[0] == []


def test_secrets(spark):
    texts = [(1, 'token = "abcdef123"'), (2, "AKIA" + "A1" * 8), (3, "x" + "0123456789abcdef" * 2), (4, None), (5, "key q8ZxV2mTr0Lp9Kd4Ws7Yb1Nc6Hf3Jg5Ra0Et2Uo in it"), (6, "password: token: abcdefgh")]
    out = {r.doc_id: r for r in randomness.secret_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[1].spans == "assign:0:18" and out[2].spans == "access:0:20" and out[3].spans == "hex:1:33" and out[4].spans == ""
    assert out[5].spans == "random:4:43" and out[6].n_assign == 0


def test_language_learns_and_holds_out(spark):
    rng = random.Random(2)
    part = {"aa": ["lo", "mi", "ka"], "bb": ["schr", "ung", "ver"]}
    rows = [(i, " ".join("".join(rng.choice(part[la]) for _ in range(3)) for _ in range(30)), la) for i in range(160) for la in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa"), (1001, "123 ...", "aa"), (1002, "lomika", None)]
    out = {r.doc_id: r for r in language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].lang_pred == la for i, t, la in rows[:160])
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1000].score == 0 and out[1002].lang_pred == "aa"
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(160))


def test_mixing_respects_budgets(docs, rows):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    leaves = {}
    for r in out:
        k = (r.domain, r.lang, r.source)
        used, budget = leaves.get(k, (0, r.leaf_budget))
        leaves[k] = (used + r.copies * r.n_tokens, budget)
    assert all(used <= budget for used, budget in leaves.values())
    total = sum(r.n_tokens for r in out)
    assert total * 0.5 - len(leaves) * 3 <= sum(b for _, b in leaves.values()) <= total * 0.5


def test_packing(docs, rows):
    out = packing.pack(docs, sequence=256).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for lot in by.values():
        at = 0
        for o, n in sorted(lot):
            assert o == at
            at += n
        assert at <= 256
    assert len({r.doc_id for r in out}) == len({r[0] for r in rows})
    assert len(by) <= 1.02 * sum(r.length for r in out) / 256 + 1


def test_bin_completion_finds_exact_fillings():
    bins = packing.pack_lengths(np.array([60, 50, 50, 40, 30, 30, 20, 20]), 100)
    assert len(bins) == 3 and all(sum(b) == 100 for b in bins)


def test_bin_completion_on_exact_triples():
    for n, most in ((40, 42), (100, 104), (300, 312)):
        rng, lengths = random.Random(n), []
        for _ in range(n):
            a, b = rng.randrange(1100, 1900), rng.randrange(1000, 1100)
            lengths += [a, b, 4096 - a - b]
        bins, _ = packing.complete(np.array(lengths))
        assert len(bins) <= most and sorted(x for b in bins for x in b) == sorted(lengths)


def test_token_ids_are_the_tokenizers():
    import public_tokenizers

    ids = packing.Ids(public_tokenizers.path(packing.TOKENIZER))
    texts = ["", " ", "It's 12345 o'clock, I'LL say 7\u00b2!?", "na\u00efve \u0130stanbul stra\u00dfe \u00c5\u030angstr\u00f6m", "\u041f\u0440\u0438\u0432\u0435\u0442 \u03a3\u03a3 \u4e2d\u6587\u5b57 \u0661\u0662", "a\x00b\x1c\x1fc\u00a0d\u2003e\u200bf", "<|endoftext|> <|startoftext|>x", "\U0001f600 \U00020000\U0003134f \u0378", "x" * 5000, "\r\n\t.\v\f--//"]
    rng = random.Random(6)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x180), rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x2FA20)])) for _ in range(60)) for _ in range(200)]
    assert ids.of(texts) == [ids.plain(t) for t in texts]


@pytest.mark.parametrize("run", [content_sort.exact_dedup, superkmers.substring_dedup, suffix_sort.suffix_dedup, near_dedup.near_dedup, lambda d: ogg.ogg_features(ogg.ogg_column(d)), pii.pii_spans, randomness.secret_spans, language.language_id, mixing.mix_sources, packing.pack])
def test_empty_tables(docs, run):
    assert run(docs.filter("false")).count() == 0


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline

    small = docs.filter("doc_id < 44").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, small, "")
        assert out.columns == small.columns, name
        assert out.count() > 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("user[@]example[.]com", "email:0:20"),
        ("jane at mail.site dot org", "email:0:25"),
        ("plus 1 212 555 0199", "phone:0:19"),
        ("card four one 11 one 1111 one 111 one 1 one", "card:5:43"),
        ("john@mail.exаmple.com", "email:0:12,email:0:21"),
        ("john@mail.example.com", "email:0:21"),
    ],
)
def test_pii_rules_need_no_other_disguise(text, want):
    assert pii._join(pii.spans(text)[1]) == want


def test_secrets_of_every_encoding_and_length(spark):
    rng = random.Random(7)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = ["key " + draw(randomness.HEX_DIGITS.upper(), 64), "key " + draw(randomness.BASE32.lower(), 52), "key fQxWzLrTbNvKhGsYpDmJcZa", "key internationalizationally-minded"]
    out = {r.doc_id: r.spans for r in randomness.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: "random:4:68", 1: "random:4:56", 2: "random:4:27", 3: ""}
    long = spark.createDataFrame([(randomness.BASE64 * 16_000,)], "t string")  # in the alphabet's order: only the other two tests see that
    assert long.select(randomness.battery(long.t, F.lit(randomness.BASE64)).alias("p")).first().p < 0.001


def test_battery_p_values(spark):
    """Uniform over random tokens, tiny for words and sequences, exact tails."""
    df = spark.createDataFrame([(z,) for z in (-3.0, 0.0, 1.0, 5.0, 20.0)], "z double")
    for r in df.select("z", randomness.normal_tail(df.z).alias("p")).collect():
        want = math.erfc(r.z / 2**0.5) / 2
        assert abs(r.p - want) <= 1e-6 * want
    df = spark.createDataFrame([(float(c), m) for c in (0, 1, 4, 9, 25) for m in (3.0, 12.0)], "c double, m double")
    for r in df.select("c", "m", randomness.poisson_from(df.c, df.m).alias("p")).collect():
        want = math.fsum(math.exp(-r.m) * r.m**i / math.factorial(i) for i in range(int(r.c), 120))
        assert abs(r.p - want) < 0.006 and (r.p < 3 * want + 1e-12)
    rng = random.Random(3)
    for alphabet in (randomness.HEX_DIGITS, randomness.BASE32, randomness.BASE64):
        for n in (20, 40, 400):
            df = spark.createDataFrame([("".join(rng.choice(alphabet) for _ in range(n)),) for _ in range(400)], "t string")
            p = [r.p for r in df.select(randomness.battery(df.t, F.lit(alphabet)).alias("p")).collect()]
            assert sum(x < 0.1 for x in p) < 70 and sum(x < 0.01 for x in p) < 16 and sum(x >= randomness.SURE for x in p) > 240
    df = spark.createDataFrame([("electroencephalographically" * 2,), ("abcdefghijklmnopqrstuvwxyz" * 2,), ("ab" * 30,), ("aaaaaaaaaabbbbbbbbbbccccccccccyyyyyyyyyyzzzzzzzzzz",)], "t string")
    assert all(r.p < 0.01 for r in df.select(randomness.battery(df.t, F.lit(randomness.BASE32.lower())).alias("p")).collect())


def test_secrets_recall_precision_and_size(spark):
    """Planted keys among words and paths: most keys found, nearly nothing else."""
    rng = random.Random(12)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    kinds = [randomness.HEX_DIGITS.upper(), randomness.BASE32, randomness.BASE64]
    planted = {i: draw(kinds[i % 3], rng.randrange(32, 90)) for i in range(150)}
    syllables = ["con", "ver", "tion", "al", "ment", "er", "in", "stra", "den", "lo"]
    texts = [(i, f"the key {x} is here") for i, x in planted.items()]
    texts += [(1000 + i, "see src/" + "/".join("".join(rng.choice(syllables) for _ in range(4)) for _ in range(4)) + " " + "xy" * 30) for i in range(150)]
    out = {r.doc_id: r.spans for r in randomness.secret_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = sum(f"random:8:{8 + len(x)}" in out[i] for i, x in planted.items())
    assert found >= 140 and sum(out[i] != "" for i in out if i >= 1000) <= 3
    big = [(0, draw(randomness.BASE64, 1_000_000)), (1, " ".join(draw(randomness.BASE64, 24) for _ in range(5000))), (2, None)]
    spans = {r.doc_id: r.spans for r in randomness.secret_spans(spark.createDataFrame(big, "doc_id long, text string")).collect()}
    assert spans[0] == "random:0:1000000" and spans[2] == ""
    starts = [int(x.split(":")[1]) for x in spans[1].split(",")]
    assert len(starts) > 4500 and all(x % 25 == 0 for x in starts)


def fewest(lengths, room):
    """By trying every place for every piece."""
    best = len(lengths)

    def put(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(lengths):
            best = len(left)
            return
        for k in {x: k for k, x in enumerate(left) if x >= lengths[i]}.values():
            put(i + 1, [*left[:k], left[k] - lengths[i], *left[k + 1 :]])
        put(i + 1, [*left, room - lengths[i]])

    put(0, [])
    return best


def test_bin_completion_backtracks_to_the_optimum():
    bins, proven = packing.complete(np.array([52, 51, 50, 32, 30, 28, 20, 19, 18]), 100)
    assert len(bins) == 3 and proven
    rng = random.Random(11)
    for _ in range(150):
        lengths = sorted((rng.randrange(8, 60) for _ in range(rng.randrange(1, 12))), reverse=True)
        bins, proven = packing.complete(np.array(lengths), 100)
        assert proven and len(bins) == fewest(lengths, 100)
        assert sorted((x for b in bins for x in b), reverse=True) == lengths and all(sum(b) <= 100 for b in bins)
    lengths = np.array([rng.randrange(30, 60) for _ in range(200)])
    bins, proven = packing.complete(lengths, 100, nodes=50)
    assert not proven and sorted(x for b in bins for x in b) == sorted(lengths.tolist())


def test_pipeline_mixture_keeps_and_repeats(spark):
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 80)), rng.choice(["en", "en", "de", "es", "xx"]), f"src{rng.choice([0, 0, 0, 1, 2, 3, 7])}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, "").collect())
    assert set(out) == {r[0] for r in rows} and set(out.values()) == {1, 2}
    assert all(r.copies >= 1 and r.leaf_budget > 0 for r in mixing.mix_sources(docs, share=None).collect())


def test_language_on_supplied_documents(spark):
    """Accuracy and calibration on rows that learning never sees; letters of all planes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.filter("lang is not null").select("doc_id", "lang").collect()}
    out = language.language_id(docs).collect()
    held = [(r.score, r.lang_pred == truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
    assert len(held) > 150 and sum(ok for _, ok in held) >= 0.97 * len(held)
    error = 0.0
    for i in range(10):
        lot = [(s, ok) for s, ok in held if min(int(s * 10), 9) == i]
        error += abs(sum(s for s, _ in lot) - sum(ok for _, ok in lot)) / len(held) if lot else 0
    assert error < 0.03
    grams = language.Grams()
    assert grams.counts("\U00020000\U00020001")[2] and not grams.counts("12 \U0001f600 --")[2]


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on what the one before kept, with nulls, repeats and odd rows."""
    import corpus_pipeline

    rng = random.Random(21)
    part = {"en": ["the", "and", "of", "thing", "house", "river"], "de": ["der", "und", "haus", "schnell", "fluss", "ein"]}
    rows = []
    for i in range(260):
        la = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(part[la]) + (rng.choice("abcdefgh") if rng.random() < 0.6 else "") for _ in range(rng.randrange(30, 60))), la, f"src{i % 5}", 1))
    rows += [(300, rows[4][1] + "  ", "en", "src1", 1), (301, rows[5][1], "de", "src1", 1)]  # exact copies
    rows += [(302, rows[6][1] + " tail", "en", "src1", 1), (303, "start " + rows[7][1], "de", None, 1)]  # near copies
    rows += [(304, None, "en", "src1", 1), (305, "123 456", "en", "src1", 1), (306, "", None, None, None)]  # no language
    rows += [(None, "the river and the house of the thing " * 4, "en", "src2", 1), rows[9]]  # no id, a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = spark.createDataFrame(stage(spark, kept, "").collect(), docs.schema)
        seen[name] = ids(kept)
        assert kept.columns == docs.columns
    everything = Counter(r[0] for r in rows)
    assert seen["language_id"] == everything - Counter([304, 305, 306])
    assert seen["exact_dedup"] == seen["language_id"] - Counter([4, 301, 9])  # 300 has more code points than 4
    assert seen["near_dedup"] == seen["exact_dedup"] - Counter([302, 303])
    assert set(seen["mixing"]) == set(seen["near_dedup"]) and set(seen["mixing"].values()) <= {1, 2}
    packed = corpus_pipeline.packing_stage(spark, kept, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == seen["mixing"]
    import public_tokenizers

    tok = packing.Ids(public_tokenizers.path(packing.TOKENIZER))
    text = {r[0]: r[1] for r in rows}
    for r in packed:
        raw = tok.plain(text[r.doc_id]) + (1).to_bytes(4, "little")
        assert r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) and r.length <= 4096
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), "").count() == 0, name
