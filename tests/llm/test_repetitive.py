"""Texts that repeat a few words or bytes, and rows without an id of their own."""

import random
import subprocess
import sys
import zlib

import brute
import pyarrow as pa
import pytest
from test_llm import got, plain_windows

from loomfield.llm import language, packing, suffix_sort, superkmers


def texts():
    rng = random.Random(11)
    word = lambda n: [f"v{rng.randrange(200)}" for _ in range(n)]
    unit3, unit14, unit40 = word(3), word(14), word(40)
    out = [
        "pad " * 300, "pad " * 300 + "end", "x pad " + "pad " * 120, " ".join(unit3 * 60), " ".join(["head", *unit3 * 25]),
        " ".join(unit14 * 20), " ".join(unit14[5:] + unit14 * 9), " ".join(unit40 * 6), " ".join(["z", *unit40 * 2, *word(20)]),
        " " * 900 + "a", "-" * 1300, "-=" * 500, "-" * 420 + " " + "=-" * 300, " ".join(word(30) + ["pad"] * 14 + word(30)), "o" * 401, "q" * 400,
    ]
    return [(i if i != 7 else None, t) for i, t in enumerate(out + [out[3], out[11]])]


def test_windows_of_repetitive_texts(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = plain_windows(rows)
    assert got(superkmers.substring_dedup(docs)) == want
    monkeypatch.setattr(superkmers, "HOT_ROWS", 0)
    assert got(superkmers.substring_dedup(docs)) == want


def test_suffixes_of_repetitive_texts(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted(brute.suffixes(rows), key=str)
    assert got(suffix_sort.suffix_dedup(docs)) == want
    monkeypatch.setattr(suffix_sort, "HOT_ROWS", 1)
    assert got(suffix_sort.suffix_dedup(docs)) == want


def batch(text):
    return pa.record_batch([pa.array([1]), pa.array([text]), pa.array([2])], names=["doc_id", "text", "tid"])


@pytest.mark.parametrize("unit", ["-", " ", "-= ", "a b c d e f "])
def test_padding_is_a_handful_of_rows(unit):
    text = unit * (400_000 // len(unit))
    assert sum(b.num_rows for b in suffix_sort._anchors((400, 50))([batch(text)])) < 20
    assert sum(b.num_rows for b in superkmers._run_rows(13, 4)([batch(text)])) < 20


@pytest.mark.parametrize("call", ["suffix_sort._anchors((400, 50))", "superkmers._run_rows(13, 4)"])
def test_memory_for_padding(call):
    code = f"""
import resource, sys
sys.path[:0] = ['tests/llm']
from test_repetitive import *
b = batch('w ' * 1_500_000)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in {call}([b]): pass
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout)
    assert used < 400  # MB, over 3 MB of text


def test_rows_without_ids_teach_their_language(spark):
    rng = random.Random(2)
    said = lambda part: " ".join("".join(rng.choice(part) for _ in range(3)) for _ in range(12))
    one, two, three = ["lo", "mi", "ka"], ["schr", "ung", "ver"], ["zu", "ro", "xa"]
    rows = [(i, said(one), "aa") for i in range(900)] + [(None, said(two), "bb") for _ in range(900)] + [(907, said(three), "cc") for _ in range(900)]
    assert zlib.crc32(b"907") % 4 != 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {tuple(r): n for r, n in ((r[:2], r[2]) for r in language.language_id(docs).groupBy("doc_id", "lang_pred").count().collect()) if r[0] in (None, 907)}
    assert seen.pop((None, "bb")) == 900 and seen.pop((907, "cc")) == 900 and not seen


def test_one_text_repeated_is_learned_once(spark):
    rows = [(None, "schrung verung schrver", "bb")] * 2000 + [(i, "lomika kamilo milo", "aa") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {(r.doc_id is None, r.lang_pred) for r in language.language_id(docs, per_lang=20).collect()}
    assert seen == {(True, "bb"), (False, "aa")}


def test_another_tokenizers_ids_are_its_own():
    import public_tokenizers

    some = ["Hello World, it is 2024 now", "It's 12345  o'clock\n", "Naïve İx <|endoftext|>", ""]
    for name, fits in (("byte_bpe_50k.json", False), (packing.TOKENIZER, True)):
        ids = packing.Ids(public_tokenizers.path(name))
        assert ids.known == fits and ids.of(some) == [ids.plain(t) for t in some]
