"""The streaming BPE against the tokenizers library."""

import hashlib
import json
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomfield.llm import bpe_stream as B

PATH = public_tokenizers.path(B.TOKENIZER)


@pytest.fixture(scope="module")
def both():
    return B.vocabulary_of(PATH), Tokenizer.from_file(PATH)


def ids_of(vocabulary, text, width=None):
    width = width or max(len(text), 1)
    said = b"".join(B.encode_stream(vocabulary, (text[a : a + width] for a in range(0, len(text), width))))
    return np.frombuffer(said, "<i4").tolist()


def test_every_code_point_has_the_library_s_class(both):
    v, t = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 50_000):
        text = "".join(f"a{chr(c)} 1{chr(c)}{chr(c)}" for c in points[a : a + 50_000])
        assert ids_of(v, text) == t.encode(text, add_special_tokens=False).ids


SIGNS = ["a", "b", "e", " ", "\n", "'", "s", "1", "!", "é", "ß", "日", " ", "<|endoftext|>", "<|endo", "'ll", "<|", "-", "aaaaaaaa", "  ", "\x00", "\U0001f600"]


def test_random_texts_in_any_chunks(both, monkeypatch):
    v, t = both
    rng = random.Random(13)
    words = [v.bytes[i].decode(errors="ignore") for i in range(0, 50257, 7)]
    for _ in range(400):
        kind = rng.random()
        if kind < 0.4:
            text = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(80)))
        elif kind < 0.7:
            text = "".join(rng.choice(words) for _ in range(rng.randrange(60)))
        else:
            text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.randrange(1, 26)]) for _ in range(rng.randrange(1, 9))) * rng.randrange(1, 300)
        want = t.encode(text, add_special_tokens=False).ids
        monkeypatch.setattr(B, "LONG", 1024)
        monkeypatch.setattr(B, "PART", 4096)
        assert ids_of(v, text) == want
        monkeypatch.setattr(B, "LONG", rng.choice([4, 30]))
        monkeypatch.setattr(B, "PART", rng.choice([8, 50]))
        assert ids_of(v, text, rng.randrange(1, 50)) == want


@pytest.mark.parametrize("unit", ["random letters", "words", " ", "\t", "rules", "7", "日", "e", "é"])
def test_long_pieces_are_stable_beyond_the_lookahead(both, monkeypatch, unit):
    v, t = both
    rng = random.Random(unit)
    monkeypatch.setattr(B, "LONG", 64)
    monkeypatch.setattr(B, "PART", 64)
    words = [w.decode(errors="ignore") for w in (v.bytes[i] for i in range(3000))]
    made = {
        "random letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5_000)),
        "words": lambda: "".join(rng.choice([w for w in words if w.isalpha()]) for _ in range(1500)),
        "rules": lambda: "".join(rng.choice("-=_*.") * rng.randrange(1, 140) for _ in range(80)),
    }
    text = made[unit]() if unit in made else unit * 5_432
    for end in ("", "x", "\n", " x"):
        assert ids_of(v, text + end, rng.choice([100, 999, 5000])) == t.encode(text + end, add_special_tokens=False).ids


def test_memory_stays_while_a_piece_grows(both):
    v, _ = both

    def peak(n):
        tracemalloc.start()
        for _ in B.encode_stream(v, ("abcdefghij" * 1000 for _ in range(n))):
            pass
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak(24) < 1.3 * peak(6) + 100_000


def test_decoding_any_ids_in_any_chunks(both):
    v, t = both
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else v.byte_id[rng.randrange(128, 256)] for _ in range(rng.randrange(40))]
        a, b = sorted((rng.randrange(41), rng.randrange(41)))
        assert "".join(B.decode_stream(v, [ids[:a], ids[a:b], ids[b:]])) == t.decode(ids, skip_special_tokens=False)


def test_lookahead_of_small_merge_lists():
    assert B.lookahead([]) == 1
    assert B.lookahead([("a", "b")]) == 1  # what follows b can't part it from a, and a b that isn't there yet is no change
    # b c before a b: a c on the right takes the b away from a
    assert B.lookahead([("b", "c"), ("a", "b")]) == 2
    with pytest.raises(ValueError):
        B.lookahead([("ab", "c"), ("a", "b")])


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        B.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_query_against_the_library(spark, tmp_path, both):
    _, t = both
    texts = [None, "", " ", "a <|endoftext|> b<|endoftext|>", "it's  we'll\n\n x", "x" * 30_000, " " * 70_000 + "end", "Grüße, señor 日本 👍🏽" * 50, "same", "same"]
    rows = [(1, i if i != 8 else None, x, [2]) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "text_2 int, doc_id long, text string, ids array<int>").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for _, i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, B.op13_bpe_coding(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 15496, 99_999_999])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, B.decode(rows).collect())) == [(1, ""), (2, ""), (3, "Hello")]
    assert B.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_supplied_documents(spark, both):
    _, t = both
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.n_tokens for r in B.op13_bpe_coding(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in docs.items()}
    assert json.dumps(sorted(got)) == json.dumps(sorted(docs))
