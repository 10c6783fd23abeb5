"""Periodic runs against all pairs of words."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np

from loomfield.llm import runs


def plain_runs(w):
    found = []
    for q in range(1, len(w) // 3 + 1):
        same, i = [w[i] == w[i + q] for i in range(len(w) - q)], 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(24, 3 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                found.append((i, len(s), q))
            i = j + 1
    return sorted(found)


def texts(rng, n):
    for _ in range(n):
        w, kinds = [], rng.choice([1, 2, 3, 30])
        size = rng.randrange(0, 260)
        while len(w) < size:
            if w and rng.random() < 0.4:
                p = rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40])
                w += (w[-p:] * rng.randrange(1, 8))[: rng.randrange(1, 200)]
            else:
                w += [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 20))]
        yield w[:size]


def test_every_run_of_random_texts():
    total = 0
    for w in texts(random.Random(12), 600):
        want = plain_runs(w)
        total += len(want)
        assert runs.runs_of(runs.numbered(w)) == want
    assert total > 300


def test_long_texts_take_no_longer_than_sorting_them():
    a, b = [0], [0, 1]
    while len(b) < 200_000:
        a, b = b, b + a
    began = time.time()
    assert runs.runs_of(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    assert runs.runs_of(np.arange(400_000) % 1000) == [(0, 400_000, 1000)]
    assert len(runs.runs_of(np.array(b))) > 10_000  # Fibonacci words hold runs at every scale
    assert time.time() - began < 30


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s).hexdigest()
    return (doc_id, len(found), *first, sha(b"".join(b"%d,%d,%d\n" % r for r in found)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(w)) for i, w in enumerate(texts(rng, 250))]
    rows += [(None, None), (7, None), (8, ""), (9, " \t\n"), (None, "a b " * 30), (11, rows[3][1]), (11, rows[3][1]), (12, "é ü " * 40), (13, "only one " * 24)]
    rows += [(i, "one two three four five six " * 9) for i in range(250, 300)]
    spark.createDataFrame([(1, i, t, 2) for i, t in rows], "runs int, doc_id long, text string, n int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(*r) for r in rows), key=str)


def test_no_rows(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
