"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Counts of n-grams of one to three characters fall into hashed features. Document
frequencies cover every row that may be learned from. The classifier is fitted on a
bounded sample of those rows, SAMPLE_PER_LANG a language at most and SAMPLE_ROWS in all
(one a language at least; rows drawn by a hash of id and text, wholly repeated ones
once), by follow the regularised leader with elastic-net penalties,
and its temperature on a fifth of the sample that the fit leaves out. Every language is
learned. Only features with a weight that isn't 0 go to the tasks that predict.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .shingles import mix

BITS = 15
SAMPLE_PER_LANG, SAMPLE_ROWS = 600, 120_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.1, 1e-6, 3
UND = "und"
HELD_OUT = 2  # remainder of crc32(doc_id) by 4


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters, in all planes."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


class Grams:
    """Hashed n-gram counts of a text; letters only, what lies between is one blank."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.letter = _letters()

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(features, counts, whether there is a letter)."""
        code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        is_letter = self.letter[code]
        if not is_letter.any():
            return np.zeros(0, np.int32), np.zeros(0, np.int32), False
        code = np.concatenate(([32], np.where(is_letter, code, 32), [32])).astype(np.uint64)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        one = mix(code[keep])
        two = mix(one[:-1] * np.uint64(3) + one[1:])
        three = mix(two[:-1] * np.uint64(5) + one[2:])
        at = (np.concatenate((one, two, three)) >> np.uint64(64 - self.bits)).astype(np.int64)
        count = np.bincount(at, minlength=1 << self.bits)
        some = np.flatnonzero(count)
        return some.astype(np.int32), count[some].astype(np.int32), True


def _weights(some: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * idf[some]
    return v / (np.sqrt((v * v).sum()) or 1.0)


def _frequencies(bits: int):
    def run(batches):
        grams = Grams(bits)
        seen, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[grams.counts(t)[0]] += 1
                n += 1
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], names=["feature", "n"])

    return run


def _vectors(bits: int):
    def run(batches):
        grams = Grams(bits)
        for b in batches:
            some, count = [], []
            for t in b.column(1).to_pylist():
                x, y, _ = grams.counts(t)
                some.append(x.tobytes())
                count.append(y.tobytes())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(some, pa.binary()), pa.array(count, pa.binary())], names=["lang", "h", "features", "counts"])

    return run


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], held: list, k: int, bits: int) -> tuple[np.ndarray, float]:
    """(weights with a last row of biases, temperature) from rows (class, features,
    values). Per coordinate z and n accumulate; a weight is 0 until |z| passes L1."""
    size = (1 << bits) + 1
    z, n = np.zeros((size, k)), np.zeros((size, k))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            c, some, v = rows[i]
            at, x = np.append(some, size - 1), np.append(v, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[c] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    if not held:
        return w, 1.0
    logits = np.array([v @ w[some] + w[-1] for _, some, v in held])
    truth = np.array([c for c, _, _ in held])

    def loss(log_t):
        return -np.log(_softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth] + 1e-12).mean()

    lo, hi = -4.0, 3.0
    for _ in range(60):  # a ternary search; the loss has one valley
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return w, float(np.exp((lo + hi) / 2))


def _train(langs: list[str], idf: np.ndarray, bits: int):
    def run(table):
        rows, held = [], []
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        lang, feats, counts = (table.column(c).to_pylist() for c in ("lang", "features", "counts"))
        for i in order.tolist():
            some = np.frombuffer(feats[i], np.int32)
            row = (langs.index(lang[i]), some, _weights(some, np.frombuffer(counts[i], np.int32), idf))
            (held if i % 5 == 0 and len(order) >= 50 else rows).append(row)
        w, t = fit(rows, held, len(langs), bits)
        return pa.table({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "t": pa.array([t])})

    return run


def _predict(langs: list[str], idf: np.ndarray, w: np.ndarray, temperature: float, bits: int):
    some_weight = np.flatnonzero(np.any(w[:-1] != 0, axis=1))
    row_of = np.zeros(1 << bits, np.int32)  # row 0 is of features without a weight
    row_of[some_weight] = np.arange(1, len(some_weight) + 1)
    rows, bias, idf = np.concatenate((np.zeros_like(w[:1]), w[some_weight])), w[-1], idf.astype(np.float32)

    def run(batches):
        grams = Grams(bits)
        for b in batches:
            pred, score = [], []
            for t in b.column(1).to_pylist():
                some, count, letters = grams.counts(t) if t is not None else (None, None, False)
                if not letters or not langs:
                    pred.append(UND)
                    score.append(0.0)
                    continue
                p = _softmax((_weights(some, count, idf) @ rows[row_of[some]] + bias) / temperature)
                k = int(p.argmax())
                pred.append(langs[k])
                score.append(min(1.0, float(p[k])))
            yield pa.record_batch([b.column(0), pa.array(pred), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def language_id(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = SAMPLE_PER_LANG,
    bits: int = BITS,
    learn_id: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of rows that are not held out; lang, source and
    doc_id have no part in a prediction. Text that is null or has no letter, and any
    text where nothing could be learned: `und` with score 0. Repeated rows are rows. A null doc_id is
    not held out. No rows in, no rows out. Other columns are ignored. learn_id: the column
    that decides what is held out, where it isn't id_col.
    """
    base = common.id_text(docs, id_col, text_col, None)
    rows = docs.select(F.col(common.quoted(learn_id or id_col)).cast("long").alias("doc_id"), F.col(common.quoted(text_col)).cast("string").alias("text"), F.col(common.quoted(lang_col)).cast("string").alias("lang"))
    learn = rows.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # id and text, so that rows without an id, or under one, are drawn apart
    h = F.xxhash64("doc_id", "text", F.lit(17))
    sizes = learn.groupBy("lang").agg(F.approx_count_distinct(h, 0.03).alias("kinds")).collect()  # a row a language
    langs = sorted(r["lang"] for r in sizes)
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // max(1, len(langs))))
    idf, w, temperature = np.ones(1 << bits), np.zeros(((1 << bits) + 1, max(1, len(langs)))), 1.0
    if langs:
        seen = learn.select("text").mapInArrow(_frequencies(bits), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # a row for each feature at most
        n = {r["feature"]: r["n"] for r in seen}
        total = n.pop(-1, 0)
        for f, c in n.items():
            idf[f] = np.log((1 + total) / (1 + c)) + 1
        share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.3 * per_lang / max(1, r["kinds"])))])
        sample = learn.withColumn("h", h).filter((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")])
        sample = sample.groupBy("lang", "h").agg(F.max("text").alias("text"))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # of about 1.3 per_lang rows a language
        sample = sample.withColumn("nth", nth).filter(F.col("nth") <= per_lang).select("lang", "text", "h")
        vectors = sample.mapInArrow(_vectors(bits), "lang string, h long, features binary, counts binary")
        model = vectors.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_train(langs, idf, bits), "w binary, t double").first()
        w, temperature = np.frombuffer(model["w"], np.float32).reshape(-1, len(langs)), model["t"]
    told = base.mapInArrow(_predict(langs, idf, w, temperature, bits), "doc_id long, lang_pred string, score double")
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **kw) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised: not `und`, and with
    a score of at least `least`, which no wrong or mixed language of a closed set need
    reach. Rows that share an id, or have none, are told apart by their texts."""
    key, text = F.col(common.quoted(id_col)).cast("long"), F.col(common.quoted(text_col)).cast("string")
    # the row's own place, where an id repeats or is missing, is its text's digest
    place = F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.xxhash64(text))
    names = set(docs.columns)
    mark = next(n for n in ("__place", "__place_", "__place__") if n not in names)
    told = language_id(docs.withColumn(mark, place), mark, text_col, learn_id=id_col, **kw)
    kept = told.filter((F.col("lang_pred") != UND) & (F.col("score") >= least)).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(common.kept_in_store(kept), place == F.col("__id"), "left_semi")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(common.documents(spark, sf_dir))
