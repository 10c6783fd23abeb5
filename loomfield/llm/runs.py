"""Runs of periodic words by seed and extend on diagonals.

Words q apart that are equal lie on diagonal q of a document compared with itself. A run
of period q and a length of at least max(24, 3 q) holds a stretch of such matches of at
least max(24 - q, 2 q) words. So diagonals are dealt with in classes: lags up to 16,
then (16, 32], (32, 64] and so on, and a class of lags up to k indexes the k-grams,
which every run of its lags must hold at two places q apart (k <= 2 q, and 16 <= 24 - q
for q up to 8). As k is no less than q, no such gram lies between two of its places q
apart (a word sequence that isn't a repetition is no inner part of its own square): the
pairs to look at are those of neighbouring places of a gram, at most one a word and class, and a
pair's lag is the smallest period of the stretch between. Each pair is extended both
ways along its diagonal, unless the table of how far each lag has been covered says
that an earlier extension went over it.

Grams are named exactly, not hashed: the name of a 2k-gram is the rank of the pair of
its halves' names. Only places whose gram occurs again go on to the next class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, TIMES = 24, 3  # a run has at least so many words, and periods
SEED = 16  # min over q of max(LEAST - q, (TIMES - 1) q)

_RUN = "array<struct<start:long,length:long,period:long>>"


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of names."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].reshape(-1)


def _again(at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in order, whose name occurs more than once."""
    keep = np.bincount(name)[name] > 1
    return at[keep], name[keep]


def _pairs(at: np.ndarray, name: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """(lag, place) of neighbouring places of one gram, low < lag <= high, in order; of
    pairs that follow one another on a diagonal, the first."""
    by = np.lexsort((at, name))
    here, there = at[by[:-1]], at[by[1:]]
    lag = np.where(name[by[:-1]] == name[by[1:]], there - here, 0)
    fit = (lag > low) & (lag <= high)
    lag, here = lag[fit], here[fit]
    by = np.lexsort((here, lag))
    lag, here = lag[by], here[by]
    first = np.ones(len(lag), bool)
    first[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)
    return list(zip(lag[first].tolist(), here[first].tolist(), strict=True))


def _reach(same: np.ndarray) -> int:
    """How many leading values are true."""
    i = int(same.argmin()) if len(same) else 0
    return len(same) if len(same) and same[i] else i


def _extended(ids: np.ndarray, lag: int, at: int, grown: int) -> tuple[int, int]:
    """The matching stretch [a, b) of a diagonal around a pair that matches for `grown`
    words, looked at in steps that double."""
    a, b, step, n = at, at + grown, 64, len(ids)
    while b < n - lag:
        m = min(step, n - lag - b)
        r = _reach(ids[b : b + m] == ids[b + lag : b + lag + m])
        b += r
        if r < m:
            break
        step *= 2
    step = 64
    while a > 0:
        m = min(step, a)
        r = _reach((ids[a - m : a] == ids[a - m + lag : a + lag])[::-1])
        a -= r
        if r < m:
            break
        step *= 2
    return a, b


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among the numbered words, in order of start
    and period."""
    n, found, k = len(ids), [], 1
    if n < least:
        return found
    at, name = _again(np.arange(n), ids)
    covered: dict[int, int] = {}  # how far each lag's diagonal has been extended
    low = 0
    while len(at) and times * low < n:
        if k >= SEED:
            for lag, i in _pairs(at, name, low, k):
                if i < covered.get(lag, 0):
                    continue
                a, b = _extended(ids, lag, i, k)
                covered[lag] = b
                length = b + lag - a
                if length >= max(least, times * lag):
                    found.append((a, length, lag))
            low = k
        # a gram of twice the length: the name of the place k further on is its other half
        further = np.searchsorted(at, at + k)
        both = further < len(at)
        both[both] = at[further[both]] == at[both] + k
        at, name = _again(at[both], _named(name[both], name[further[both]]))
        k *= 2
    return sorted((a, length, q) for a, length, q in found)


def numbered(words: list[bytes]) -> np.ndarray:
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for a, length, q in runs:
        edge[a + q] += 1
        edge[a + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _scan(batches):
    for b in batches:
        counts, found, left = [], [], []
        for text in b.column(1):
            words = text.as_py().encode().split()
            runs = runs_of(numbered(words)) if len(words) >= LEAST else []
            counts.append(len(words))
            found.append([{"start": a, "length": m, "period": q} for a, m, q in runs])
            if runs:
                words = [words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()]
            left.append(b" ".join(words).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period, in
    words, by start, then period), collapsed (the text without what repeats, words
    joined by one space).

    Null and empty texts have no words and no runs. Rows are judged one by one: repeated
    rows give repeated results, ids may be null. A text's index is its words as numbers;
    the work for n words is n log n and the length of the runs found. Other columns are
    ignored.
    """
    return common.id_text(docs, id_col, text_col).mapInArrow(_scan, f"doc_id long, n_words long, runs {_RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents repeat a stretch of their own words
    to the end: with h the crc32 of the id, h divisible by 10, the word i >= a becomes
    word a + (i - a) % p. A row without an id stays as it is."""
    rows = common.id_text(docs)
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.when(h % 10 == 0, words)  # null in all others
    rows = rows.select("doc_id", "text", chosen.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    said = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    put = F.array_join(F.transform("w", said), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, put).otherwise(F.col("text")).alias("text"))


def densest(runs: Column) -> Column:
    """The run with the most periods, exactly: ties go to the smallest start, then
    period, which is the order they are in."""
    more = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, x: F.when(more(best, x), x).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(common.documents(spark, sf_dir)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    out = out.withColumn("b", densest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {common.crc32_sql("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS chosen, h // 10 AS g FROM d),
  f AS (SELECT *, CASE WHEN chosen THEN g % n END AS a, CASE WHEN chosen THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
  t AS (SELECT doc_id, n, CASE WHEN chosen THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM f),
  s AS (SELECT doc_id, n, w, unnest(range(n)) AS i FROM t),
  k AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + {SEED}], ' ') AS k FROM s WHERE i + {SEED} <= n),
  m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND (y.i - x.i) * {TIMES} <= x.n),
  o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
  c AS (SELECT doc_id, q, min(i) AS start, count(*) + {SEED} - 1 + q AS length FROM o GROUP BY doc_id, q, island),
  r AS (SELECT doc_id, start, length, min(q) AS period FROM c WHERE length >= greatest({LEAST}, {TIMES} * q) GROUP BY doc_id, start, length),
  b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said,
    first(struct_pack(start, length, period) ORDER BY length::DOUBLE / period DESC, start, period) AS x FROM r GROUP BY doc_id),
  v AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS left_over FROM s
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND s.i >= r.start + r.period AND s.i < r.start + r.length) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, x.start AS start, x.length AS length, x.period AS period, 1000 * x.length // x.period AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN v USING (doc_id)
"""
