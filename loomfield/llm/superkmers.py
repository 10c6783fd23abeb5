"""Substring dedup over word windows by super-k-mer partitioning.

Every window of 13 words has a minimiser, the run of 4 words with the least hash in
it, and consecutive windows with one minimiser are a super-k-mer.

1. Minimisers that occur once in the corpus are dropped by their hashes.
2. Super-k-mers that are equal whole are counted by a digest with map-side combining:
   all but those in the smallest document are repeated throughout, and those stand
   for all. Equal ones that follow each other, as text that repeats a few words has
   them, are one row with their number.
3. Where a minimiser has several different super-k-mers, those of each travel as a
   packed string to the minimiser's bucket, where windows are sorted and equal
   neighbours found by comparing their bytes.

A minimiser with more different super-k-mers than a task should hold is no bucket:
their windows go apart, each by its own 128-bit digest, with grouped minima joined
back to the windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import shingles as sh

WINDOW, GRAM = 13, 4
HOT_ROWS = 50_000  # different runs of a minimiser that are more than a task should hold

_RUN = "key long, pack long, doc_id long, tid long, start int, n long"
_COLD = "key long, packed binary, doc_id long, tid long, start int, m int"
_HOT = "w1 long, w2 long, doc_id long, tid long, start int"
_SPAN = "doc_id long, tid long, start int, n int"


def _runs(texts: list[bytes], window: int, gram: int):
    """Super-k-mers of whole texts: (flat bytes, word starts and ends, text of the run,
    first word in the text, first word overall, windows, minimiser)."""
    flat, starts, doc, counts = sh.word_table(texts)
    ends = np.append(starts[1:], len(flat)) - 1
    n = len(starts) - window + 1
    if n <= 0:
        return None
    g = sh.combine(sh.word_hashes(np.frombuffer(flat, np.uint8), starts), gram)
    least, best = g[:n].copy(), np.arange(n)
    for j in range(1, window - gram + 1):  # the first of equal ones
        less = g[j : j + n] < least
        np.copyto(least, g[j : j + n], where=less)
        best[less] = np.flatnonzero(less) + j
    inside = doc[:n] == doc[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (best[1:] != best[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return None
    # a run ends before the next one or the next window that leaves its text
    stops = np.flatnonzero(new | ~inside)
    after = np.searchsorted(stops, first, side="right")
    last = np.where(after < len(stops), stops[np.minimum(after, len(stops) - 1)], n)
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return flat, starts, ends, doc[first], first - begin[doc[first]], first, last - first, g[best[first]].view(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray):
    for lo in range(0, len(a), 1 << 16):
        yield from zip(a[lo : lo + (1 << 16)].tolist(), b[lo : lo + (1 << 16)].tolist(), strict=True)


def _run_keys(window: int, gram: int):
    """Only the minimisers of the super-k-mers, for the first count."""

    def run(batches):
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in sh.batches_of(texts):
                found = _runs(texts[lo:hi], window, gram)
                if found is not None:
                    own, key = found[3], found[-1]
                    # one for those that follow each other in a text: that is one document
                    new = np.ones(len(key), bool)
                    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
                    yield pa.record_batch([pa.array(key[new])], names=["key"])

    return run


def _run_rows(window: int, gram: int):
    """A row a super-k-mer: its minimiser, a digest of its words, and its place."""

    def run(batches):
        for b in batches:
            ids, texts, tid = b.column(0), b.column(1).cast(pa.binary()).to_pylist(), b.column(2)
            for lo, hi in sh.batches_of(texts):
                found = _runs(texts[lo:hi], window, gram)
                if found is None:
                    continue
                flat, starts, ends, own, start, first, n, key = found
                at, to = starts[first], ends[first + n + window - 2]
                pack = np.fromiter((xxhash.xxh3_64_intdigest(flat[x:y]) for x, y in _pairs(at, to)), np.uint64, len(at))
                head, n = sh.folded(own, key, pack, start, n)
                own = pa.array(own[head])
                yield pa.record_batch(
                    [pa.array(key[head]), pa.array(pack[head].view(np.int64)), ids[lo:hi].take(own), tid[lo:hi].take(own), pa.array(start[head].astype(np.int32)), pa.array(n)],
                    names=["key", "pack", "doc_id", "tid", "start", "n"],
                )

    return run


def _strings(window: int, apart: bool):
    """(doc_id, text, tid, runs) to the runs as packed strings, or with `apart` to the
    windows of those under hot minimisers."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                runs = [r for r in b.column(3)[i].as_py() if r["hot"] == apart]
                if not runs:
                    continue
                words = b.column(1)[i].as_py().encode().split()
                doc, tid = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                if apart:
                    at = [p for r in runs for p in range(r["start"], r["start"] + r["n"] * r["m"])]
                    dig = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(words[p : p + window])) for p in at), np.int64).reshape(-1, 2)
                    head, names = [pa.array(dig[:, 0]), pa.array(dig[:, 1])], ["w1", "w2"]
                else:
                    at = [r["start"] for r in runs]
                    packed = [b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1]) for r in runs]
                    head, names = [pa.array([r["key"] for r in runs]), pa.array(packed, pa.binary())], ["key", "packed"]
                tail = [pa.array([doc] * len(at), pa.int64()), pa.array([tid] * len(at), pa.int64()), pa.array(at, pa.int32())]
                if not apart:
                    tail.append(pa.array([r["m"] for r in runs], pa.int32()))
                    names.append("m")
                yield pa.record_batch(head + tail, names=[*names[:2], "doc_id", "tid", "start", *names[2:]])

    return run


_LAST = np.iinfo(np.int64).max


def _bucket(window: int, most: int = 8 << 20):
    """Rows in order of (key, packed): the windows that also start in a smaller document.
    Equal strings, which all are of one document by now, are held and judged once, with
    the places they have."""

    def judged(rows):
        keys, packed, ids, places = rows
        key = np.array(keys, np.int64)
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        on = np.flatnonzero(~alone)
        if not len(on):
            return None
        texts = [packed[i] for i in on]
        flat, begin, own, counts = sh.word_table(texts)
        ends = np.append(begin[1:], len(flat)) - 1
        h = sh.combine(sh.word_hashes(np.frombuffer(flat, np.uint8), begin), window)
        at = np.flatnonzero(own[: len(h)] == own[window - 1 :])
        value = h[at]
        doc = np.array([ids[i] for i in on], np.int64)[own[at]]
        order = np.lexsort((doc, value))
        at, value, doc = at[order], value[order], doc[order]
        same = np.zeros(len(value), bool)
        same[1:] = value[1:] == value[:-1]
        # equal hashes are candidates; windows count as equal when their bytes are
        hit, lead, least = [], None, None
        for i in np.flatnonzero(same).tolist():
            text = flat[begin[at[i]] : ends[at[i] + window - 1]]
            if not same[i - 1]:
                lead, least = {flat[begin[at[i - 1]] : ends[at[i - 1] + window - 1]]: doc[i - 1]}, None
            least = lead.setdefault(text, doc[i])
            if least < doc[i]:
                hit.append(i)
        if not hit:
            return None
        at = np.sort(at[hit])
        row = own[at]
        offset = at - (np.cumsum(counts) - counts)[row]
        source = on[row]
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        out: list[list[int]] = [[], [], [], []]
        for r, i, shift, size in zip(row[first].tolist(), source[first].tolist(), offset[first].tolist(), n.tolist(), strict=True):
            unit = int(counts[r]) - window + 1
            for tid, start, m in places[i]:
                whole = size == unit  # then equal runs that follow each other are one span
                for k in range(1 if whole else m):
                    for column, v in zip(out, (ids[i], tid, start + k * unit + shift, size * m if whole else size), strict=True):
                        column.append(v)
        return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["doc_id", "tid", "start", "n"])

    def run(batches):
        held: list[list] = [[], [], [], []]
        size = 0
        for b in batches:
            keys, packed, ids, places = held
            for key, text, doc, *place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if keys and key == keys[-1] and text == packed[-1] and doc == ids[-1]:
                    places[-1].append(place)
                    continue
                keys.append(key)
                packed.append(text)
                ids.append(doc)
                places.append([place])
                size += len(text)
            if not keys or size < most or held[0][0] == held[0][-1]:
                continue
            cut = int(np.searchsorted(np.array(held[0]), held[0][-1]))  # the last key may go on
            out = judged([h[:cut] for h in held])
            held = [h[cut:] for h in held]
            size = sum(map(len, held[1]))
            if out is not None:
                yield out
        if held[0]:
            out = judged(held)
            if out is not None:
                yield out

    return run


def _trim(batches):
    """(doc_id, text, spans of removed windows) to the kept words and counts."""
    window = WINDOW
    for b in batches:
        ids, texts, spans = b.column(0), b.column(1).cast(pa.binary()), b.column(2)
        n_words, n_removed, sha = [], [], []
        for i in range(len(ids)):
            words = texts[i].as_py().split()
            gone = spans[i].as_py()
            kept = words
            if gone:
                mark = np.zeros(len(words) + 1, np.int64)
                for s in gone:
                    mark[s["start"]] += 1
                    mark[min(s["start"] + s["n"] + window - 1, len(words))] -= 1
                on = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
                kept = [words[j] for j in on.tolist()]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.record_batch([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, tid, start, n): runs of n windows from word `start` of a document that
    also start in a document with a smaller doc_id; tid is a digest of its text.

    A null doc_id comes after all others and is returned as the largest long. Windows
    that repeat in one document only, or in rows under one doc_id, don't count.
    """
    base = _base(docs, id_col, text_col)
    runs = base.select("place", "text", "tid").mapInArrow(_run_rows(window, gram), _RUN)
    keys = base.select("text").mapInArrow(_run_keys(window, gram), "key long")
    many = common.kept_in_store(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    again = common.written(common.joined_by_share(runs, many, ["key"]))
    packs = common.kept_in_store(again.groupBy("key", "pack").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")))
    placed = common.joined_by_share(again, packs, ["key", "pack"])
    done = placed.filter("doc_id > least").select("doc_id", "tid", "start", (sh.single("n") * sh.copies("n")).cast("int").alias("n"))

    kinds = packs.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    kinds = common.kept_in_store(kinds.select("key", (F.col("kinds") > HOT_ROWS).alias("hot")))
    # not an equality, which would become a join key and shuffle the runs once more
    one = placed.filter("doc_id <= least").join(kinds, "key")
    run = F.struct("key", "start", sh.single("n").alias("n"), sh.copies("n").cast("int").alias("m"), "hot")
    open_ = one.groupBy(F.col("doc_id").alias("place"), "tid").agg(F.collect_list(run).alias("runs"))
    # doc_id goes along unused: with it, this is the shuffle of texts that the trimming makes
    asked = base.join(open_, ["place", "tid"]).select("place", "text", "tid", "runs", "doc_id")
    cold = asked.mapInArrow(_strings(window, False), _COLD).repartition("key").sortWithinPartitions("key", "packed")
    found = done.unionByName(cold.mapInArrow(_bucket(window), _SPAN))
    if not kinds.filter("hot").isEmpty():
        apart = asked.mapInArrow(_strings(window, True), _HOT)
        least = apart.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("c")).filter("least < most")
        more = common.joined_by_share(apart, common.kept_in_store(least.drop("most")), ["w1", "w2"]).filter("doc_id > least")
        found = found.unionByName(more.select("doc_id", "tid", "start", F.lit(1).alias("n")))
    return found


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Words covered by a 13-word window that also starts in a document with a smaller
    doc_id go. Null and empty texts have no words and the digest of the empty
    string. Rows repeated under one doc_id are judged each by its own text, against
    smaller ids only. No rows in, no rows out. Other columns are ignored.
    """
    spans = repeated_windows(docs, id_col, text_col)
    by_doc = spans.groupBy(F.col("doc_id").alias("place"), "tid").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    base = _base(docs, id_col, text_col)
    return base.join(by_doc, ["place", "tid"], "left").select("doc_id", "text", "spans").mapInArrow(_trim, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, a digest of the text, and the place among the documents: doc_id,
    or the largest long for null, so that joins need no null-safe key."""
    return common.id_text(docs, id_col, text_col).withColumns({"tid": F.xxhash64("text"), "place": F.coalesce("doc_id", F.lit(_LAST))})


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13),
s AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM k),
f AS (SELECT win, min(doc_id) AS first_doc FROM s GROUP BY win),
r AS (
  SELECT DISTINCT s.doc_id, unnest(range(s.p, s.p + 13)) AS p
  FROM s JOIN f ON f.win = s.win AND f.first_doc < s.doc_id),
g AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(len(g.ps), 0) AS n_removed,
       sha256(coalesce(array_to_string(
         CASE WHEN g.ps IS NULL THEN w.ws
              ELSE list_transform(list_filter(list_zip(w.ws, range(1, len(w.ws) + 1)), lambda x: NOT list_contains(g.ps, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
