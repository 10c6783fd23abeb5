"""Substring dedup by a depth-limited radix sort of suffixes.

A suffix matters only through its first threshold units: 400 bytes for what is removed,
50 words for what is reported besides. Passes go from the most significant digit to the
least, and a suffix that is alone in its group after a pass leaves the sort:

1. Suffixes are reached through anchors: of all strings of half a threshold in a window
   the one with the least hash, at a place that depends on the window's content only, so
   equal windows have equal anchors. First digit: the anchor's string. Anchors whose
   string occurs once end here.
2. Second digit: the whole run of windows that one anchor serves. Runs that occur
   again whole are repeated and done, and one of them stands for all. Equal runs that
   follow each other, as padding has them, are one row with their number.
3. Where an anchor has several different runs (borders of passages, edited copies),
   one of each goes as a string to the bucket of the anchor, and their windows are
   sorted by digits of a quarter of the threshold, groups of one leaving after each.
   Groups that reach the threshold are exactly the repeated windows.

Anchors and runs that many rows share are few: they meet their rows by a broadcast of
at most common.HOT_SHARE keys, the others by a shuffle. An anchor with more different
runs than a task should hold is no bucket: the windows of its runs are grouped one by
one under a 128-bit digest, with map-side combining.
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

DEPTH, WORDS = 400, 50
HOT_ROWS = 20_000  # different runs of an anchor that are more than a task should hold

_ANCHOR = "key long, pack long, doc_id long, tid long, start int, n long"
_NO = np.iinfo(np.uint64).max
_BYTES = sh.byte_values(101)


def _gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of k units from the units' own, by doubling: 1, 2, 4 ...
    units, then two halves that overlap."""
    size = 1
    while size * 2 <= k:
        h = sh.mix((h[:-size] * sh.MIX_A) ^ h[size:])
        size *= 2
    rest = k - size
    return sh.mix((h[:-rest] * sh.MIX_B) ^ h[rest:]) if rest else h


def _least_at(h: np.ndarray, w: int) -> np.ndarray:
    """Where the (first) least of each w consecutive values is, by doubling."""
    v, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size * 2 <= w:
        left = v[:-size] <= v[size:]
        v, at = np.where(left, v[:-size], v[size:]), np.where(left, at[:-size], at[size:])
        size *= 2
    rest = w - size
    if rest:
        left = v[:-rest] <= v[rest:]
        at = np.where(left, at[:-rest], at[rest:])
    return at


def _runs(h: np.ndarray, sizes: np.ndarray, depth: int):
    """Runs of windows under one anchor, from the hashes of all units and each text's
    number of them: (text, first window in the text, first window, windows, anchor hash)."""
    if len(h) < depth:
        return None
    begin = np.cumsum(sizes) - sizes
    k = depth // 2
    h = _gram_hashes(h, k)
    for b in begin[1:].tolist():  # strings that leave their text are no anchors
        h[max(0, b - k + 1) : b] = _NO
    at = _least_at(h, depth - k + 1)
    inside = np.zeros(len(at), bool)
    for b, s in zip(begin.tolist(), sizes.tolist(), strict=True):
        inside[b : max(b, b + s - depth + 1)] = True
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[1:] |= inside[1:] != inside[:-1]
    new[begin[begin < len(at)]] = True
    edge = np.flatnonzero(new)
    n = np.diff(np.append(edge, len(at)))
    on = inside[edge]
    first, n = edge[on], n[on]
    own = np.searchsorted(begin, first, side="right") - 1
    return own, first - begin[own], first, n, h[at[first]]


class _Units:
    """Texts as bytes or as words: hashes of all units and where their strings are."""

    def __init__(self, texts: list[bytes], words: bool):
        if words:
            self.flat, self.begin, _, self.sizes = sh.word_table(texts)
            self.hashes = sh.word_hashes(np.frombuffer(self.flat, np.uint8), self.begin)
            self.end = np.append(self.begin[1:], len(self.flat)) - 1
        else:
            self.flat, self.sizes = b"".join(texts), np.array([len(t) for t in texts], np.int64)
            self.hashes = _BYTES[np.frombuffer(self.flat, np.uint8)]
            self.begin = self.end = None

    def strings(self, first: np.ndarray, n: np.ndarray):
        """One string at a time: on repetitive text they are hundreds of times the text."""
        for lo in range(0, len(first), 1 << 16):
            a, z = first[lo : lo + (1 << 16)], first[lo : lo + (1 << 16)] + n[lo : lo + (1 << 16)]
            if self.begin is not None:
                a, z = self.begin[a], self.end[z - 1]
            for x, y in zip(a.tolist(), z.tolist(), strict=True):
                yield self.flat[x:y]


def _anchors(depths: tuple):
    """A row a run; the lowest bit of its key says whether its units are words."""

    def run(batches):
        for b in batches:
            ids, texts, tid = b.column(0), b.column(1).cast(pa.binary()).to_pylist(), b.column(2)
            for lo, hi in sh.batches_of(texts, 1 << 18):
                for kind, depth in enumerate(depths):
                    units = _Units(texts[lo:hi], bool(kind))
                    found = _runs(units.hashes, units.sizes, depth)
                    if found is None or not len(found[0]):
                        continue
                    own, start, first, n, key = found
                    key = (key & ~np.uint64(1)) | np.uint64(kind)
                    pack = np.fromiter(map(xxhash.xxh3_64_intdigest, units.strings(first, n + depth - 1)), np.uint64, len(first))
                    head, n = sh.folded(own, key, pack, start, n)
                    own, key, pack, start = pa.array(own[head]), key[head], pack[head], start[head]
                    yield pa.record_batch(
                        [pa.array(key.view(np.int64)), pa.array(pack.view(np.int64)), ids[lo:hi].take(own), tid[lo:hi].take(own), pa.array(start.astype(np.int32)), pa.array(n)],
                        names=["key", "pack", "doc_id", "tid", "start", "n"],
                    )

    return run


def _strings(depths: tuple, apart: bool):
    """(doc_id, text, tid, unsettled runs) to the runs' strings, or with `apart` to the
    windows of those under hot anchors."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                wanted = [r for r in b.column(3)[i].as_py() if r["hot"] == apart]
                for kind, depth in enumerate(depths):
                    runs = [r for r in wanted if r["key"] & 1 == kind]
                    if not runs:
                        continue
                    units = _Units([b.column(1)[i].as_py().encode()], bool(kind))
                    n, start = np.array([r["n"] for r in runs]), np.array([r["start"] for r in runs])
                    if apart:
                        at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        dig = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, units.strings(at, np.full(len(at), depth)))), np.int64).reshape(-1, 2)
                        head, names = [pa.array((dig[:, 0] & ~1) | kind), pa.array(dig[:, 1])], ["w1", "w2"]
                    else:
                        at = start
                        head, names = [pa.array([r["key"] for r in runs]), pa.array(list(units.strings(start, n + depth - 1)), pa.binary())], ["key", "packed"]
                    same = [pa.array([v] * len(at), pa.int64()) for v in (b.column(0)[i].as_py(), b.column(2)[i].as_py())]
                    yield pa.record_batch([*head, *same, pa.array(at.astype(np.int32))], names=[*names, "doc_id", "tid", "start"])

    return run


def _radix(depths: tuple, most: int = 4 << 20):
    """Rows in order of anchor: windows of equal anchors sorted digit by digit."""

    def repeated(key, units, depth):
        """Which windows occur again: (row, place in its run) in order."""
        n = np.maximum(units.sizes - depth + 1, 0)
        begin = np.cumsum(units.sizes) - units.sizes
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        sizes = [depth // 4] * 3 + [depth - 3 * (depth // 4)]
        digits = {k: _gram_hashes(units.hashes, k) for k in set(sizes)}
        at, group = begin[own] + step, key.view(np.uint64)[own]
        live, shift = np.arange(len(at)), 0
        for size in sizes:
            value = digits[size][at[live] + shift]
            shift += size
            order = np.lexsort((value, group))
            value, g = value[order], group[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (value[1:] != value[:-1])
            rank = np.cumsum(new) - 1
            many = np.bincount(rank)[rank] > 1
            live, group = live[order][many], rank[many].astype(np.uint64)
            if not len(live):
                break
        hit = np.sort(live)
        return own[hit], step[hit], hit

    def judged(keys, packed, ids, tids, starts):
        for kind, depth in enumerate(depths):
            rows = [i for i, k in enumerate(keys) if k & 1 == kind]
            if not rows:
                continue
            key = np.array([keys[i] for i in rows], np.int64)
            row, step, hit = repeated(key, _Units([packed[i] for i in rows], bool(kind)), depth)
            if not len(hit):
                continue
            new = np.ones(len(hit), bool)
            new[1:] = (row[1:] != row[:-1]) | (hit[1:] != hit[:-1] + 1)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(hit)))
            src = [rows[i] for i in row[first].tolist()]
            start = np.array([starts[i] for i in src]) + step[first]
            yield pa.record_batch(
                [pa.array([kind == 1] * len(src)), pa.array([ids[i] for i in src], pa.int64()), pa.array([tids[i] for i in src], pa.int64()), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["words", "doc_id", "tid", "start", "n"],
            )

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        size = 0
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for h, c in zip(held, cols, strict=True):
                h.extend(c)
            size += sum(map(len, cols[1]))
            if size < most or held[0][0] == held[0][-1]:
                continue
            cut = int(np.searchsorted(np.array(held[0]), held[0][-1]))  # the last anchor may go on
            yield from judged(*[h[:cut] for h in held])
            held = [h[cut:] for h in held]
            size = sum(map(len, held[1]))
        if held[0]:
            yield from judged(*held)

    return run


def _cut(depths: tuple):
    """(doc_id, text, runs of repeated windows) to what is left of the bytes, and how many
    words are in repeated windows of words."""

    def merged(spans, depth):
        out: list[list[int]] = []
        for a, z in sorted((g["start"], g["start"] + g["n"] + depth - 1) for g in spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], z)
            else:
                out.append([a, z])
        return out

    def run(batches):
        for b in batches:
            ids, texts, spans = b.column(0), b.column(1).cast(pa.binary()), b.column(2)
            n_bytes, n_removed, n_spans, sha, n_words = [], [], [], [], []
            for i in range(len(ids)):
                text, found = texts[i].as_py(), spans[i].as_py() or ()
                gone = merged((g for g in found if not g["words"]), depths[0])
                kept = [text[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(text)], strict=True)]
                n_bytes.append(len(text))
                n_removed.append(sum(z - a for a, z in gone))
                n_spans.append(len(gone))
                sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
                n_words.append(sum(z - a for a, z in merged((g for g in found if g["words"]), depths[1])))
            yield pa.record_batch(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(n_words, pa.int64())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"],
            )

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    n_repeated_words.

    Every byte covered by a `depth`-byte string that starts anywhere else in the
    table goes, in all its copies; matches stay inside one row's text. n_repeated_words
    says how many words are covered by a run of `words` words that starts anywhere else;
    they are reported, not removed. Null counts as empty, with the digest of the empty
    string. Repeated rows are copies of each other and lose everything that is long
    enough. A null doc_id is a row like any other. No rows in, no rows out. Other
    columns are ignored.
    """
    depths = (depth, words)
    # tid tells rows with one doc_id and other texts apart
    base = common.id_text(docs, id_col, text_col).withColumn("tid", F.xxhash64("text"))
    anchors = common.written(base.mapInArrow(_anchors(depths), _ANCHOR))
    # c counts rows, more than c of them are runs where equal ones follow each other
    rows, more = F.count(F.lit(1)).alias("c"), F.bool_or(sh.copies("n") > 1).alias("more")
    many = common.kept_in_store(anchors.groupBy("key").agg(rows, more).filter("c > 1 or more").drop("more"))
    again = common.written(common.joined_by_share(anchors, many, ["key"]))
    first = F.min(F.struct("doc_id", "tid", "start", sh.single("n").alias("n")))
    packs = common.written(again.groupBy("key", "pack").agg(rows, more, first.alias("r")))
    twice = packs.filter("c > 1 or more").select("key", "pack", "c")
    is_words = (F.col("key").bitwiseAND(1) == 1).alias("words")
    done = common.joined_by_share(again, twice, ["key", "pack"]).select(is_words, "doc_id", "tid", "start", (sh.single("n") * sh.copies("n")).cast("int").alias("n"))

    kinds = packs.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    kinds = common.kept_in_store(kinds.select("key", (F.col("kinds") > HOT_ROWS).alias("hot")))
    some_hot = not kinds.filter("hot").isEmpty()
    one = packs.join(kinds, "key").select("key", "hot", "r.*")
    open_ = one.groupBy(F.col("doc_id").alias("d"), F.col("tid").alias("t")).agg(F.collect_list(F.struct("key", "start", "n", "hot")).alias("runs"))
    at = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t"))
    asked = base.join(open_, at).select("doc_id", "text", "tid", "runs")
    packed = asked.mapInArrow(_strings(depths, False), "key long, packed binary, doc_id long, tid long, start int")
    packed = packed.repartition("key").sortWithinPartitions("key")
    found = done.unionByName(packed.mapInArrow(_radix(depths), "words boolean, doc_id long, tid long, start int, n int"))
    if some_hot:
        apart = asked.mapInArrow(_strings(depths, True), "w1 long, w2 long, doc_id long, tid long, start int")
        both = apart.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        more = common.joined_by_share(apart, common.kept_in_store(both), ["w1", "w2"])
        found = found.unionByName(more.select((F.col("w1").bitwiseAND(1) == 1).alias("words"), "doc_id", "tid", "start", F.lit(1).alias("n")))
    by_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("tid").alias("t")).agg(F.collect_set(F.struct("words", "start", "n")).alias("spans"))
    out = base.join(by_doc, at, "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_cut(depths), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.documents(spark, sf_dir))
