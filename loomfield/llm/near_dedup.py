"""MinHash near-dedup with fast similarity sketches.

1. Each text gets its 5-word shingle set, a 128-bit digest of the set and a sketch
   of 128 coordinates filled by rounds of hashed bins; 32 bands of 4 coordinates.
2. Equal sets collapse to the smallest doc_id by their digest (map-side combined).
3. Every member of a band bucket first meets one pivot, the smallest doc_id; pairs
   are confirmed on whole sets and linked documents contract to components. Only
   buckets that still hold several components go on. Members of small ones are dealt
   into blocks, each two blocks meet in a cell of bounded size, and only links between
   components leave it, so no pairs are listed.
4. In a large one, such as many documents about one boilerplate make, blocks would meet
   each other too often. Its members meet instead where they share one of their rarest
   shingles: two sets of similarity s share one among the rarest 1 - s of each, and
   boilerplate is not among those. That is exact, whatever the bucket's size.
5. A pair of similarity 0.75 misses all 32 bands with probability 5e-6, one of
   0.8 with 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from . import shingles as sh

WORDS, COORDS, BAND = 5, 128, 4
THRESHOLD = 75  # hundredths of intersection to union
BLOCK, CHUNK = 400, 4096  # members of a block, shingles looked at at once
LARGE = 4 * BLOCK  # members of a bucket beyond which rare shingles decide who meets
BROADCAST_IDS = 100_000  # ids (8 bytes each) up to which a semi join broadcasts

_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def _sketch(words: int, coords: int, band: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in sh.batches_of(texts):
                values, sizes = sh.shingle_sets(texts[lo:hi], words)
                n = hi - lo
                at = np.concatenate(([0], np.cumsum(sizes)))
                raw = values.tobytes()
                dig = [xxhash.xxh3_128_intdigest(raw[8 * at[i] : 8 * at[i + 1]]) for i in range(n)]
                some = np.flatnonzero(sizes)
                rows: list = [None] * n
                if len(some):
                    s = sh.sketches(values, sizes[some], coords).reshape(len(some), coords // band, band)
                    key = sh.combine_axis(s) + np.arange(coords // band, dtype=np.uint64) * sh.MIX_B
                    key = sh.mix(key).view(np.int64)
                    for k, i in enumerate(some):
                        rows[i] = key[k]
                split = lambda x: (np.array([v >> 64 for v in x], np.uint64).view(np.int64), np.array([v & (2**64 - 1) for v in x], np.uint64).view(np.int64))
                d1, d2 = split(dig)
                yield pa.record_batch(
                    [ids[lo:hi], pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2), pa.array(rows, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return run


def _confirm(words: int, threshold: int):
    """(a, b, ta, tb) to the (a, b) whose whole sets are similar enough."""

    def run(batches):
        last = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            good = np.zeros(len(a), bool)
            for lo in range(0, len(a), 256):
                hi = min(lo + 256, len(a))
                values, sizes = sh.shingle_sets(ta[lo:hi].cast(pa.binary()).to_pylist(), words)
                at = np.concatenate(([0], np.cumsum(sizes)))
                for i in range(lo, hi):
                    if last[0] != b[i]:
                        last = (b[i], sh.shingle_sets([tb[i].as_py().encode()], words)[0])
                    x, y = values[at[i - lo] : at[i - lo + 1]], last[1]
                    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
                        continue
                    hit = np.searchsorted(y, x)
                    both = int((y[np.minimum(hit, len(y) - 1)] == x).sum())
                    good[i] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), root the smallest
    id reachable, by alternating large-star and small-star rounds: each is a grouped
    minimum and a join, no neighbour list is ever gathered."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = common.kept_in_store(e)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        hung = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = common.kept_in_store(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: int = THRESHOLD,
    coords: int = COORDS,
    band: int = BAND,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that confirmed links reach, the row's own
    included; kept says whether that is the row itself. Null or empty text: no
    shingles, linked with nothing. Rows with a null doc_id are never linked and
    have a null component_id and kept true. Rows repeated under one doc_id count as
    one document with several texts, and all are kept or all go. No rows in, no
    rows out. Other columns are ignored.
    """
    base = common.id_text(docs, id_col, text_col)
    told = common.kept_in_store(base.mapInArrow(_sketch(words, coords, band), _SKETCH))
    alive = told.filter("n_shingles > 0 and doc_id is not null")
    reps = common.kept_in_store(
        alive.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    )
    buckets = reps.select(F.explode("bands").alias("bucket"), F.col("rep").alias("doc"), "size")
    shared = buckets.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.max("doc").alias("hi")).filter("pivot != hi")
    active = common.kept_in_store(buckets.join(shared.select("bucket", "pivot"), "bucket"))
    heads = active.filter("doc = pivot").select("bucket", F.col("size").alias("psize"))
    near = (100 * F.least("size", "psize") >= threshold * F.greatest("size", "psize")) & (F.col("doc") != F.col("pivot"))
    pairs = active.join(heads, "bucket").filter(near).select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    links = common.kept_in_store(_confirmed(common.kept_in_store(pairs), base, words, threshold))
    comp = components(links)
    placed = active.join(comp, F.col("doc") == F.col("node"), "left").select("bucket", "doc", F.coalesce("root", "doc").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi")
    mixed = common.kept_in_store(mixed.select("bucket", "n"))
    meet = placed.join(mixed.filter(F.col("n") <= LARGE), "bucket")
    if not mixed.filter(F.col("n") > LARGE).isEmpty():
        large = placed.join(mixed.filter(F.col("n") > LARGE), "bucket").select("doc", "comp").distinct()
        meet = meet.unionByName(_rare(common.kept_in_store(large), base, words, threshold))
    links = links.unionByName(common.kept_in_store(_met(meet, base, words, threshold)))
    same = alive.select("doc_id", "d1", "d2").join(reps.select("d1", "d2", "rep"), ["d1", "d2"])
    several = same.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).filter("b != hi")
    several = common.kept_in_store(same.join(several, "doc_id").filter("rep != b").select(F.col("rep").alias("a"), "b"))
    if not several.isEmpty():
        links = links.unionByName(several)
    comp = components(links)
    root = same.join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    root = root.groupBy("doc_id").agg(F.min("root").alias("root"))
    out = told.select("doc_id", "n_shingles").join(root, "doc_id", "left")
    own = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id").isNull() | own.eqNullSafe(F.col("doc_id"))).alias("kept"))


def _texts(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given documents: few ids go to the texts by broadcast, more by
    a shuffled join."""
    ids = common.kept_in_store(ids.distinct())
    few = ids.count() <= BROADCAST_IDS
    return common.kept_in_store(base.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))


def _confirmed(pairs: DataFrame, base: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough. A doc_id that
    repeats is met with each of its texts."""
    texts = _texts(base, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    ta = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = ta.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirm(words, threshold), "a long, b long")


def _sets(words: int):
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in sh.batches_of(texts):
                values, sizes = sh.shingle_sets(texts[lo:hi], words)
                at = np.concatenate(([0], np.cumsum(sizes))) * 8
                raw = values.tobytes()
                yield pa.record_batch([b.column(0)[lo:hi], pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "items"])

    return run


def _shingles(batches):
    """Sets to a row a shingle; t tells several texts of one document apart."""
    for b in batches:
        for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = len(raw) // 8
            if n:
                t = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                cols = [pa.array([doc] * n, pa.int64()), pa.array([t] * n, pa.int64()), pa.array([n] * n, pa.int32()), pa.array(np.frombuffer(raw, np.int64))]
                yield pa.record_batch(cols, names=["doc", "t", "size", "item"])


def _rare(docs: DataFrame, base: DataFrame, words: int, threshold: int) -> DataFrame:
    """(bucket, doc, comp, n) of docs (doc, comp): buckets by each document's rarest
    shingles, as many as its partners can't do without, that hold several components."""
    sets = _texts(base, docs.select(F.col("doc").alias("doc_id"))).mapInArrow(_sets(words), "doc_id long, items binary")
    rows = common.written(sets.mapInArrow(_shingles, "doc long, t long, size int, item long"))
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = common.joined_by_share(rows, common.kept_in_store(counts.withColumn("df", F.col("c"))), ["item"])
    own = Window.partitionBy("doc", "t")
    ranked = shared.withColumns({"nth": F.row_number().over(own.orderBy("df", "item")), "known": F.count(F.lit(1)).over(own)})
    # shingles of this document alone are the rarest of all, and meet nobody
    looked_at = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) / 100) + 1 - (F.col("size") - F.col("known"))
    prefix = ranked.filter(F.col("nth") <= looked_at).select(F.col("item").alias("bucket"), "doc").distinct()
    prefix = common.kept_in_store(prefix.join(docs, "doc"))
    mixed = prefix.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi")
    return prefix.join(mixed.select("bucket", "n"), "bucket").select("bucket", "doc", "comp", "n")


def _cell(threshold: int):
    """All members of a cell meet; a link for each two components that meet."""

    def run(table):
        doc, comp = table.column("doc").to_numpy(), table.column("comp").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        size = np.array([len(x) for x in sets])
        item, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, item, times = np.unique(item, return_inverse=True, return_counts=True)
        on = times[item] > 1
        item, owner = np.unique(item[on], return_inverse=True)[1], owner[on]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(item.max(initial=-1)) + 1, CHUNK):
            sel = (item >= at) & (item < at + CHUNK)
            m = np.zeros((len(sets), CHUNK), np.float32)
            m[owner[sel], item[sel] - at] = 1
            both += m @ m.T
        both = both.astype(np.float64)
        good = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
        good &= comp[:, None] != comp[None, :]
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(good)), strict=True):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(int(doc[i]))
                b.append(int(doc[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _met(placed: DataFrame, base: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links (a, b) between components in the buckets of placed (bucket, doc, comp, n).

    A bucket's members are dealt into blocks of about BLOCK, and each two blocks meet
    in a cell of bounded size, where whole sets are compared and only links leave.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc", "comp")
    sets = _texts(base, placed.select(F.col("doc").alias("doc_id"))).mapInArrow(_sets(words), "doc_id long, items binary")
    cells = dealt.join(sets, F.col("doc") == F.col("doc_id")).select("bucket", "i", "j", "doc", "comp", "items")
    return cells.groupBy("bucket", "i", "j").applyInArrow(_cell(threshold), "a long, b long")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs, all columns, that near_dedup keeps."""
    gone = near_dedup(docs, id_col, text_col, **kw).filter("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(common.kept_in_store(gone), F.col(common.quoted(id_col)).cast("long") == F.col("__id"), "left_anti")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.root),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id,
       coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
