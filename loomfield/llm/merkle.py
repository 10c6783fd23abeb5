"""Merkle manifest of a dataset by checkpoint and recompute.

A tree has a key (a language, say); its leaves stand in order, and every ARITY nodes in
a row become one of the next level. Only every STEP-th level is stored, as rows of one
aligned subtree each: the up to ARITY ** STEP stored nodes below one node of the next
stored level. The levels between are never kept. To extract proofs, each subtree makes
its missing levels again from the stored nodes, puts the siblings of each step on the
paths of its nodes, and lets the levels go. Paths come down from the root, a stored
level at a time, so no task sees more than one subtree and one path above it.

Places in a tree come from one range-partitioned sort and the sizes of its parts, so a
key with most of the rows is spread like any other. JVM expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ARITY, STEP = 8, 3
BLOCK = ARITY**STEP
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts written one after another."""
    return F.sha2(F.concat(*parts), 256)


def framed(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (array of left, right) come to."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["left"], node, x["right"]))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


@dataclass
class Tree:
    """levels: stored levels from the leaves up, rows (key, block, n, nodes), where nodes
    are structs (pos, node, what was carried) in order and n counts the key's nodes of
    that level. roots: (key, band, node), band being the stored level that ends the key."""

    levels: list[DataFrame]
    roots: DataFrame


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (key, ...) with pos, the place from 0 among the rows of the key in the order
    given, and n, their number. One range-partitioned sort; a part's rows of a key are
    side by side, so their places follow from how many the parts before it hold."""
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    dealt = common.written(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("key", "__part").agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__own"))
    own = Window.partitionBy("key")  # a row for each part that the key is in
    upto = F.sum("__own").over(own.orderBy("__part"))
    runs = runs.select("key", "__part", (upto - F.col("__own") - F.col("__from")).alias("__shift"), F.sum("__own").over(own).alias("n"))
    return dealt.join(runs, ["key", "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def _above(nodes: Column) -> Column:
    """The level above an array of nodes whose first one opens a run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _regenerated(level: DataFrame) -> DataFrame:
    """A stored level with the levels up to the next stored one, and how many of them
    the key still has."""
    steps = F.lit(0)
    for k in range(STEP):
        steps = steps + (F.col("n") > ARITY**k).cast("int")
    out = level.withColumns({"steps": steps, "l0": F.col("nodes.node")})
    for k in range(1, STEP + 1):
        out = out.withColumn(f"l{k}", _above(F.col(f"l{k - 1}")))
    return out


def grow(rows: DataFrame, order: list[str]) -> Tree:
    """The stored levels over rows (key, node, columns of the order, columns to carry)."""
    placed, levels, roots = _placed(rows, order), [], []
    while True:
        carried = [c for c in placed.columns if c not in ("key", "n", "pos", "node")]
        block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
        nodes = F.array_sort(F.collect_list(F.struct("pos", "node", *carried)))  # at most BLOCK
        levels.append(common.written(placed.groupBy("key", block, "n").agg(nodes.alias("nodes"))))
        made = _regenerated(levels[-1])
        top = F.coalesce(*(F.when(F.col("steps") == k, F.col(f"l{k}")[0]) for k in range(STEP + 1)))
        tops = common.written(made.select("key", F.col("block").alias("pos"), "n", top.alias("node")))
        roots.append(tops.filter(F.col("n") <= BLOCK).select("key", F.lit(len(roots)).alias("band"), "node"))
        placed = tops.filter(F.col("n") > BLOCK).withColumn("n", F.ceil(F.col("n") / BLOCK).cast("long"))
        if placed.isEmpty():
            break
    ended = roots[0]
    for more in roots[1:]:
        ended = ended.unionByName(more)
    return Tree(levels, ended)


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """(key, pos, node, what was carried, path, columns of above) for each leaf. above:
    (key, band, path, ...), a row for each key: the path from its root on, empty where
    nothing is above, and columns that all its leaves get."""
    paths = None
    for band in reversed(range(len(tree.levels))):
        top = above.filter(F.col("band") == band).drop("band").withColumn("block", F.lit(0).cast("long"))
        parents = top if paths is None else top.unionByName(paths.withColumnRenamed("pos", "block"))
        made = _regenerated(tree.levels[band]).join(parents, ["key", "block"])

        def step(k: int, i: Column) -> Column:
            at = F.shiftright(i, 3 * k)  # ARITY is 2 ** 3
            first = F.shiftleft(F.shiftright(at, 3), 3)
            nodes = F.col(f"l{k}")
            left = F.array_join(F.slice(nodes, first + 1, at - first), "")
            return F.struct(left.alias("left"), F.array_join(F.slice(nodes, at + 2, first + (ARITY - 1) - at), "").alias("right"))

        def told(x: Column, i: Column) -> Column:
            own = F.slice(F.array(*(step(k, i) for k in range(STEP))), F.lit(1), F.col("steps"))
            return F.struct(x.alias("x"), F.concat(own, F.col("path")).alias("path"))

        more = [c for c in above.columns if c not in ("key", "band", "path")]
        out = made.select("key", F.explode(F.transform("nodes", told)).alias("y"), *more)
        paths = out.select("key", *("y.x.*", "y.path"), *more)
        if band:
            # a row for BLOCK leaves; written, so that its size is known where it is joined
            paths = common.written(paths.select("key", "pos", "path", *more))
    return paths


def manifest(rows: DataFrame) -> DataFrame:
    """rows (lang, doc_id, leaf, columns to carry) to one row each: these, subroot, root
    and path, the siblings from the leaf to the root.

    Leaves of a language ascend by doc_id (null first), equal ids by leaf; languages
    ascend bytewise, null first. A repeated row is a leaf of its own. A lone leaf is its
    language's subroot, and a lone subroot the root. No rows in, no rows out.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))  # null before all
    leaves = common.written(rows.withColumnRenamed("leaf", "node").withColumn("key", key).drop("lang"))
    tree = grow(leaves, ["doc_id", "node"])
    subroots = common.written(tree.roots)
    whole = grow(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "node", F.col("band").alias("ends")), ["name"])
    root = whole.roots.first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    over = whole.roots.select("key", "band", nothing.alias("path"))
    above = proofs(whole, over).select(F.col("name").alias("key"), F.col("ends").alias("band"), "path", F.col("node").alias("subroot"))
    out = proofs(tree, common.written(above))
    lang = F.when(F.col("key") != "0", F.substring("key", 2, 2**31 - 1))
    return out.withColumns({"lang": lang, "root": F.lit(root.node if root else None).cast("string")}).withColumnRenamed("node", "leaf").drop("key", "pos")


def leaf_of(docs: DataFrame, text: Column) -> Column:
    return digest(*(framed(F.col(common.quoted(c))) for c in ("doc_id", "source", "lang", "n_chars")), framed(text))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    text = F.col("text").cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0  # null without an id: not tampered with
    changed = F.when(tampered, leaf_of(docs, F.translate(text, UPPER, LOWER)))
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(docs, text).alias("leaf"), changed.alias("changed"))
    out = manifest(rows)
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 7) -> str:
    """Level by level in SQL, as many as 8 ** levels rows of a language need."""
    crc = common.crc32_sql("CAST(doc_id AS VARCHAR)")
    put = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    head = " || ".join(put(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
    out = [f"""WITH d AS (SELECT doc_id, coalesce('1' || lang, '0') AS key, sha256({head} || {put("text")}) AS leaf,
    CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {put(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS changed FROM documents),
  a0 AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, doc_id, leaf, changed FROM d),
  t0 AS (SELECT key, pos, leaf AS node, count(*) OVER (PARTITION BY key) AS n FROM a0),
  p0 AS (SELECT key, pos AS leafpos, pos, coalesce(changed, leaf) AS node, '' AS proof, doc_id, leaf FROM a0)"""]  # fmt: skip

    def climb(t: str, p: str) -> None:
        keep = "p.* EXCLUDE (pos, node, proof)"
        for k in range(levels):
            out.append(f"""s{t}{k} AS (SELECT key, pos, n, coalesce(string_agg(node, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k} WINDOW w AS (PARTITION BY key, pos // 8 ORDER BY pos))""")
            out.append(f"""{p}{k + 1} AS (SELECT {keep}, p.pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(l || p.node || r) ELSE p.node END AS node, proof || l || r AS proof FROM {p}{k} p JOIN s{t}{k} s ON s.key = p.key AND s.pos = p.pos)""")
            out.append(f"""{t}{k + 1} AS (SELECT key, pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node, (any_value(n) + 7) // 8 AS n FROM {t}{k} GROUP BY key, pos // 8)""")

    climb("t", "p")
    out.append(f"""u0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, node, count(*) OVER () AS n, key AS name FROM t{levels}),
  q0 AS (SELECT '' AS key, u0.pos, p.node, p.proof, p.doc_id, p.leaf, u0.node AS subroot FROM p{levels} p JOIN u0 ON u0.name = p.key)""")
    climb("u", "q")
    return ",\n  ".join(out) + f"""
SELECT doc_id, leaf, subroot, x.node AS root, sha256(proof) AS proof_sha256, q.node AS folded_root, q.node = x.node AS verified FROM q{levels} q, u{levels} x"""


ORACLE_SQL = _oracle()
