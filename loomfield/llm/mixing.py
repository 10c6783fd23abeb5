"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domain, language and source. A node that can't fill its
share (its capacity is its tokens times the epochs allowed) gives the shortage to its
siblings by their weights, and only what all siblings can't take goes up to the
parent's siblings. Each leaf then takes whole epochs and, of the next epoch in its own
seeded order, the documents of a token prefix. Whole numbers throughout, so the result
doesn't hang on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
#: Production parameters: share of all tokens to take, epochs at most, seed, weights
#: of nodes among their siblings (1 where none is given).
SHARE, EPOCHS, SEED = 0.5, 2, 20240
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
BROADCAST_LEAVES = 10_000
NONE = "(none)"
_BIG = "decimal(38,0)"


def source_domain(source: Column) -> Column:
    """A stand-in where documents name no domain: the number that ends the source's
    name, by 4."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number == "", NONE).otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


def _weight(level: str, weights: dict[str, int]) -> Column:
    return (F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(level)], F.lit(1)) if weights else F.lit(1)).cast("long")


def _shared(nodes: DataFrame, parent: list[str], level: str, weights: dict[str, int]) -> DataFrame:
    """Adds `budget` to nodes (parent columns, level, cap, above): the parent's budget
    `above` filled in by weight, no child over its cap."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("w", _weight(level, weights))
    n = n.withColumns({"all_w": F.sum("w").over(by), "w_before": F.coalesce(F.sum("w").over(order), F.lit(0)), "c_before": F.coalesce(F.sum("cap").over(order), F.lit(0))})
    left, free = F.col("above") - F.col("c_before"), F.col("all_w") - F.col("w_before")
    n = n.withColumn("full", F.col("cap").cast(_BIG) * free.cast("decimal(18,0)") <= left.cast(_BIG) * F.col("w").cast("decimal(18,0)"))
    n = n.withColumns({"c_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by), "w_full": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(by)})
    rest = F.expr("cast(((above - c_full) * cast(w as decimal(20,0))) div (all_w - w_full) as long)")
    return n.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(rest)).select(*nodes.columns, "budget")


def leaf_budgets(leaves: DataFrame, budget: int, weights: dict, levels: tuple = LEVELS) -> DataFrame:
    """leaves (levels..., tokens, cap) with `budget` each."""
    above: DataFrame | None = None
    for i, level in enumerate(levels):
        keys, parent = list(levels[: i + 1]), list(levels[:i])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        if above is None:
            nodes = nodes.withColumn("above", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(above.select(*parent, F.col("budget").alias("above")), parent)
        above = _shared(nodes, parent, level, weights.get(level, {})).select(*keys, "budget")
    return leaves.join(above, list(levels))


def covering_budget(leaves: DataFrame, weights: dict, levels: tuple = LEVELS) -> int:
    """The least total, in whole units of weight, at which each leaf's budget holds all
    its tokens: from the leaves up, siblings get as much for each unit of weight as the
    neediest of them needs, and none gets more than its cap."""
    nodes = leaves.select(*levels, "cap", F.col("tokens").alias("need"))
    for i in reversed(range(len(levels))):
        parent = list(levels[:i])
        nodes = nodes.withColumn("w", _weight(levels[i], weights.get(levels[i], {})))
        unit = F.max(F.expr("(need + w - 1) div w")).over(Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0)))
        nodes = nodes.withColumn("got", F.least("cap", F.col("w") * unit)).groupBy(*parent).agg(F.sum("cap").alias("cap"), F.sum("got").alias("need"))
    return nodes.first()["need"] or 0


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    share: float | None = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    weights: dict | None = None,
) -> DataFrame:
    """One row per input row: doc_id, domain, lang, source, n_tokens, leaf_budget, copies.

    Tokens are words. copies is how often the mixture takes the row: whole epochs of
    its leaf and the last one's prefix (cumulated tokens, the row's own included,
    within what is left of the leaf's budget); 0: not at all. Null lang or source are
    a node named `(none)`; null or empty text has 0 tokens and rides along where its
    place in the order is within the prefix. Without a share the total is the least one
    at which every leaf is taken whole at least once. Repeated rows are rows; of rows alike
    under one doc_id the order is arbitrary. No rows in, no rows out. Other columns
    are ignored.
    """
    weights = WEIGHTS if weights is None else weights
    col = lambda c: F.coalesce(F.col(common.quoted(c)).cast("string"), F.lit(NONE))
    n = F.coalesce(F.regexp_count(F.col(common.quoted(text_col)).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    slim = docs.select(
        F.col(common.quoted(id_col)).cast("long").alias("doc_id"),
        (source_domain(col(source_col)) if domain is None else F.coalesce(domain, F.lit(NONE))).alias("domain"),
        col(lang_col).alias("lang"), col(source_col).alias("source"), n.alias("n_tokens"),
    )
    slim = common.kept_in_store(slim)
    leaves = common.kept_in_store(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * epochs))
    total = leaves.agg(F.sum("tokens"), F.sum("cap"), F.count(F.lit(1))).first()
    wanted = covering_budget(leaves, weights) if share is None else int((total[0] or 0) * share)
    plan = leaf_budgets(leaves, min(wanted, total[1] or 0), weights)
    plan = common.kept_in_store(plan.select(*LEVELS, "tokens", "budget"))
    if total[2] <= BROADCAST_LEAVES:
        plan = F.broadcast(plan)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    rows = slim.join(plan, list(LEVELS)).withColumn("whole", whole)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "whole", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumns({"key": key, "lot": F.substring(key, 1, 3), "left": F.col("budget") - F.col("whole") * F.col("tokens")})
    # a leaf's order is cut into 4096 lots by the key's first digits, so that no leaf is summed in one task
    lots = rows.groupBy(*LEVELS, "lot").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = lots.select(*LEVELS, "lot", before.alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "lot").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("within", within).join(lots, [*LEVELS, "lot"])
    part = F.when((F.col("before") + F.col("within") <= F.col("left")) & (F.col("left") > 0), 1).otherwise(0)
    return rows.select("doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), (F.col("whole") + part).cast("long").alias("copies"))


def mixture(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs, all columns, as often as mix_sources takes them. Rows under one
    doc_id, and all rows without one, are taken as often as the one taken most."""
    key = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    taken = mix_sources(docs, id_col, **kw).groupBy(key(F.col("doc_id")).alias("__id")).agg(F.max("copies").alias("__n")).filter("__n > 0")
    out = docs.join(common.kept_in_store(taken), key(F.col(common.quoted(id_col)).cast("long")) == F.col("__id"))
    return out.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*(F.col(common.quoted(c)) for c in docs.columns))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(common.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents),
s AS (
  SELECT *, CASE WHEN regexp_extract(source, '([0-9]{1,9})$', 1) = '' THEN '(none)'
                 ELSE 'd' || (CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT) % 4) END AS domain FROM d),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS cap FROM s GROUP BY ALL),
b AS (SELECT least(CAST(floor(sum(tokens) * 0.5) AS BIGINT), CAST(sum(cap) AS BIGINT)) AS above FROM leaf),
d0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, any_value(above) AS above, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM leaf, b GROUP BY domain),
d1 AS (SELECT *, sum(w) OVER () AS all_w, coalesce(sum(w) OVER o, 0) AS w_before, coalesce(sum(cap) OVER o, 0) AS c_before FROM d0
       WINDOW o AS (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, CAST(cap AS HUGEINT) * (all_w - w_before) <= (above - c_before) * w AS full_ FROM d1),
d3 AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS c_full, sum(CASE WHEN full_ THEN w ELSE 0 END) OVER () AS w_full FROM d2),
dom AS (SELECT domain, CASE WHEN full_ THEN cap ELSE CAST(((above - c_full) * w) // (all_w - w_full) AS BIGINT) END AS budget FROM d3),
l0 AS (SELECT leaf.domain, lang, CAST(sum(cap) AS BIGINT) AS cap, any_value(budget) AS above, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w
       FROM leaf JOIN dom ON dom.domain = leaf.domain GROUP BY leaf.domain, lang),
l1 AS (SELECT *, sum(w) OVER (PARTITION BY domain) AS all_w, coalesce(sum(w) OVER o, 0) AS w_before, coalesce(sum(cap) OVER o, 0) AS c_before FROM l0
       WINDOW o AS (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, CAST(cap AS HUGEINT) * (all_w - w_before) <= (above - c_before) * w AS full_ FROM l1),
l3 AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER p AS c_full, sum(CASE WHEN full_ THEN w ELSE 0 END) OVER p AS w_full FROM l2 WINDOW p AS (PARTITION BY domain)),
lng AS (SELECT domain, lang, CASE WHEN full_ THEN cap ELSE CAST(((above - c_full) * w) // (all_w - w_full) AS BIGINT) END AS budget FROM l3),
s0 AS (SELECT leaf.*, lng.budget AS above, 1 AS w FROM leaf JOIN lng ON lng.domain = leaf.domain AND lng.lang = leaf.lang),
s1 AS (SELECT *, sum(w) OVER (PARTITION BY domain, lang) AS all_w, coalesce(sum(w) OVER o, 0) AS w_before, coalesce(sum(cap) OVER o, 0) AS c_before FROM s0
       WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, CAST(cap AS HUGEINT) * (all_w - w_before) <= (above - c_before) * w AS full_ FROM s1),
s3 AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER p AS c_full, sum(CASE WHEN full_ THEN w ELSE 0 END) OVER p AS w_full FROM s2 WINDOW p AS (PARTITION BY domain, lang)),
plan AS (SELECT domain, lang, source, tokens, CASE WHEN full_ THEN cap ELSE CAST(((above - c_full) * w) // (all_w - w_full) AS BIGINT) END AS budget FROM s3),
r AS (
  SELECT s.*, p.budget, p.tokens, CASE WHEN p.tokens > 0 THEN p.budget // p.tokens ELSE 0 END AS whole
  FROM s JOIN plan p ON p.domain = s.domain AND p.lang = s.lang AND p.source = s.source),
k AS (SELECT *, md5('20240:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, budget - whole * tokens AS left_ FROM r),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM k)
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget,
       whole + CASE WHEN cum <= left_ AND left_ > 0 THEN 1 ELSE 0 END AS copies
FROM c
"""
