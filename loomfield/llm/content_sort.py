"""Exact dedup by content sort: sampled splitters range-partition the normalised
texts, an external sort puts equal ones side by side, and neighbours are compared
whole. JVM operators only.

Texts are normalised once into a table. Every row goes through the sort. A text that a
sample shows to fill more than one range is cut into runs by a salt in the range key,
so its rows spread over as many ranges as they fill; each run is sorted and compared
like any other, and the verdicts of such a text's runs are merged by comparing the runs'
first texts whole, a row a run. The sample decides only how rows are spread, never what
is equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
PREFIX = 64  # leading characters that splitters see
RUN = ("prefix", "sha", "salt", "run")  # what names a run of a text that was cut
SAMPLE = 200_000  # rows, about, in which a text that fills several ranges shows


def normalised(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks; null counts as empty, and all
    empty texts are one group. Of a group the row with the most code points stays,
    then the smallest doc_id (null last). Of wholly repeated rows exactly one is
    kept. No rows in, no rows out. Other columns are ignored. ranges: into how many
    ranges the sort deals the rows, by default the session's shuffle partitions.
    """
    rows = common.id_text(docs, id_col, text_col).select(
        "doc_id", F.length("text").alias("ncp"), normalised(F.col("text")).alias("norm")
    )
    rows = rows.withColumns({"prefix": F.substring("norm", 1, PREFIX), "sha": F.sha2("norm", 256)})
    rows = common.written(rows)
    number = [ranges] if ranges else []
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = F.broadcast(_wide(rows, ranges))  # at most 2 * ranges rows of fixed width
    part = F.pmod(F.xxhash64("doc_id", "ncp"), F.col("spread"))
    dealt = rows.join(wide, "sha", "left").withColumn("salt", F.coalesce(part, F.lit(0)))
    # The splitters see an opening and a digest, so sampling never moves whole texts to
    # the driver and a shared opening doesn't fill one range.
    cut = dealt.repartitionByRange(*number, "prefix", "sha", "salt")
    near = Window.partitionBy("prefix", "sha", "salt")
    same = Window.partitionBy("prefix", "sha", "salt", "norm")
    order = same.orderBy(F.desc("ncp"), F.asc_nulls_last("doc_id"))
    spread = F.col("spread").isNotNull()
    judged = cut.select(
        "doc_id", "ncp", "sha", "salt", "norm", "prefix", spread.alias("cut"),
        F.first("doc_id").over(order).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        F.row_number().over(order).alias("nth"),
    )
    # firsts up to and with the row's equals: a rank, in the order that the rows are in
    firsts = F.count_if(F.col("nth") == 1).over(near.orderBy("norm"))
    judged = judged.withColumn("run", F.when(F.col("cut"), firsts))
    # of a run that was cut the first row takes the text along, for the comparison of runs
    norm = F.when(F.col("cut") & (F.col("nth") == 1), F.col("norm"))
    judged = judged.withColumns({"norm": norm, "prefix": F.when(F.col("cut"), F.col("prefix"))})
    return _merged(common.written(judged))


def _wide(rows: DataFrame, ranges: int) -> DataFrame:
    """(sha, spread) of texts with over half a range's share of a sample, and into how
    many runs to cut them: about one for each half range that they fill."""
    n = rows.count()
    sample = rows.select("sha") if n <= SAMPLE else rows.select("sha").sample(SAMPLE / n, seed=7)
    seen = sample.groupBy("sha").count()
    share = F.col("count") / F.lit(min(n, SAMPLE) or 1)
    spread = F.ceil(share * 2 * ranges).cast("int")
    return common.kept_in_store(seen.select("sha", spread.alias("spread")).filter((F.col("spread") > 1) & (F.col("count") > 1)))


def _merged(judged: DataFrame) -> DataFrame:
    """Verdicts of texts that were cut into runs come from the runs' first rows, of which
    those with the same whole text are one group."""
    same = Window.partitionBy("sha", "norm")
    top = F.first(F.struct("ncp", "doc_id")).over(same.orderBy(F.desc("ncp"), F.asc_nulls_last("doc_id")))
    heads = judged.filter("cut and nth = 1").select(*RUN, top.alias("top"), F.sum("group_size").over(same).alias("size"))
    # a row a run: at most four times as many as there are ranges
    heads = F.broadcast(heads.select(*RUN, F.col("top.doc_id").alias("top_id"), F.col("top.ncp").alias("top"), "size"))
    out = judged.drop("norm").join(heads, [*RUN], "left")
    whole = ~F.col("cut")
    won = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("ncp") == F.col("top")) & (F.col("nth") == 1)
    return out.select(
        "doc_id",
        F.when(whole, F.col("keep_id")).otherwise(F.col("top_id")).alias("keep_id"),
        F.when(whole, F.col("group_size")).otherwise(F.col("size")).alias("group_size"),
        F.when(whole, F.col("nth") == 1).otherwise(won).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps. Rows that share an id, or
    have none, are told apart by their texts."""
    told = common.kept_in_store(exact_dedup(docs, id_col, text_col))
    key = F.col(common.quoted(id_col)).cast("long")
    gone = told.filter("not kept").select(F.col("doc_id").alias("__id"))
    # ids with several rows, or none: settled row by row by the text's digest
    twice = told.groupBy(F.col("doc_id").alias("__id")).count().filter("count > 1 or __id is null").select("__id")
    twice = common.kept_in_store(twice)
    if twice.isEmpty():
        return docs.join(gone, key == F.col("__id"), "left_anti")
    text = F.coalesce(F.col(common.quoted(text_col)).cast("string"), F.lit(""))
    sha = F.sha2(normalised(text), 256)
    once = docs.join(twice, key.eqNullSafe(F.col("__id")), "left_anti").join(gone, key == F.col("__id"), "left_anti")
    kept = told.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    more = docs.join(twice, key.eqNullSafe(F.col("__id")), "left_semi").join(kept, key.eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), "left_semi")
    first = Window.partitionBy(key, sha).orderBy(F.desc(F.length(text)))
    return once.unionByName(more.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS ncp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY ncp DESC, doc_id ASC NULLS LAST)
"""
