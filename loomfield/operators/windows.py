"""Order within documents: gaps, reversed ranges, first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flag_gaps(roles: DataFrame, months: int = 3, mode: str = "previous") -> DataFrame:
    """roles (doc_id, pos, start_m, end_m, ongoing), in months: gap_warning where a dated
    row starts over `months` after the row before it by start ended (mode running_max:
    after any row before it). An ongoing row or one without an end raises no flag."""
    w = Window.partitionBy("doc_id").orderBy("start_m", "pos")
    dated = roles.filter("start_m is not null")
    end = F.when(~F.coalesce("ongoing", F.lit(False)), F.col("end_m"))
    before = F.lag(end).over(w) if mode == "previous" else F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = dated.withColumn("gap_warning", F.coalesce(F.col("start_m") - before > months, F.lit(False)))
    return flagged.unionByName(roles.filter("start_m is null").withColumn("gap_warning", F.lit(False)))


def flag_reversed_ranges(roles: DataFrame) -> DataFrame:
    """A note for each row whose end month is before its start month."""
    bad = roles.filter("end_m < start_m")
    return bad.select("doc_id", "pos", F.concat(F.lit("experience["), "pos", F.lit("].end_date")).alias("field"), F.lit(0.9).alias("confidence"), F.lit("ends before it starts").alias("reason"))


def ordered_distinct(df: DataFrame, group: str, col: str, pos: str) -> DataFrame:
    """The first row of each value in any case, within its group."""
    nth = F.row_number().over(Window.partitionBy(group, F.lower(F.trim(col))).orderBy(pos))
    return df.withColumn("_n", nth).filter("_n = 1").drop("_n")


def budget_truncate(sections: DataFrame, per: int = 20000, total: int = 60000) -> DataFrame:
    """sections (doc_id, seq, text): each cut to `per` characters and a document to
    `total`; sections that get none go."""
    cut = sections.withColumn("text", F.substring("text", 1, per))
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(total) - F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return cut.withColumn("_left", left.cast("int")).filter("_left > 0 and length(text) > 0").withColumn("text", F.expr("substring(text, 1, _left)")).drop("_left")
