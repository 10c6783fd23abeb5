"""Reconciling several extractions of the same documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import blank_null


def rebalance_buckets(skills: DataFrame, certs: DataFrame, licenses: DataFrame, practice: list[str], known: list[str], parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, name) each: practice credentials among certifications become licenses,
    known certificates among skills certifications, and a name stays in the first of
    licenses, certifications and skills. All three are grouped together once, in `parts`
    partitions, so that a task's share is bounded, or as Spark has it."""
    frames, tags = (skills, certs, licenses), ("s", "c", "l")
    key = F.lower(F.trim(F.col("name")))

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        kind = lambda f: f.select(F.struct(*f.columns).alias("x")).schema["x"].dataType
        own = [(F.struct(*f.columns) if t == tag else F.lit(None).cast(kind(f))).alias(t) for f, t in zip(frames, tags, strict=True)]
        # what has a null in its key meets nothing in the other frames
        alone = F.when(F.col("doc_id").isNull() | key.isNull(), F.lit(tag))
        return df.select(F.col("doc_id").alias("_d"), key.alias("_k"), alone.alias("_a"), *own)

    rows = tagged(skills, "s").unionByName(tagged(certs, "c")).unionByName(tagged(licenses, "l"))
    rows = rows.repartition(parts, "_d", "_k", "_a") if parts else rows
    met = rows.groupBy("_d", "_k", "_a").agg(*(F.first(t, ignorenulls=True).alias(t) for t in tags))
    as_of = lambda t, f: F.when(F.col(t).isNotNull(), F.struct(*(F.col(f"{t}.{c}").alias(c) for c in f.columns)))
    lic = F.coalesce("l", F.when(F.col("_k").isin(practice), as_of("c", licenses)))
    cert = F.when(F.col("_l").isNull(), F.coalesce("c", F.when(F.col("_k").isin(known), as_of("s", certs))))
    met = met.withColumn("_l", lic).withColumn("_c", cert).withColumn("_s", F.when(F.col("_l").isNull() & F.col("_c").isNull(), F.col("s")))
    out = lambda c: met.filter(F.col(c).isNotNull()).select(f"{c}.*")
    return out("_s"), out("_c"), out("_l")


def repair_parents(education: DataFrame) -> DataFrame:
    """(doc_id, pos, institution, degree): a blank institution is the last one above it;
    rows without a degree go where the institution has a row with one."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = education.withColumn("institution", F.last(blank_null(F.col("institution")), ignorenulls=True).over(w))
    some = F.max(F.col("degree").isNotNull()).over(Window.partitionBy("doc_id", "institution"))
    return rows.withColumn("_s", some).filter("degree is not null or institution is null or not _s").drop("_s")


def reconcile_passes(pass_a: DataFrame, pass_b: DataFrame, bounds: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged rows, warnings): the second pass gives the rows where its count is strictly
    nearer the expected one; the other pass fills blanks only."""
    count = lambda df, n: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n))
    n = count(bounds, "n").join(count(pass_a, "na"), "doc_id", "left").join(count(pass_b, "nb"), "doc_id", "left").fillna(0, ["na", "nb"])
    n = n.withColumn("use_b", F.abs(F.col("nb") - F.col("n")) < F.abs(F.col("na") - F.col("n")))
    a = pass_a.select("doc_id", "pos", F.struct(*cols).alias("a"))
    b = pass_b.select("doc_id", "pos", F.struct(*cols).alias("b"))
    both = a.join(b, ["doc_id", "pos"], "full").join(n.select("doc_id", "use_b"), "doc_id", "left")
    use_b = F.coalesce("use_b", F.lit(False))
    both = both.filter(F.when(use_b, F.col("b").isNotNull()).otherwise(F.col("a").isNotNull()))
    pick = lambda c: F.when(use_b, F.coalesce(f"b.{c}", f"a.{c}")).otherwise(F.coalesce(f"a.{c}", f"b.{c}"))
    got = F.when(F.col("use_b"), F.col("nb")).otherwise(F.col("na"))
    warn = n.withColumn("got", got).filter("got != n")
    return both.select("doc_id", "pos", *(pick(c).alias(c) for c in cols)), warn.select("doc_id", F.concat(F.lit("expected "), "n", F.lit(" entries, found "), "got").alias("warning"))


def apply_boundary(roles: DataFrame, bounds: DataFrame, fill: list[str], clear: list[str]) -> DataFrame:
    """Blank fields from the boundary map; fields of `clear` that the map has as null are
    inherited ones and go."""
    b = bounds.select("doc_id", "pos", F.struct(*fill, *clear).alias("_b"))
    out = roles.join(b, ["doc_id", "pos"], "left")
    new = {c: F.coalesce(F.col(c), F.col(f"_b.{c}")) for c in (*fill, *clear)}
    for c in clear:
        new[c] = F.when(~(F.col("_b").isNotNull() & F.col(f"_b.{c}").isNull()), new[c])
    return out.withColumns(new).drop("_b")


def stub_missing(roles: DataFrame, bounds: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every expected row appears, missing ones as the map has them; a warning for
    documents that had none of theirs."""
    own = roles.select("doc_id", "pos", F.struct(*cols).alias("_r"))
    b = bounds.select("doc_id", "pos", F.struct(*cols).alias("_b"))
    both = own.join(b, ["doc_id", "pos"], "full").withColumn("stub", F.col("_r").isNull())
    out = both.select("doc_id", "pos", *(F.when(F.col("stub"), F.col(f"_b.{c}")).otherwise(F.col(f"_r.{c}")).alias(c) for c in cols), "stub")
    none = out.groupBy("doc_id").agg(F.min("stub").alias("all_stubs")).filter("all_stubs")
    return out, none.select("doc_id", F.lit("no entry was extracted: all come from the map").alias("warning"))


def ladder_coalesce(keys: DataFrame, a: DataFrame, b: DataFrame, floor: DataFrame, usable: Column) -> DataFrame:
    """(doc_id, record, source, partial, warning): the first usable record of a and b,
    else the floor's, which is partial."""
    pick = lambda df, n: df.filter(usable).select("doc_id", F.col("record").alias(n))
    out = keys.join(pick(a, "_a"), "doc_id", "left").join(pick(b, "_b"), "doc_id", "left").join(floor.select("doc_id", F.col("record").alias("_c")), "doc_id", "left")
    source = F.when(F.col("_a").isNotNull(), "a").when(F.col("_b").isNotNull(), "b").otherwise("floor")
    out = out.withColumns({"record": F.coalesce("_a", "_b", "_c"), "source": source}).withColumn("partial", F.col("source") == "floor")
    return out.withColumn("warning", F.when(F.col("partial"), "only the rule-based floor had a record")).drop("_a", "_b", "_c")
