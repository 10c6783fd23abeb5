"""Structural differences of JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaves(df: DataFrame, key: str, json: str, max_depth: int = 25) -> DataFrame:
    """(key, path, value, sort): one row a leaf, paths as a.b[1].c; nulls have none. Each
    document is parsed once: every level opens the containers among its rows and hands
    on the leaves. A container at max_depth is one leaf, its JSON."""
    rows = df.select(F.col(key).alias("id"), F.lit("").alias("path"), F.array().cast("array<string>").alias("sort"), F.try_parse_json(json).alias("v"))
    for _ in range(max_depth - 1):
        rows = df.sparkSession.sql(
            """SELECT id, v,
               CASE WHEN kind = 'a' THEN concat(path, '[', pos, ']') WHEN kind = 'o' AND path <> '' THEN concat(path, '.', k) WHEN kind = 'o' THEN k ELSE path END AS path,
               CASE WHEN kind = 'a' THEN array_append(sort, lpad(pos, 9, '0')) WHEN kind = 'o' THEN array_append(sort, k) ELSE sort END AS sort
               FROM (SELECT l.id, l.path, l.sort, l.kind, e.pos, e.key AS k, CASE WHEN l.kind = 'l' THEN l.v ELSE e.value END AS v
                     FROM (SELECT *, CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN 'o' WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN 'a' ELSE 'l' END AS kind FROM {rows}) l,
                     LATERAL variant_explode_outer(CASE WHEN l.kind <> 'l' THEN l.v END) e)""",
            rows=rows,
        )
    kind = F.schema_of_variant("v")
    value = F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json("v")).otherwise(F.expr("try_variant_get(v, '$', 'string')"))
    return rows.filter("v is not null and not is_variant_null(v)").select("id", "path", "sort", value.alias("value")).filter("value is not null")


def flat_leaves(df: DataFrame, key: str, json: str, fields: list[str]) -> DataFrame:
    """leaves() of objects whose fields are known and plain, without passes."""
    got = F.from_json(json, ", ".join(f"`{f}` string" for f in fields))
    rows = df.select(F.col(key).alias("id"), got.alias("j")).select("id", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"j.{f}"))])).alias("path", "value"))
    return rows.filter("value is not null").withColumn("sort", F.array("path"))


def _equal(a: Column, b: Column) -> Column:
    """Equal as text or as numbers."""
    return a.eqNullSafe(b) | F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))


def json_diff(before: DataFrame, after: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, path, before, after, sort) of two leaf tables; missing and null are alike.
    They meet in `parts` partitions, so that a task's sorts are bounded, or as Spark has it."""
    a = before.select("id", "path", F.col("value").alias("before"), F.col("sort").alias("sa"))
    b = after.select("id", "path", F.col("value").alias("after"), F.col("sort").alias("sb"))
    if parts:
        a, b = a.repartition(parts, "id", "path"), b.repartition(parts, "id", "path")
    both = a.join(b, ["id", "path"], "full")
    return both.filter(~_equal(F.col("before"), F.col("after"))).select("id", "path", "before", "after", F.coalesce("sa", "sb").alias("sort"))


def json_get_path(df: DataFrame, json: str, path: str, out: str = "value") -> DataFrame:
    return df.withColumn(out, F.try_variant_get(F.try_parse_json(json), f"$.{path}" if not path.startswith("[") else f"${path}", "string"))


def changed_flag(df: DataFrame, diffs: DataFrame, key: str, said: str = "changed") -> DataFrame:
    """The caller's flag, else whether there is a difference."""
    some = diffs.select(F.col("id").alias(key)).distinct().withColumn("_d", F.lit(True))
    return df.join(some, key, "left").withColumn(said, F.coalesce(said, "_d", F.lit(False))).drop("_d")


def payload_cap(df: DataFrame, json: str, cap: int = 350_000) -> tuple[DataFrame, DataFrame]:
    big = F.coalesce(F.octet_length(json) > cap, F.lit(False))
    return df.filter(~big), df.filter(big)


def union_tenants(feedback: DataFrame, tenant=None) -> DataFrame:
    return feedback if tenant is None else feedback.filter(F.col("tenant") == tenant)
