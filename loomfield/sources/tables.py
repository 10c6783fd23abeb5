"""Reading the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder; any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame, rows: int = 200_000) -> int:
    """How many partitions give a task about `rows` rows of a table, however large it is;
    no fewer than there are cores. The count comes from the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def dealt(df: DataFrame, *keys: str, rows: int = 200_000) -> DataFrame:
    """A table shuffled by its keys into parts_of() partitions, which adaptive execution
    doesn't merge: what a task holds doesn't grow with the table."""
    return df.repartition(parts_of(df, rows), *keys)
