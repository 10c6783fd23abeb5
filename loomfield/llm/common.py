"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)
HOT_SHARE = 1000  # a key of more than this part of the rows is wide


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_as: str | None = "") -> DataFrame:
    """Only (doc_id, text), so that no other column can clash; null text as given."""
    text = F.col(quoted(text_col)).cast("string")
    if null_as is not None:
        text = F.coalesce(text, F.lit(null_as))
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"))


def kept_in_store(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the folder that the session names in
    spark.checkpoint.dir; a folder of our own only where none is set and Spark is local
    (tests)."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        # a plan is planned under the settings that hold when its frame is made
        out = df.select("*").checkpoint(eager=True)
    _note(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: columns that repeat
    take far less room there than in a checkpoint's rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    _note(path)
    return df.sparkSession.read.parquet(path)


def _note(path: str) -> None:
    made = _made.get()
    if made is not None:
        made.append(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, the tables and checkpoints that operators wrote inside: for
    callers that write a result before they leave. What an operator returned can't be
    read after that; what was written before, or outside, stays."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run inside delete their shuffle files when they end: what has been
    written to the shared folder needs none of them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def joined_by_share(rows: DataFrame, keys: DataFrame, on: list[str], share: int = HOT_SHARE) -> DataFrame:
    """rows with the columns of keys (on..., c), a kept table whose c says how many rows
    have that key: an inner join. Keys of more than 1/share of the rows, at most `share`
    of them, meet their rows by a broadcast, and those rows are dealt by a hash of
    themselves after that, so that no task gets all rows of one key; the others are
    shuffled by key. The rows are read once."""
    total = keys.agg(F.sum("c")).first()[0] or 0
    wide, rest = keys.filter(F.col("c") > total / share).drop("c"), keys.filter(F.col("c") <= total / share).drop("c")
    if wide.isEmpty():
        return rows.join(rest, on)
    first, others = on[0], on[1:]
    more = [c for c in rest.columns if c not in on]
    hot = wide.select(*on, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__{c}") for c in more))
    met = rows.join(F.broadcast(hot), on, "left")
    key = F.when(F.col("__hot"), F.xxhash64(*rows.columns)).otherwise(F.col(first)).alias("__key")
    # what travels is as wide as the rows, but for a key that is null in all but wide ones
    met = met.select(key, F.when(F.col("__hot"), F.col(first)).alias("__own"), *(c for c in rows.columns if c != first), *(f"__{c}" for c in more))
    cold = rest.select(F.col(first).alias("__key"), *others, F.lit(True).alias("__cold"), *more)
    met = met.join(cold, ["__key", *others], "left").filter("__own is not null or __cold")
    told = [F.when(F.col("__own").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in more]
    return met.select(F.coalesce("__own", "__key").alias(first), *(c for c in rows.columns if c != first), *told)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, in DuckDB's SQL."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: {step}))"
