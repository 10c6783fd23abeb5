"""Job logs as streams, and the same as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINAL = ("completed", "partial", "failed")


def parse_messages(df: DataFrame, body: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of JSON messages; works on streams and tables."""
    rows = df.withColumn("_m", F.from_json(body, schema))
    ok = F.coalesce(F.array_min(F.array(*[F.col(f"_m.{c}").isNotNull() for c in required])), F.lit(False))
    return rows.filter(ok).select("_m.*"), rows.filter(~ok).drop("_m")


def skip_done(df: DataFrame, key: str, ts: str, delay: str | None = None) -> DataFrame:
    """A redelivered job counts once: within the watermark on a stream, the earliest row
    in a table."""
    if df.isStreaming:
        return df.withWatermark(ts, delay or "1 hour").dropDuplicatesWithinWatermark([key])
    nth = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    return df.withColumn("_n", nth).filter("_n = 1").drop("_n")


def job_state(events: DataFrame) -> DataFrame:
    """events (job_id, ts, action) to the state of each job: the first claim starts it,
    the first final action ends it; pending reads as processing. One aggregate, so the
    same on a table and, in update mode, on a stream."""
    at = lambda cond: F.min(F.when(cond, F.struct("ts", "action")))
    out = events.groupBy("job_id").agg(at(F.col("action") == "claim").alias("c"), at(F.col("action").isin(*FINAL)).alias("f"))
    done = F.col("c").isNotNull() & F.col("f").isNotNull()
    return out.select("job_id", F.when(done, F.col("f.action")).otherwise("processing").alias("state"), F.col("c.ts").alias("claimed"))


def batch_progress(events: DataFrame, batches: DataFrame) -> DataFrame:
    """One batch.completed row a batch whose distinct ended jobs reach its total."""
    ended = events.filter(F.col("action").isin(*FINAL)).groupBy("batch_id", "job_id").agg(F.min_by("action", "ts").alias("action"))
    n = ended.groupBy("batch_id").agg(F.count(F.lit(1)).alias("ended"), F.count_if(F.col("action") == "failed").alias("failed"))
    return batches.join(n, "batch_id").filter("ended >= total").select("batch_id", F.lit("batch.completed").alias("event"), "ended", "failed")


def batch_progress_stream(events: DataFrame) -> DataFrame:
    """batch_progress() on a stream of events (batch_id, job_id, ts, action, total: of the
    batch, null on job rows), in update mode: one aggregate whose state is the ended jobs
    of each batch, as many as the batch has. A redelivered row changes nothing; a row
    for a batch that has completed before repeats its event with the same batch_id."""
    ended = F.when(F.col("action").isin(*FINAL), F.struct("job_id", "ts", "action"))
    state = events.groupBy("batch_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_set(ended)).alias("e"))
    # in order of job and time, a job's first row is the one that counts
    once = F.filter("e", lambda x, i: (i == 0) | (F.get("e", i - 1)["job_id"] != x["job_id"]))
    failed = F.size(F.filter(once, lambda x: x["action"] == "failed")).cast("long")
    out = state.select("batch_id", F.lit("batch.completed").alias("event"), F.size(once).cast("long").alias("ended"), failed.alias("failed"), "total")
    return out.filter("ended >= total").drop("total")


def rate_windows(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(key, start, n, over) of fixed windows; on a stream with a watermark of one."""
    if requests.isStreaming:
        requests = requests.withWatermark("ts", f"{seconds} seconds")
    out = requests.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("key", F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))


def rate_verdicts(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Each request (id, key, ts): allowed, or seconds to its window's end."""
    start = (F.floor(F.unix_timestamp("ts") / seconds) * seconds).cast("long")
    rows = requests.withColumn("_s", start)
    nth = F.row_number().over(Window.partitionBy("key", "_s").orderBy("ts", "id"))
    ok = nth <= limit
    wait = F.when(~ok, F.col("_s") + seconds - F.unix_timestamp("ts"))
    return rows.select("id", "key", ok.alias("allowed"), wait.alias("retry_after"))


def failure_streaks(deliveries: DataFrame, n: int = 5, reset: int = 300) -> DataFrame:
    """(url, open_from, open_to): each run of n failures or more opens at its nth, and
    again from each later one, until reset seconds after the last; success ends a run."""
    w = Window.partitionBy("url").orderBy("ts", "id")
    rows = deliveries.withColumn("_run", F.sum(F.col("ok").cast("int")).over(w)).filter("not ok")
    nth = F.row_number().over(Window.partitionBy("url", "_run").orderBy("ts", "id"))
    late = rows.withColumn("_n", nth).filter(F.col("_n") >= n)
    out = late.groupBy("url", "_run").agg(F.min("ts").alias("open_from"), F.max("ts").alias("last"))
    return out.select("url", "open_from", (F.col("last") + F.expr(f"interval {reset} seconds")).alias("open_to"))


def retry_lineage(jobs: DataFrame, most: int = 3) -> DataFrame:
    """jobs (job_id, retried_from) to (job_id, root, attempt, latest): at most `most`
    retries make a chain, so as many joins walk it whole."""
    parent = jobs.select(F.col("job_id").alias("_p"), F.col("retried_from").alias("_pp"))
    walk = jobs.select("job_id", F.col("job_id").alias("root"), F.col("retried_from").alias("up"), F.lit(0).alias("attempt"))
    for _ in range(most):
        on = walk.join(parent, walk.up == parent["_p"], "left")
        step = F.col("_p").isNotNull()
        walk = on.select("job_id", F.when(step, F.col("_p")).otherwise(F.col("root")).alias("root"), F.when(step, F.col("_pp")).alias("up"), (F.col("attempt") + step.cast("int")).alias("attempt"))
    last = F.max("attempt").over(Window.partitionBy("root"))
    return walk.select("job_id", "root", "attempt", (F.col("attempt") == last).alias("latest"))


def rule_pack_fold(actions: DataFrame) -> DataFrame:
    """actions (scope, owner, seq, action, rules[]) to the state of each pack (rules,
    proposed, status, version); only active rules apply. A proposal waits, an approval
    makes one that waits the rules, a rejection drops it; enabling, disabling and
    rejecting count from the first proposal on. What precedes an approval is the only
    thing that needs the order; the rest are greatest sequence numbers, combined on the
    map side."""
    none = F.array().cast("array<string>")
    own = Window.partitionBy("scope", "owner").orderBy("seq")
    turns = actions.filter(F.col("action").isin("propose", "approve", "reject"))
    before = F.lag(F.struct("action", "rules")).over(own)
    turns = turns.withColumn("before", before)
    real = (F.col("action") == "approve") & (F.col("before.action") == "propose") & (F.size("before.rules") > 0)
    said = lambda c: F.max(F.when(c, F.col("seq")))
    told = turns.groupBy("scope", "owner").agg(
        F.count_if(F.col("action") == "propose").cast("int").alias("version"), F.min(F.when(F.col("action") == "propose", F.col("seq"))).alias("begun"),
        said(F.col("action") == "propose").alias("proposed_at"), said(F.coalesce(real, F.lit(False))).alias("approved_at"), said(F.col("action") == "reject").alias("rejected_at"),
        F.max(F.when(real, F.struct("seq", F.col("before.rules").alias("rules")))).alias("approved"), F.max(F.struct("seq", "action", "rules")).alias("last"),
    )
    turned = actions.filter(F.col("action").isin("enable", "disable")).groupBy("scope", "owner").agg(said(F.col("action") == "enable").alias("enabled_at"), said(F.col("action") == "disable").alias("disabled_at"))
    every = actions.select("scope", "owner").distinct().join(told, ["scope", "owner"], "left").join(turned, ["scope", "owner"], "left")
    at = lambda c: F.coalesce(F.when(F.col(c) >= F.col("begun"), F.col(c)), F.lit(-1))
    names = ("proposed_at", "approved_at", "rejected_at", "enabled_at", "disabled_at")
    latest = F.greatest(*map(at, names))
    has = F.when(at("approved_at") >= 0, "active").otherwise("none")
    status = F.when(latest < 0, "none").when(latest == at("proposed_at"), "pending").when(latest == at("approved_at"), "active").when(latest == at("disabled_at"), "disabled").otherwise(has)
    # rejected or enabled before the first approval, the pack has no rules yet
    rules = F.when(status == "active", F.coalesce(F.col("approved.rules"), none)).otherwise(none)
    proposed = F.when(F.col("last.action") == "propose", F.col("last.rules")).otherwise(none)
    return every.select("scope", "owner", rules.alias("rules"), proposed.alias("proposed"), status.alias("status"), F.coalesce("version", F.lit(0)).alias("version"))


def usage_stream(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily jobs and tokens; rows later than the watermark drop on a stream."""
    if log.isStreaming:
        log = log.withWatermark("ts", delay)
    out = log.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("jobs"), F.sum("tokens").alias("tokens"))
    return out.select(F.to_date(F.col("w.start")).alias("day"), "jobs", "tokens")


def run_available(stream: DataFrame, folder: str, mode: str = "append", key: list[str] | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over what its source has now into Parquet below folder, and reads
    it; with a key, the last row of each key. conf: settings that hold while the stream
    starts (those of its state store)."""

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/{epoch}")

    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    if key:
        w = Window.partitionBy(*key).orderBy(F.desc("_epoch"))
        out = out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return out.drop("_epoch")
