"""Rollups over an audit log and over scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _measures() -> list[Column]:
    worked = F.when(F.col("duration_ms") != 0, F.col("duration_ms"))
    return [
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if("ocr_used").alias("ocr_jobs"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.bround(F.avg(worked)), F.lit(0.0)).alias("avg_duration_ms"),
    ]


def tenant_time_scan(log: DataFrame, tenant=None, since=None) -> DataFrame:
    """One tenant's rows (all tenants': None) from a time on; both filters reach the scan."""
    out = log if tenant is None else log.filter(F.col("tenant") == tenant)
    return out if since is None else out.filter(F.col("ts") >= F.lit(since))


def usage_totals(log: DataFrame, tenant=None, since=None) -> DataFrame:
    return tenant_time_scan(log, tenant, since).agg(*_measures())


def usage_by_day(log: DataFrame) -> DataFrame:
    return log.filter("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("jobs"), F.sum("tokens").alias("tokens"))


def usage_by_dim(log: DataFrame, dim: str) -> DataFrame:
    return log.groupBy(F.coalesce(F.col(dim), F.lit("unknown")).alias(dim)).agg(F.count(F.lit(1)).alias("jobs"))


def usage_cube(log: DataFrame, dim: str) -> DataFrame:
    """Totals, days and values of a dimension in one pass; grouping_id tells them apart."""
    rows = log.withColumns({"day": F.to_date("ts"), dim: F.coalesce(F.col(dim), F.lit("unknown"))})
    return rows.groupingSets([[], ["day"], [dim]], "day", dim).agg(F.grouping_id().alias("grouping"), *_measures())


def platform_stats(tenants: DataFrame, keys: DataFrame, log: DataFrame) -> DataFrame:
    """Per tenant, those without a log too: jobs, tokens, active keys, last active."""
    used = log.groupBy("tenant").agg(F.count(F.lit(1)).alias("jobs"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last_active"))
    active = keys.groupBy("tenant").agg(F.count_if(F.col("status") == "active").alias("active_keys"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("jobs", "tokens", "active_keys")}
    return tenants.join(used, "tenant", "left").join(active, "tenant", "left").withColumns(zero)


def latency_percentiles(log: DataFrame, by: str, ps: dict[str, float]) -> DataFrame:
    """Nearest rank round(p (n - 1)), halves to even: equal durations are counted with
    map-side combining, and only the counts are ranked."""
    counts = log.filter("duration_ms is not null").groupBy(by, "duration_ms").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    ranked = counts.select(by, "duration_ms", "c", F.sum("c").over(w.orderBy("duration_ms")).alias("upto"), F.sum("c").over(w).alias("n"))
    rank = {name: F.bround(F.lit(p) * (F.col("n") - 1)) + 1 for name, p in ps.items()}
    picks = [F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), F.col("duration_ms"))).alias(name) for name, r in rank.items()]
    rates = log.groupBy(by).agg(F.avg((F.col("status") == "completed").cast("int")).alias("success_rate"), F.avg(F.col("ocr_used").cast("int")).alias("ocr_rate"))
    return rates.join(ranked.groupBy(by).agg(*picks), by, "left")


def perf_summary(runs: DataFrame) -> DataFrame:
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration_ms)")
    return runs.agg(
        p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("duration_ms").alias("max_ms"), F.bround(F.avg("duration_ms"), 3).alias("mean_ms"),
        F.bround(F.sum("tokens") / F.count(F.lit(1)), 3).alias("tokens_per_document"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "partial").alias("partial"),
    )


def batch_status(jobs: DataFrame) -> DataFrame:
    """Per batch completed, failed, still processing, and the status they come to."""
    done, bad, n = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed"), F.count(F.lit(1))
    out = jobs.groupBy("batch_id").agg(n.alias("total"), done.alias("completed"), bad.alias("failed"))
    left = F.greatest(F.col("total") - F.col("completed") - F.col("failed"), F.lit(0))
    state = F.when(left > 0, "processing").when(F.col("failed") == 0, "completed").when(F.col("completed") == 0, "failed").otherwise("partial")
    return out.withColumns({"processing": left, "status": state})


def recent_n(log: DataFrame, as_of, days: int, n: int) -> DataFrame:
    """The newest n rows of the last days (1 to 365, at most 500 rows)."""
    days, n = min(max(days, 1), 365), min(max(n, 1), 500)
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    return log.filter(F.col("ts") >= since).orderBy(F.desc("ts"), F.desc("id")).limit(n)


def latest_by_key(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.max("ts").alias("last_active"))


def merge_scores(hits: DataFrame, by: str) -> DataFrame:
    """(by, metric, hit, miss) to rates per metric and the unweighted mean of the metrics
    that have samples, for each `by` and for all (null)."""
    rates = hits.rollup("metric", by).agg(F.sum("hit").alias("hits"), F.sum(F.col("hit") + F.col("miss")).alias("total")).filter("metric is not null")
    rates = rates.withColumn("rate", F.when(F.col("total") > 0, F.col("hits") / F.col("total")))
    overall = rates.groupBy(by).agg(F.lit("overall").alias("metric"), F.sum("hits").alias("hits"), F.sum("total").alias("total"), F.avg("rate").alias("rate"))
    return rates.unionByName(overall).withColumn("rate", F.bround("rate", 4))


def correction_counts(changes: DataFrame, owners: DataFrame, most: int) -> DataFrame:
    """(root, path) of changed fields to (owner, field, count, rank): list indices count
    as one field, an owner's most frequent first."""
    field = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    root = F.regexp_extract("path", r"^([^.\[]*)", 1)
    counts = changes.withColumns({"field": field, "root": root}).join(owners, "root").groupBy("owner", "field").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("count"), "field"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most)


def correction_examples(changes: DataFrame, cut: int = 200, per_field: int = 4, per_owner: int = 24) -> DataFrame:
    """(owner, field, ord, before, after): texts cut, then equal pairs skipped, then the
    first of each field and of each owner in order of arrival."""
    rows = changes.withColumns({"before": F.substring("before", 1, cut), "after": F.substring("after", 1, cut)}).filter("not (before <=> after)")
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    rows = rows.withColumn("k", nth("owner", "field")).filter(F.col("k") <= per_field)
    return rows.withColumn("k", nth("owner")).filter(F.col("k") <= per_owner).drop("k")


def eligible_owners(examples: DataFrame, rules: DataFrame, least: int = 5, most: int = 8, cut: int = 200) -> DataFrame:
    """Owners with enough examples and their proposed rules: trimmed, cut, once in any
    case, the first ones."""
    some = examples.groupBy("owner").count().filter(F.col("count") >= least).select("owner")
    said = F.substring(F.trim("rule"), 1, cut)
    rows = rules.join(some, "owner", "left_semi").withColumn("rule", said).filter("rule != ''")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("owner", F.lower("rule")).orderBy("pos"))).filter("nth = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy("pos"))).filter(F.col("rank") <= most).select("owner", "rank", "rule")


def score_confidence(records: DataFrame) -> DataFrame:
    """(doc_id, personal_points of 5, experience_points[], education_points[], n_skills,
    mapping[]) to six scores of two decimals."""
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(0.0)
    parts = {
        "personal": F.col("personal_points") / 5.0, "experience": mean("experience_points"), "education": mean("education_points"),
        "skills": F.least(F.col("n_skills") / 5.0, F.lit(1.0)), "mapping": mean("mapping"),
    }
    weights = {"personal": 0.30, "experience": 0.30, "education": 0.15, "skills": 0.10, "mapping": 0.15}
    two = lambda c: F.bround(c.cast("decimal(18,9)"), 2).cast("double")  # noqa: E731  halves of the decimal, not of its nearest double
    out = records.select("doc_id", *(two(v).alias(k) for k, v in parts.items()))
    total = None
    for k, w in weights.items():
        total = F.col(k) * w if total is None else total + F.col(k) * w
    return out.withColumn("overall", two(total))


def score_extraction(outputs: DataFrame, labels: DataFrame, metrics: list[str]) -> DataFrame:
    """(doc_id, metric, hit, miss): a label counts for each metric it states; a document
    without output misses them all."""
    out = outputs.select("doc_id", *(F.col(m).alias(f"o_{m}") for m in metrics))
    both = labels.join(out, "doc_id", "left")
    said = [F.struct(F.lit(m).alias("metric"), F.col(m).eqNullSafe(F.col(f"o_{m}")).alias("ok"), F.col(m).isNotNull().alias("has")) for m in metrics]
    rows = both.select("doc_id", F.explode(F.array(*said)).alias("x")).filter("x.has")
    return rows.select("doc_id", "x.metric", F.col("x.ok").cast("int").alias("hit"), (~F.col("x.ok")).cast("int").alias("miss"))


def _used(tenants: DataFrame, log: DataFrame, since=None) -> DataFrame:
    """The log rows of listed tenants, from a time on; the filter reaches the scan."""
    listed = tenants.select("tenant").dropna().distinct()
    return tenant_time_scan(log, None, since).join(listed, "tenant", "left_semi")


def platform_tenants(tenants: DataFrame, keys: DataFrame, log: DataFrame, since=None) -> DataFrame:
    """Per listed tenant (tenant, name, plan, status), those without a log too: the name
    or else the id, status or else active, jobs, tokens, active keys, last active; most
    jobs, then tokens, first. Tenants without an id drop."""
    used = tenant_time_scan(log, None, since).groupBy("tenant").agg(F.count(F.lit(1)).alias("jobs"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last_active"))
    active = keys.groupBy("tenant").agg(F.count_if(F.col("status") == "active").alias("active_keys"))
    named = {"name": F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("tenant").cast("string")), "plan": F.coalesce("plan", F.lit("")), "status": F.coalesce("status", F.lit("active"))}
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("jobs", "tokens", "active_keys")}
    out = tenants.dropna(subset=["tenant"]).withColumns(named).join(used, "tenant", "left").join(active, "tenant", "left").withColumns(zero)
    return out.orderBy(F.desc("jobs"), F.desc("tokens"), "tenant")


def platform_totals(tenants: DataFrame, keys: DataFrame, log: DataFrame, since=None) -> DataFrame:
    """One row: listed tenants and active ones, their active keys, and the measures of
    their logs from a time on."""
    n = tenants.agg(F.count(F.lit(1)).alias("tenants"), F.count_if(F.col("tenant").isNotNull() & (F.coalesce("status", F.lit("active")) == "active")).alias("active_tenants"))
    k = keys.filter(F.col("status") == "active").join(tenants.select("tenant").dropna().distinct(), "tenant", "left_semi").agg(F.count(F.lit(1)).alias("active_keys"))
    return n.join(k).join(_used(tenants, log, since).agg(*_measures()))  # three single rows


def latency_report(log: DataFrame, by: str, ps: dict[str, float], slowest: int = 5) -> DataFrame:
    """latency_percentiles() with jobs, the error mix (code, n: most frequent first) of
    rows that carry an error code, and the slowest rows (id, duration_ms), at most
    `slowest` for each value of `by`: the limit is applied before rows are shuffled."""
    base = latency_percentiles(log, by, ps)
    codes = log.filter("error_code is not null").groupBy(by, "error_code").agg(F.count(F.lit(1)).alias("n"))
    mix = codes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("error_code").alias("code"), "n"))).alias("m"))
    mix = mix.select(by, F.transform("m", lambda x: F.struct(x["code"].alias("code"), x["n"].alias("n"))).alias("errors"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("duration_ms"), "id"))
    top = log.filter("duration_ms is not null").select(by, "id", "duration_ms", nth.alias("k")).filter(F.col("k") <= slowest)
    top = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "id", "duration_ms"))).alias("t"))
    top = top.select(by, F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["duration_ms"].alias("duration_ms"))).alias("slowest"))
    jobs = log.groupBy(by).agg(F.count(F.lit(1)).alias("jobs"))
    return base.join(jobs, by).join(mix, by, "left").join(top, by, "left")


def latency_sketches(log: DataFrame, by: str) -> DataFrame:
    """(by, n, sketch): a mergeable quantile sketch (KLL) of each part's durations, to be
    stored and merged by sketch_percentiles() over any set of parts."""
    rows = log.filter("duration_ms is not null")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("duration_ms").cast("double")).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, by: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles of stored sketches merged by another key, without the rows. At the
    default size the rank of what comes out is off by at most 1.7 % of the rows, with a
    confidence of 99 %."""
    whole = sketches.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    return whole.select(by, "n", *(F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(name) for name, p in ps.items()))


def nearest_ranks(rows: DataFrame, value: str, ps: dict[str, float], error: float = 0.001) -> DataFrame:
    """One row: the number of values, and for each p the exact value at rank
    round(p (n - 1)), halves to even. A sketch brackets each rank, what lies below is
    counted, and only the values inside the brackets, some 2 x error of all, are ranked."""
    rows = rows.select(F.col(value).cast("double").alias("v")).dropna()
    cuts = [min(max(p + d * 2 * error, 0.0), 1.0) for p in ps.values() for d in (-1, 1)]
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", cuts, int(2 / error)).alias("cut")).first()
    if not told.n:
        return rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), *(F.lit(None).cast("double").alias(k) for k in ps))
    picks = []
    for i, (name, p) in enumerate(ps.items()):
        a = told.low if cuts[2 * i] == 0.0 else told.cut[2 * i]
        z = told.high if cuts[2 * i + 1] == 1.0 else told.cut[2 * i + 1]
        inside = rows.filter((F.col("v") >= a) & (F.col("v") <= z)).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        below = rows.agg(F.count_if(F.col("v") < a).alias("below"))
        upto = F.sum("c").over(Window.orderBy("v"))  # over the few distinct values of a bracket
        ranked = inside.withColumn("upto", upto).join(below).withColumn("upto", F.col("upto") + F.col("below"))
        picks.append(ranked.filter(F.col("upto") > round(p * (told.n - 1))).agg(F.min("v").alias(name)))
    out = rows.sparkSession.range(1).select(F.lit(told.n).alias("n"))
    for pick in picks:
        out = out.join(pick)
    return out


def perf_report(runs: DataFrame) -> DataFrame:
    """One row over runs (status, duration_ms, tokens, roles, partial). Latency and
    tokens are those of completed runs: nearest-rank p50 and p95, max, mean, tokens a
    document and a role; failed ones are all others, partial ones a part of the
    completed."""
    ok = F.col("status") == "completed"
    done = runs.filter(ok)
    whole = runs.agg(
        F.count_if(ok).alias("documents"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), F.count_if(ok & F.col("partial")).alias("partial"),
        F.max(F.when(ok, F.col("duration_ms"))).alias("max_ms"), F.avg(F.when(ok, F.col("duration_ms"))).alias("mean_ms"),
        F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("tokens"), F.avg(F.when(ok, F.col("tokens"))).alias("tokens_mean"),
        (F.sum(F.when(ok, F.col("tokens"))) / F.greatest(F.sum(F.when(ok, F.col("roles"))), F.lit(1))).alias("tokens_per_role"),
    )
    lat = nearest_ranks(done, "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).drop("n")
    return whole.join(lat).join(nearest_ranks(done, "tokens", {"tokens_p50": 0.5}).drop("n"))
