"""Rollup, window, JSON and scoring operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield.operators import jsondiff as J
from loomfield.operators import rollup as G
from loomfield.operators import windows as W
from loomfield.sources.tables import dealt, parts_of, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def log(s, d):
    """The events as an audit log."""
    kind = F.col("event_type")
    return table(s, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("tenant"), "ts", F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("processing").alias("status"),
        F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (kind == "click").alias("ocr_used"), kind.alias("file_type"),
    )


_LOG = """log AS (SELECT event_id AS id, user_id AS tenant, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
  value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, event_type = 'click' AS ocr_used, event_type AS file_type FROM events)"""
_MEASURES = """count(*) AS jobs, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(ocr_used) AS ocr_jobs,
  CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, coalesce(round_even(avg(CASE WHEN duration_ms <> 0 THEN duration_ms END), 0), 0) AS avg_duration_ms"""


@query("g1_usage_totals", f"WITH {_LOG} SELECT {_MEASURES} FROM log WHERE ts >= TIMESTAMP '2024-01-05'")
def _(s, d):
    return G.usage_totals(log(s, d), None, "2024-01-05")


@query("g1_usage_by_tenant_scan", f"WITH {_LOG} SELECT id, tokens FROM log WHERE tenant = 7 AND ts >= TIMESTAMP '2024-01-10'")
def _(s, d):
    return G.tenant_time_scan(log(s, d), 7, "2024-01-10").select("id", "tokens")


@query("g2_usage_by_day", f"WITH {_LOG} SELECT CAST(ts AS DATE) AS day, count(*) AS jobs, CAST(sum(tokens) AS BIGINT) AS tokens FROM log WHERE ts IS NOT NULL GROUP BY 1")
def _(s, d):
    return G.usage_by_day(log(s, d))


@query("g3_usage_by_dim", f"WITH {_LOG} SELECT coalesce(file_type, 'unknown') AS file_type, count(*) AS jobs FROM log GROUP BY 1")
def _(s, d):
    return G.usage_by_dim(log(s, d), "file_type")


@query("g4_usage_cube", f"WITH {_LOG}, r AS (SELECT *, CAST(ts AS DATE) AS day FROM log) SELECT day, file_type, CAST(grouping_id(day, file_type) AS BIGINT) AS grouping, {_MEASURES} FROM r GROUP BY GROUPING SETS ((), (day), (file_type))")
def _(s, d):
    return G.usage_cube(log(s, d), "file_type")


@query("g5_platform_stats", f"""WITH {_LOG}, u AS (SELECT tenant, count(*) AS jobs, CAST(sum(tokens) AS BIGINT) AS tokens, max(ts) AS last_active FROM log GROUP BY tenant),
  k AS (SELECT o_custkey AS tenant, count_if(o_orderstatus = 'O') AS active_keys FROM orders GROUP BY 1)
SELECT c_custkey AS tenant, c_name AS name, coalesce(jobs, 0) AS jobs, coalesce(tokens, 0) AS tokens, last_active, coalesce(active_keys, 0) AS active_keys
FROM customer LEFT JOIN u ON u.tenant = c_custkey LEFT JOIN k ON k.tenant = c_custkey""")
def _(s, d):
    tenants = table(s, d, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_name").alias("name"))
    keys = table(s, d, "orders").select(F.col("o_custkey").alias("tenant"), F.when(F.col("o_orderstatus") == "O", "active").alias("status"))
    return G.platform_stats(tenants, keys, log(s, d))


@query("g6_latency_percentiles", f"""WITH {_LOG}, l AS (SELECT *, CAST(ts AS DATE) AS day FROM log),
  r AS (SELECT day, duration_ms, row_number() OVER (PARTITION BY day ORDER BY duration_ms) AS rank, count(*) OVER (PARTITION BY day) AS n FROM l WHERE duration_ms IS NOT NULL),
  p AS (SELECT day, max(CASE WHEN rank = round_even(0.5 * (n - 1), 0) + 1 THEN duration_ms END) AS p50, max(CASE WHEN rank = round_even(0.95 * (n - 1), 0) + 1 THEN duration_ms END) AS p95 FROM r GROUP BY day)
SELECT l.day, avg(CAST(status = 'completed' AS INT)) AS success_rate, avg(CAST(ocr_used AS INT)) AS ocr_rate, any_value(p50) AS p50, any_value(p95) AS p95 FROM l LEFT JOIN p ON p.day = l.day GROUP BY l.day""")
def _(s, d):
    return G.latency_percentiles(log(s, d).withColumn("day", F.to_date("ts")), "day", {"p50": 0.5, "p95": 0.95})


@query("g7_perf_summary", f"""WITH {_LOG} SELECT quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, max(duration_ms) AS max_ms, round_even(avg(duration_ms), 3) AS mean_ms,
  round_even(sum(tokens) / count(*), 3) AS tokens_per_document, count_if(status = 'failed') AS failed, count_if(status = 'partial') AS partial FROM log""")
def _(s, d):
    return G.perf_summary(log(s, d))


@query("g8_batch_status", """WITH b AS (SELECT l_orderkey AS batch_id, count(*) AS total, count_if(l_linestatus = 'F') AS completed, count_if(l_linestatus = 'O' AND l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1),
  p AS (SELECT *, greatest(total - completed - failed, 0) AS processing FROM b)
SELECT *, CASE WHEN processing > 0 THEN 'processing' WHEN failed = 0 THEN 'completed' WHEN completed = 0 THEN 'failed' ELSE 'partial' END AS status FROM p""")
def _(s, d):
    st = F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("processing")
    return G.batch_status(table(s, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), st.alias("status")))


def _half_even(x: str) -> str:
    """Two decimals, halves to even, on the decimal that the double prints as."""
    d = f"CAST({x} AS DECIMAL(18,9))"
    r = f"CAST({d} AS DECIMAL(18,2))"
    return f"CAST(CASE WHEN {r} - {d} = 0.005 AND CAST({r} * 100 AS BIGINT) % 2 = 1 THEN {r} - 0.01 ELSE {r} END AS DOUBLE)"


@query("g9_score_confidence", f"""WITH r AS (SELECT o_custkey AS doc_id, list(CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 0.5e0 ELSE 0.25e0 END) AS e, count(*) AS n FROM orders GROUP BY 1),
  p AS (SELECT doc_id, {_half_even("(doc_id % 6) / 5e0")} AS personal, {_half_even("list_sum(e) / len(e)")} AS experience, 0e0 AS education, {_half_even("least(n / 5e0, 1e0)")} AS skills, {_half_even("list_sum(e) / len(e)")} AS mapping FROM r)
SELECT *, {_half_even("personal * 0.30e0 + experience * 0.30e0 + education * 0.15e0 + skills * 0.10e0 + mapping * 0.15e0")} AS overall FROM p""")
def _(s, d):
    pts = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.25)
    r = table(s, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list(pts).alias("experience_points"), F.count(F.lit(1)).alias("n_skills"))
    r = r.withColumns({"personal_points": F.col("doc_id") % 6, "education_points": F.array().cast("array<double>"), "mapping": F.col("experience_points")})
    return G.score_confidence(r)


_GUESS = "o AS (SELECT doc_id, CAST(n_chars > 400 AS INT) AS quality, CAST(contains(text, 'worthless') OR contains(text, 'pathetic') AS INT) AS toxic, source FROM documents)"
_HITS = "h AS (SELECT l.doc_id, 'quality' AS metric, CAST(l.quality IS NOT DISTINCT FROM o.quality AS INT) AS hit FROM labels l LEFT JOIN o USING (doc_id) WHERE l.quality IS NOT NULL UNION ALL SELECT l.doc_id, 'toxic', CAST(l.toxic IS NOT DISTINCT FROM o.toxic AS INT) FROM labels l LEFT JOIN o USING (doc_id) WHERE l.toxic IS NOT NULL)"


def _hits(s, d):
    t = F.col("text")
    out = table(s, d, "documents").select("doc_id", (F.col("n_chars") > 400).cast("int").alias("quality"), (t.contains("worthless") | t.contains("pathetic")).cast("int").alias("toxic"))
    return G.score_extraction(out, table(s, d, "labels"), ["quality", "toxic"])


@query("g10_score_extraction", f"WITH {_GUESS}, {_HITS} SELECT doc_id, metric, hit, 1 - hit AS miss FROM h")
def _(s, d):
    return _hits(s, d)


@query("g11_merge_scores", f"""WITH {_GUESS}, {_HITS}, x AS (SELECT h.*, source FROM h LEFT JOIN o USING (doc_id)),
  r AS (SELECT metric, source, sum(hit) AS hits, count(*) AS total, sum(hit) / count(*) AS rate FROM x GROUP BY metric, source UNION ALL SELECT metric, NULL, sum(hit), count(*), sum(hit) / count(*) FROM x GROUP BY metric)
SELECT source, metric, CAST(hits AS BIGINT) AS hits, CAST(total AS BIGINT) AS total, round_even(rate, 4) AS rate FROM r
UNION ALL SELECT source, 'overall', CAST(sum(hits) AS BIGINT), CAST(sum(total) AS BIGINT), round_even(avg(rate), 4) FROM r GROUP BY source""")
def _(s, d):
    return G.merge_scores(_hits(s, d).join(table(s, d, "documents").select("doc_id", "source"), "doc_id"), "source")


def _pairs(s, d):
    """Each order and the customer's one before it, as JSON."""
    o = dealt(table(s, d, "orders"), "o_custkey")
    js = F.to_json(F.struct(F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.struct((F.col("o_orderkey") % 3).alias("m")).alias("n"), F.array(F.col("o_orderkey") % 2, F.lit(5)).alias("l")))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant"), "o_custkey", "o_orderkey", js.alias("updated"))
    return o.withColumn("original", F.lag("updated").over(w)).filter("original is not null").select("id", "tenant", "original", "updated")


_PAIRS = """x AS (SELECT o_orderkey AS id, o_custkey AS tenant, o_orderstatus AS st, o_orderpriority AS pr, o_orderkey % 3 AS m, o_orderkey % 2 AS l FROM orders),
  p AS (SELECT *, lag(id) OVER w AS prev, lag(st) OVER w AS st0, lag(pr) OVER w AS pr0, lag(m) OVER w AS m0, lag(l) OVER w AS l0 FROM x WINDOW w AS (PARTITION BY tenant ORDER BY id)),
  c AS (SELECT id, tenant, unnest([{'path': 'st', 'before': st0, 'after': st}, {'path': 'pr', 'before': pr0, 'after': pr}, {'path': 'n.m', 'before': CAST(m0 AS VARCHAR), 'after': CAST(m AS VARCHAR)}, {'path': 'l[0]', 'before': CAST(l0 AS VARCHAR), 'after': CAST(l AS VARCHAR)}]) AS z FROM p WHERE prev IS NOT NULL),
  diff AS (SELECT id, tenant, z.path AS path, z.before AS before, z.after AS after FROM c WHERE z.before <> z.after)"""


def _diff(s, d):
    p = _pairs(s, d)
    # an order has four leaves
    parts = parts_of(table(s, d, "orders"), 50_000)
    return J.json_diff(J.leaves(p, "id", "original", 4), J.leaves(p, "id", "updated", 4), parts), p


@query("j1_json_diff", f"WITH {_PAIRS} SELECT id, path, before, after FROM diff")
def _(s, d):
    return _diff(s, d)[0].select("id", "path", "before", "after")


@query("j2_json_get_path", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def _(s, d):
    return J.json_get_path(table(s, d, "events"), "props", "k").select("event_id", "value")


@query("j3_changed_flag", f"WITH {_PAIRS} SELECT p.id, CASE WHEN p.id % 7 = 0 THEN false ELSE EXISTS (SELECT 1 FROM diff WHERE diff.id = p.id) END AS changed FROM p WHERE prev IS NOT NULL")
def _(s, d):
    diff, p = _diff(s, d)
    return J.changed_flag(p.withColumn("changed", F.when(F.col("id") % 7 == 0, False)), diff, "id").select("id", "changed")


@query("j4_payload_cap", "SELECT page_id, octet_length(encode(html)) <= 2000 AS ok FROM pages")
def _(s, d):
    ok, bad = J.payload_cap(table(s, d, "pages"), "html", 2000)
    return ok.select("page_id", F.lit(True).alias("ok")).unionByName(bad.select("page_id", F.lit(False).alias("ok")))


@query("j5_union_tenants", f"WITH {_PAIRS} SELECT id FROM p WHERE prev IS NOT NULL AND tenant = 11")
def _(s, d):
    return J.union_tenants(_pairs(s, d), 11).select("id")


_OWNERS = "o AS (SELECT * FROM (VALUES ('st', 'status'), ('pr', 'order'), ('n', 'order'), ('l', 'order')) v(root, owner))"


def _owners(s):
    return s.createDataFrame([("st", "status"), ("pr", "order"), ("n", "order"), ("l", "order")], "root string, owner string")


@query("g12_correction_counts", f"""WITH {_PAIRS}, {_OWNERS}, f AS (SELECT owner, regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS field, count(*) AS count FROM diff JOIN o ON o.root = regexp_extract(path, '^([^.\\[]*)', 1) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY count DESC, field) AS rank FROM f) SELECT * FROM r WHERE rank <= 2""")
def _(s, d):
    return G.correction_counts(_diff(s, d)[0], _owners(s), 2)


def _examples(s, d):
    rows = _diff(s, d)[0].withColumn("root", F.regexp_extract("path", r"^([^.\[]*)", 1)).join(_owners(s), "root")
    return G.correction_examples(rows.select("owner", F.col("path").alias("field"), (F.col("id") * 10 + F.length("path")).alias("ord"), "before", "after"), 2)


_EXAMPLES = """e0 AS (SELECT owner, path AS field, id * 10 + length(path) AS ord, left(before, 2) AS before, left(after, 2) AS after FROM diff JOIN o ON o.root = regexp_extract(path, '^([^.\\[]*)', 1)),
  e1 AS (SELECT *, row_number() OVER (PARTITION BY owner, field ORDER BY ord) AS k FROM e0 WHERE before IS DISTINCT FROM after),
  e2 AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ord) AS j FROM e1 WHERE k <= 4),
  ex AS (SELECT owner, field, ord, before, after FROM e2 WHERE j <= 24)"""


@query("g13_correction_examples", f"WITH {_PAIRS}, {_OWNERS}, {_EXAMPLES} SELECT * FROM ex")
def _(s, d):
    return _examples(s, d)


@query("g14_eligible_owners", """WITH n AS (SELECT p_brand AS owner, p_partkey AS pos, left(trim(' ' || p_type || ' '), 200) AS rule FROM part),
  e AS (SELECT owner FROM n GROUP BY owner HAVING count(*) >= 5),
  f AS (SELECT *, row_number() OVER (PARTITION BY owner, lower(rule) ORDER BY pos) AS nth FROM n WHERE owner IN (FROM e)),
  r AS (SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY pos) AS INT) AS rank, rule FROM f WHERE nth = 1) SELECT * FROM r WHERE rank <= 3""")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("rule"))
    return G.eligible_owners(p, p, 5, 3)


@query("w3_recent_n", "SELECT event_id AS id, ts FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(s, d):
    return G.recent_n(log(s, d), "2024-02-01", 10, 50).select("id", "ts")


@query("w4_latest_by_key", "SELECT user_id AS tenant, max(ts) AS last_active FROM events GROUP BY 1")
def _(s, d):
    return G.latest_by_key(log(s, d), "tenant")


def roles(s, d):
    """A customer's orders as roles, in months."""
    t = F.col("o_orderdate")
    start = F.year(t) * 12 + F.month(t)
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.when(k % 11 > 0, start).alias("start_m"), F.when(k % 5 > 0, start + k % 9 - 2).cast("int").alias("end_m"), (k % 13 == 0).alias("ongoing")
    )


_ROLES = """roles AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderkey % 11 > 0 THEN year(o_orderdate) * 12 + month(o_orderdate) END AS start_m,
  CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 9 - 2 END AS end_m, o_orderkey % 13 = 0 AS ongoing FROM orders)"""


@query("w1_flag_gaps", f"""WITH {_ROLES} SELECT doc_id, pos, start_m IS NOT NULL AND coalesce(start_m - lag(CASE WHEN ongoing THEN NULL ELSE end_m END) OVER (PARTITION BY doc_id, start_m IS NULL ORDER BY start_m, pos) > 3, false) AS gap_warning FROM roles""")
def _(s, d):
    return W.flag_gaps(roles(s, d)).select("doc_id", "pos", "gap_warning")


@query("w1_flag_gaps_running", f"""WITH {_ROLES} SELECT doc_id, pos, start_m IS NOT NULL AND coalesce(start_m - max(CASE WHEN ongoing THEN NULL ELSE end_m END) OVER (PARTITION BY doc_id, start_m IS NULL ORDER BY start_m, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3, false) AS gap_warning FROM roles""")
def _(s, d):
    return W.flag_gaps(roles(s, d), mode="running_max").select("doc_id", "pos", "gap_warning")


@query("w2_flag_reversed_ranges", f"WITH {_ROLES} SELECT doc_id, pos, 'experience[' || pos || '].end_date' AS field, 0.9e0 AS confidence, 'ends before it starts' AS reason FROM roles WHERE end_m < start_m")
def _(s, d):
    return W.flag_reversed_ranges(roles(s, d))


@query("w5_ordered_distinct", """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(trim(o_orderpriority)) ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def _(s, d):
    return W.ordered_distinct(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("x3_budget_truncate", """WITH c AS (SELECT conv_id AS doc_id, turn AS seq, left(text, 120) AS t FROM conversations),
  r AS (SELECT *, 300 - coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM c)
SELECT doc_id, seq, left(t, CAST(l AS BIGINT)) AS text FROM r WHERE l > 0 AND length(t) > 0""")
def _(s, d):
    return W.budget_truncate(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text"), 120, 300)
