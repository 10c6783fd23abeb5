"""Reports over the audit log and scores of extracted records, whole as the survey has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.operators import rollup as G
from loomfield.operators import scoring as C
from loomfield.plans.usage_queries import _LOG, _MEASURES, log
from loomfield.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_SINCE = "2024-01-11"
_TENANTS = "t AS (SELECT c_custkey AS tenant, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS plan, CASE c_custkey % 4 WHEN 0 THEN 'suspended' WHEN 1 THEN 'active' END AS status FROM customer WHERE c_custkey % 7 > 0)"
_KEYS = "k AS (SELECT o_custkey AS tenant, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'revoked' END AS status FROM orders)"


def _platform(s, d):
    k = F.col("c_custkey")
    tenants = table(s, d, "customer").filter(k % 7 > 0).select(
        k.alias("tenant"), F.when(k % 5 > 0, F.col("c_name")).otherwise("").alias("name"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("plan"), F.when(k % 4 == 0, "suspended").when(k % 4 == 1, "active").alias("status")
    )
    keys = table(s, d, "orders").select(F.col("o_custkey").alias("tenant"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("revoked").alias("status"))
    return tenants, keys, log(s, d), _SINCE


# the tenants not listed (a seventh) are what a log and keys of unknown tenants must not add to
@query("g5_platform_tenants", f"""WITH {_LOG}, {_TENANTS}, {_KEYS}, u AS (SELECT tenant, count(*) AS jobs, CAST(sum(tokens) AS BIGINT) AS tokens, max(ts) AS last_active FROM log WHERE ts >= TIMESTAMP '{_SINCE}' GROUP BY 1),
  a AS (SELECT tenant, count_if(status = 'active') AS active_keys FROM k GROUP BY 1)
SELECT t.tenant, CASE WHEN name = '' THEN CAST(t.tenant AS VARCHAR) ELSE name END AS name, coalesce(plan, '') AS plan, coalesce(status, 'active') AS status, coalesce(jobs, 0) AS jobs, coalesce(tokens, 0) AS tokens, last_active, coalesce(active_keys, 0) AS active_keys
FROM t LEFT JOIN u ON u.tenant = t.tenant LEFT JOIN a ON a.tenant = t.tenant""")
def _(s, d):
    return G.platform_tenants(*_platform(s, d))


@query("g5_platform_totals", f"""WITH {_LOG}, {_TENANTS}, {_KEYS}
SELECT (SELECT count(*) FROM t) AS tenants, (SELECT count_if(coalesce(status, 'active') = 'active') FROM t) AS active_tenants, (SELECT count(*) FROM k WHERE status = 'active' AND tenant IN (SELECT tenant FROM t)) AS active_keys, {_MEASURES}
FROM log WHERE ts >= TIMESTAMP '{_SINCE}' AND tenant IN (SELECT tenant FROM t)""")
def _(s, d):
    return G.platform_totals(*_platform(s, d))


def _coded(s, d):
    code = F.when(F.col("file_type") == "error", F.concat(F.lit("E"), F.col("id") % 5))
    return log(s, d).withColumns({"day": F.to_date("ts"), "error_code": code})


@query("g6_latency_report", f"""WITH {_LOG}, l AS (SELECT *, CAST(ts AS DATE) AS day, CASE WHEN file_type = 'error' THEN 'E' || id % 5 END AS error_code FROM log),
  r AS (SELECT day, duration_ms, row_number() OVER (PARTITION BY day ORDER BY duration_ms) AS rank, count(*) OVER (PARTITION BY day) AS n FROM l WHERE duration_ms IS NOT NULL),
  p AS (SELECT day, max(CASE WHEN rank = round_even(0.5 * (n - 1), 0) + 1 THEN duration_ms END) AS p50, max(CASE WHEN rank = round_even(0.95 * (n - 1), 0) + 1 THEN duration_ms END) AS p95 FROM r GROUP BY day),
  e AS (SELECT day, error_code, count(*) AS n FROM l WHERE error_code IS NOT NULL GROUP BY 1, 2), m AS (SELECT day, string_agg(error_code || ':' || n, ',' ORDER BY n DESC, error_code) AS errors FROM e GROUP BY 1),
  s AS (SELECT day, id, duration_ms, row_number() OVER (PARTITION BY day ORDER BY duration_ms DESC, id) AS k FROM l WHERE duration_ms IS NOT NULL), z AS (SELECT day, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS slowest FROM s WHERE k <= 5 GROUP BY 1)
SELECT l.day, count(*) AS jobs, avg(CAST(status = 'completed' AS INT)) AS success_rate, avg(CAST(ocr_used AS INT)) AS ocr_rate, any_value(p50) AS p50, any_value(p95) AS p95, any_value(errors) AS errors, any_value(slowest) AS slowest
FROM l LEFT JOIN p ON p.day = l.day LEFT JOIN m ON m.day = l.day LEFT JOIN z ON z.day = l.day GROUP BY l.day""")
def _(s, d):
    out = G.latency_report(_coded(s, d), "day", {"p50": 0.5, "p95": 0.95})
    told = F.transform("errors", lambda x: F.concat(x["code"], F.lit(":"), x["n"].cast("string")))
    return out.withColumns({"errors": F.array_join(told, ","), "slowest": F.array_join(F.col("slowest.id").cast("array<string>"), ",")})


@query("g6_latency_sketches")  # a sketch's values are SQL's only within its error; tests hold them against exact ranks
def _(s, d):
    days = G.latency_sketches(_coded(s, d), "day")
    return G.sketch_percentiles(days.withColumn("week", F.date_trunc("week", "day").cast("date")), "week", {"p50": 0.5, "p95": 0.95})


@query("g7_perf_report", f"""WITH {_LOG}, r AS (SELECT *, id % 4 AS roles, id % 9 = 0 AS partial FROM log), c AS (SELECT * FROM r WHERE status = 'completed'),
  d AS (SELECT list_sort(list(duration_ms)) AS v FROM c WHERE duration_ms IS NOT NULL), t AS (SELECT list_sort(list(tokens)) AS v FROM c WHERE tokens IS NOT NULL)
SELECT (SELECT count(*) FROM c) AS documents, (SELECT count(*) FROM r) - (SELECT count(*) FROM c) AS failed, (SELECT count_if(partial) FROM c) AS partial, (SELECT max(duration_ms) FROM c) AS max_ms, (SELECT round_even(avg(duration_ms), 3) FROM c) AS mean_ms,
  (SELECT CAST(sum(tokens) AS BIGINT) FROM c) AS tokens, (SELECT round_even(avg(tokens), 3) FROM c) AS tokens_mean, (SELECT round_even(sum(tokens) / greatest(sum(roles), 1), 3) FROM c) AS tokens_per_role,
  d.v[CAST(round_even(0.5 * (len(d.v) - 1), 0) AS BIGINT) + 1] AS p50_ms, d.v[CAST(round_even(0.95 * (len(d.v) - 1), 0) AS BIGINT) + 1] AS p95_ms, CAST(t.v[CAST(round_even(0.5 * (len(t.v) - 1), 0) AS BIGINT) + 1] AS DOUBLE) AS tokens_p50 FROM d, t""")
def _(s, d):
    runs = log(s, d).withColumns({"roles": F.col("id") % 4, "partial": F.col("id") % 9 == 0})
    return G.perf_report(runs).withColumns({c: F.bround(c, 3) for c in ("mean_ms", "tokens_mean", "tokens_per_role")})


def _records(s, d):
    """A customer's orders as its roles, and labels that differ from them in places."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    day = F.date_format("o_orderdate", "MM/yyyy")
    row = F.struct(
        k.alias("k"), F.concat(F.lit(" "), "o_orderpriority", F.lit("  Ltd")).alias("company"), F.concat(F.lit("Clerk "), "o_orderstatus").alias("role"), day.alias("start_date"), F.when(k % 3 > 0, "Present").alias("end_date"),
        F.when(k % 4 > 0, k.cast("string")).alias("city_id"), (k % 7).cast("string").alias("state_id"), F.array(F.struct((k % 11).cast("string").alias("specialty_id"))).alias("specialties"),
    )
    key = F.when(k % 5 == 0, F.concat(F.lit("CLERK "), "o_orderstatus")).when(k % 5 == 1, F.concat(F.lit("no "), "o_orderpriority")).otherwise(F.substring("o_orderpriority", 3, 20))
    asked = F.struct(k.alias("k"), key.alias("company_key"), day.alias("start_date"), F.when(k % 2 == 0, "present").alias("end_date"), (k % 2 == 1).alias("catalog_city"), F.when(k % 6 > 0, k % 7).alias("state_id"))
    per = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("experience"), F.array_sort(F.collect_list(F.when(k % 3 == 0, asked))).alias("asked"))
    people = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(per, F.col("o_custkey") == c, "left")
    text = F.concat(F.lit("+1 (555) "), c.cast("string"))
    out = people.filter(c % 8 > 0).select(
        c.alias("doc_id"), F.struct(F.col("c_name").alias("full_name"), F.lower("c_name").alias("email"), text.alias("phone"), F.when(c % 2 == 0, "9-1").alias("phone_secondary"), F.array("c_mktsegment").alias("credentials")).alias("personal"),
        "experience", F.array(F.struct(F.concat(F.lit("University of "), "n_name").alias("institution"))).alias("education"),
    )
    want = people.select(
        c.alias("doc_id"), F.struct(F.when(c % 3 > 0, F.upper("c_name")).alias("full_name"), F.concat("c_name", F.when(c % 5 == 0, "x").otherwise("")).alias("email"), F.concat(F.lit("1555"), c.cast("string")).alias("phone_digits"), F.array(F.lower("c_mktsegment"), F.lit("CPR")).alias("credentials")).alias("personal"),
        F.col("asked").alias("experience"), F.array(F.concat(F.lit("OF "), "n_name"), F.lit("college")).alias("education_keys"),
        F.struct(F.array(F.lit("91")).alias("no_phone_secondary_digits"), F.array((c % 11).cast("string")).alias("no_specialty_id")).alias("negatives"),
    )
    return out, want


_SCORES = """WITH n AS (SELECT c_custkey AS c, c_name, c_mktsegment, n_name, c_custkey % 8 > 0 AS has FROM customer JOIN nation ON n_nationkey = c_nationkey),
  ar AS (SELECT o_custkey AS c, o_orderkey AS k, lower(o_orderpriority) || ' ltd' AS company, 'clerk ' || lower(o_orderstatus) AS title, strftime(o_orderdate, '%m/%Y') AS s FROM orders WHERE o_custkey % 8 > 0),
  er AS (SELECT o_custkey AS c, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'clerk ' || lower(o_orderstatus) WHEN 1 THEN 'no ' || lower(o_orderpriority) ELSE lower(substr(o_orderpriority, 3, 20)) END AS key, strftime(o_orderdate, '%m/%Y') AS s FROM orders WHERE o_orderkey % 3 = 0),
  f AS (SELECT er.*, ar.k AS ak, ar.s AS as_ FROM er LEFT JOIN ar ON ar.c = er.c AND (contains(company, key) OR contains(title, key)) QUALIFY row_number() OVER (PARTITION BY er.c, er.k ORDER BY ar.k) = 1),
  x AS (
    SELECT c, 'contact' AS metric, has AS ok FROM n WHERE c % 3 > 0 UNION ALL SELECT c, 'contact', has AND c % 5 > 0 FROM n UNION ALL SELECT c, 'contact', has FROM n
    UNION ALL SELECT c, 'credentials', has FROM n UNION ALL SELECT c, 'credentials', false FROM n
    UNION ALL SELECT c, 'role_recall', ak IS NOT NULL FROM f
    UNION ALL SELECT c, 'date_accuracy', s = as_ FROM f WHERE ak IS NOT NULL UNION ALL SELECT c, 'date_accuracy', ak % 3 > 0 FROM f WHERE ak IS NOT NULL AND k % 2 = 0
    UNION ALL SELECT c, 'city_resolution', ak % 4 > 0 FROM f WHERE ak IS NOT NULL AND k % 2 = 1
    UNION ALL SELECT c, 'geo_ids', ak % 7 = k % 7 FROM f WHERE ak IS NOT NULL AND k % 6 > 0
    UNION ALL SELECT c, 'role_precision', EXISTS (SELECT 1 FROM er WHERE er.c = ar.c AND contains(company || ' || ' || title, key)) FROM ar
    UNION ALL SELECT c, 'education', has FROM n UNION ALL SELECT c, 'education', false FROM n
    UNION ALL SELECT c, 'negatives', NOT (has AND c % 2 = 0) FROM n UNION ALL SELECT c, 'negatives', NOT EXISTS (SELECT 1 FROM ar WHERE ar.c = n.c AND ar.k % 11 = n.c % 11) FROM n),
  h AS (SELECT c AS doc_id, metric, count_if(ok) AS hit, count_if(NOT ok) AS miss FROM x GROUP BY 1, 2)"""


@query("g10_score_records", f"{_SCORES} SELECT * FROM h")
def _(s, d):
    return C.score_records(*_records(s, d))


@query("g11_merge_record_scores", f"""{_SCORES}, y AS (SELECT h.*, n_name AS nation FROM h JOIN n ON n.c = doc_id),
  r AS (SELECT metric, nation, sum(hit) AS hits, sum(hit + miss) AS total FROM y GROUP BY ROLLUP (metric, nation) HAVING metric IS NOT NULL)
SELECT nation, metric, CAST(hits AS BIGINT) AS hits, CAST(total AS BIGINT) AS total, round_even(hits / total, 4) AS rate FROM r
UNION ALL SELECT nation, 'overall', CAST(sum(hits) AS BIGINT), CAST(sum(total) AS BIGINT), round_even(avg(hits / total), 4) FROM r GROUP BY nation""")
def _(s, d):
    hits = C.score_records(*_records(s, d))
    nations = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc_id"), F.col("n_name").alias("nation"))
    return G.merge_scores(hits.join(nations, "doc_id"), "nation")
