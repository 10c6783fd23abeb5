"""Sources, segmentation and stream operators over the supplied tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield.functions.text import emails
from loomfield.operators import segment as X
from loomfield.sources import files as S
from loomfield.sources.tables import dealt, table
from loomfield.streaming import jobs as R
from loomfield.streaming import stateful as T

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shared(s, what: str) -> str:
    """A new folder that driver and executors share."""
    base = s.sparkContext.getCheckpointDir() or s.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{what}-{uuid.uuid4().hex}"


# ---- sources

_TYPES, _HEADS = {"parquet": "table", "crc": "sum"}, {"table": ["50415231"], "sum": ["637263"]}


@query("s1_scan_files")
def _(s, d):
    return S.scan_files(s, d, _TYPES, _HEADS).select("ext", "file_type", "length", "ok", "reason")


@query("s2_split_accepted", """WITH f AS (SELECT o_custkey % 50 AS batch_id, o_orderkey AS path, o_totalprice > 250000 AS big FROM orders), n AS (SELECT *, count_if(NOT big) OVER (PARTITION BY batch_id ORDER BY path) AS k FROM f)
SELECT batch_id, path, CASE WHEN big THEN 'too large' WHEN k > 200 THEN 'batch is full' END AS reason FROM n""")
def _(s, d):
    f = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("batch_id"), F.col("o_orderkey").alias("path"), F.when(F.col("o_totalprice") > 250000, 11 << 20).otherwise(9).alias("length"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    ok, skipped = S.split_accepted(f)
    return ok.select("batch_id", "path", F.lit(None).cast("string").alias("reason")).unionByName(skipped.select("batch_id", "path", "reason"))


@query("s3_route_strategy", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'direct' WHEN doc_id % 3 = 1 AND length(trim(text)) >= 100 THEN 'digital' ELSE 'ocr' END AS strategy, NOT (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND length(trim(text)) >= 100)) AS needs_async FROM documents")
def _(s, d):
    k = F.col("doc_id") % 3
    df = table(s, d, "documents").select("doc_id", "text", F.when(k == 0, "docx").when(k == 1, "pdf").otherwise("png").alias("file_type"))
    return S.route_strategy(df).select("doc_id", "strategy", "needs_async")


_SPEC = {"id": ["id", "key"], "name": ["name", "title"], "keywords": ["keywords"]}


@query("s4_load_catalog_json", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, [p_type] AS keywords FROM part WHERE p_partkey % 7 > 0")
def _(s, d):
    row = F.struct(F.concat(F.lit(" "), "p_partkey").alias("key"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).otherwise(" ").alias("title"), F.array("p_type").alias("keywords"))
    path = shared(s, "catalog")  # a snapshot a brand, each one object with its records
    one = table(s, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(row).alias("records"))).alias("value"))
    one.write.partitionBy("p_brand").text(path)
    return S.load_catalog_json(s, path, _SPEC).drop("ord")


@query("s5_load_catalog_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, [p_type, p_brand] AS keywords FROM part")
def _(s, d):
    path = shared(s, "catalog")
    table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" | ", "p_type", "p_brand").alias("keywords")).write.option("header", "true").csv(path)
    return S.load_catalog_csv(s, path, _SPEC).drop("ord")


@query("s6_load_or_empty", "SELECT p_partkey FROM part WHERE false")
def _(s, d):
    return S.load_or_empty(s, lambda s, p: s.read.parquet(p), f"{d}/no_such_table.parquet", "p_partkey long")


@query("s7_flatten_hierarchy", """SELECT p_type AS category, p_brand AS profession, CASE WHEN p_size % 2 = 0 THEN 'even' END AS "group", p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 9 > 0""")
def _(s, d):
    p = table(s, d, "part")
    item = F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_name")).otherwise("").alias("name"))
    even = F.col("p_size") % 2 == 0
    prof = p.groupBy("p_type", "p_brand").agg(F.collect_list(F.when(even, item)).alias("g"), F.collect_list(F.when(~even, item)).alias("i"))
    prof = prof.select("p_type", F.struct(F.col("p_brand").alias("name"), F.array(F.struct(F.lit("even").alias("name"), F.col("g").alias("items"))).alias("groups"), F.col("i").alias("items")).alias("p"))
    return S.flatten_hierarchy(prof.groupBy(F.col("p_type").alias("category")).agg(F.collect_list("p").alias("professions"))).drop("ord")


@query("s8_flatten_geography", "SELECT r_regionkey AS country_id, n_nationkey AS id, n_name AS name, substr(n_name, 1, 3) AS code FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("state"), F.substring("n_name", 1, 3).alias("statecode"))).alias("states"))
    g = table(s, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("country"), F.substring("r_name", 1, 2).alias("code"), "states")
    return S.flatten_geography(g)[1].drop("ord")


@query("s9_flatten_facilities", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def _(s, d):
    f = table(s, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("facilities"))
    return S.flatten_facilities(f).drop("ord")


@query("s10_keyword_overlay", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN [p_type, 'x', 'y'] ELSE [p_type] END AS keywords FROM part")
def _(s, d):
    p = table(s, d, "part")
    name = F.concat_ws(" ", "p_partkey", "p_name")
    return S.keyword_overlay(p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.array("p_type").alias("keywords")), p.filter("p_size % 5 = 0").select(name.alias("name"), F.array(F.lit("x"), F.lit("y")).alias("extra"))).select("id", "keywords")


def _responses(s, d):
    k = F.col("event_id") % 6
    body = F.when(k == 4, "not json").when(k == 5, '{"success": false}').otherwise(F.concat(F.lit('{"data": ['), "props", F.lit(", null]}")))
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.when(k == 0, 401).when(k == 1, 429).when(k == 2, 503).otherwise(200).alias("status"), body.alias("body"))


@query("s11_ingest_envelopes", "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'auth' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'server' WHEN 3 THEN NULL ELSE 'malformed' END AS error, CASE WHEN event_id % 6 = 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def _(s, d):
    rows, errors = S.ingest_envelopes(_responses(s, d), "struct<k:bigint>")
    return rows.select("id", F.lit(None).cast("string").alias("error"), F.col("row.k").alias("k")).unionByName(errors.select("id", "error", F.lit(None).cast("long").alias("k")))


@query("s12_write_results", "SELECT page_id AS job_id, CASE WHEN page_id % 2 = 0 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN length(html) > 3000 THEN 'result_too_large' END AS warning FROM pages")
def _(s, d):
    df = table(s, d, "pages").select(F.col("page_id").alias("job_id"), F.when(F.length("html") > 3000, F.repeat("html", 200)).otherwise("ok").alias("result"), (F.col("page_id") % 2 == 0).alias("partial"))
    return S.write_results(df).select("job_id", "status", "warning")


@query("s13_audit_sink", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    path = shared(s, "audit")
    S.audit_sink(table(s, d, "events"), path)
    return s.read.parquet(path).groupBy(F.col("day").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("s14_tenant_time_scan", "SELECT event_id FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-20'")
def _(s, d):
    from loomfield.operators.rollup import tenant_time_scan

    return tenant_time_scan(table(s, d, "events").withColumnRenamed("user_id", "tenant"), 3, "2024-01-20").select("event_id")


@query("s14_log_pages", """WITH r AS (SELECT event_id AS id, ts, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-08')
SELECT id, ts, CAST((k - 1) // 20 AS INT) AS page FROM r""")
def _(s, d):
    path = shared(s, "log")
    S.audit_sink(table(s, d, "events").withColumnsRenamed({"user_id": "tenant", "event_id": "id"}), path)
    pages = S.log_pages(s.read.parquet(path), 3, datetime(2024, 1, 8), 20)
    rows = [(r.id, r.ts, i) for i, page in enumerate(pages) for r in page]
    return s.createDataFrame(rows, "id long, ts timestamp_ntz, page int")


@query("s15_expire", "SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-25'")
def _(s, d):
    return S.expire(table(s, d, "events"), "2024-01-25", "24 hours").select("event_id")


@query("s16_catalog_refresh", "SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    path = shared(s, "snapshot")
    t = table(s, d, "supplier").select("s_suppkey", "s_name")
    S.catalog_refresh(t, path)
    S.catalog_refresh(t.filter("false"), path)
    S.catalog_refresh(t, path, {"named": "s_name = 'no such name'"})
    return S.catalog_current(s, path)


# ---- segmentation: a customer's orders as the lines of a document

_RULES = {"experience": ["work experience", "experience"], "skills": ["skills", "tools"], "education": ["education", "training"]}


def lines(s, d):
    """(doc_id, pos, text): a name, then two sections with an entry an order. Orders are
    shuffled once; a customer's first one brings the head and the last one the tail."""
    w = Window.partitionBy("o_custkey")
    o = dealt(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"), "o_custkey")
    o = o.withColumns({"nth": F.row_number().over(w.orderBy("o_orderkey")), "n": F.count(F.lit(1)).over(w).cast("int")})
    t = F.col("o_orderdate")
    end = F.when(F.col("o_orderkey") % 4 == 0, "Present").otherwise(F.date_format(F.add_months(t, 5), "MM/yyyy"))
    entry = (F.lit(""), F.concat(F.lit("Role "), "o_orderpriority"), F.concat(F.lit("Firm "), "o_orderstatus"), F.concat(F.date_format(t, "MMM yyyy"), F.lit(" - "), end), F.concat(F.lit("- did "), "o_orderkey"))
    who, even = F.col("o_custkey") % 3, F.col("o_custkey") % 2 == 0
    pick = lambda a, b: F.when(even, a).otherwise(b)
    head = (F.when(who == 0, "Ann Lee, RN").when(who == 1, "Bo Q. Diaz").otherwise("Mary-Jo Neil, BSN"), F.lit("Work Experience:"))
    skills = pick(F.concat(F.lit("lift, Lift; drive | "), F.col("o_custkey"), F.lit(" cranes")), F.concat(F.col("o_custkey"), F.lit(" cranes / tow")))
    tail = (F.lit("Education & Training"), pick("Bachelor of Science", "State University"), pick("State University", "Bachelor of Arts"), pick("1999", "2001"), F.lit("SKILLS"), skills)
    rows = lambda at, texts: F.array(*[F.struct((at + i).cast("int").alias("pos"), x.alias("text")) for i, x in enumerate(texts)])
    none = F.array().cast("array<struct<pos:int,text:string>>")
    mine = F.concat(F.when(F.col("nth") == 1, rows(F.lit(0), head)).otherwise(none), rows(F.col("nth") * 10, entry), F.when(F.col("nth") == F.col("n"), rows(F.col("n") * 10 + 100, tail)).otherwise(none))
    return o.select(F.col("o_custkey").alias("doc_id"), F.inline(mine))


def sections(s, d):
    return X.segment(X.section_headers(lines(s, d), _RULES))


_SAID = "CASE doc_id % 3 WHEN 0 THEN 'Ann Lee, RN' WHEN 1 THEN 'Bo Q. Diaz' ELSE 'Mary-Jo Neil, BSN' END"
_NAME = "CASE {id} % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo Q. Diaz' ELSE 'Mary-Jo Neil' END"
_TAUGHT = "CASE WHEN doc_id % 2 = 0 THEN 'Bachelor of Science' || chr(10) || 'State University' || chr(10) || '1999' ELSE 'State University' || chr(10) || 'Bachelor of Arts' || chr(10) || '2001' END"
_SKILLS = "CASE WHEN doc_id % 2 = 0 THEN 'lift, Lift; drive | ' || doc_id || ' cranes' ELSE doc_id || ' cranes / tow' END"
_N = "(SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY 1)"


@query("x1_section_headers", f"SELECT doc_id, section, CAST(pos AS INT) AS pos FROM (SELECT doc_id, unnest(['experience', 'education', 'skills']) AS section, unnest([1, n * 10 + 100, n * 10 + 104]) AS pos FROM {_N})")
def _(s, d):
    return X.section_headers(lines(s, d), _RULES).filter("section is not null").select("doc_id", "section", "pos")


@query("x2_segment", f"""WITH e AS (SELECT o_custkey AS doc_id, string_agg('Role ' || o_orderpriority || chr(10) || 'Firm ' || o_orderstatus || chr(10) || strftime(o_orderdate, '%b %Y') || ' - ' || CASE WHEN o_orderkey % 4 = 0 THEN 'Present' ELSE strftime(o_orderdate + INTERVAL 5 MONTH, '%m/%Y') END || chr(10) || '- did ' || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)
SELECT doc_id, unnest([0, 1, 2, 3]) AS seq, unnest(['header', 'experience', 'education', 'skills']) AS section, md5(unnest([{_SAID}, t, {_TAUGHT}, {_SKILLS}])) AS h FROM e""")
def _(s, d):
    return sections(s, d).select("doc_id", "seq", "section", F.md5("text").alias("h"))


@query("x2_segment_conversations", """WITH h AS (SELECT conv_id AS doc_id, turn AS pos, role, text, CASE WHEN role = 'user' THEN 's' || turn END AS section FROM conversations),
  l AS (SELECT *, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'header') AS held FROM h),
  p AS (SELECT doc_id, held, min(pos) AS first, coalesce(string_agg(CASE WHEN section IS NULL THEN text END, chr(10) ORDER BY pos), '') AS t FROM l GROUP BY 1, 2),
  q AS (SELECT *, count_if(held <> 'header') OVER (PARTITION BY doc_id) AS named FROM p WHERE regexp_replace(t, '\\s', '', 'g') <> ''),
  g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS seq, held AS section FROM q WHERE named >= 2)
SELECT doc_id, CAST(seq AS INT) AS seq, section FROM g UNION ALL SELECT DISTINCT doc_id, 0, 'full_text' FROM h WHERE doc_id NOT IN (SELECT doc_id FROM g)""")
def _(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", F.when(F.col("role") == "user", F.concat(F.lit("s"), "turn")).alias("section"))
    return X.segment(c).select("doc_id", "seq", "section")


_ROLES = """SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS pos, strftime(o_orderdate, '%m/%Y') AS start_date, CASE WHEN o_orderkey % 4 = 0 THEN 'Present' ELSE strftime(o_orderdate + INTERVAL 5 MONTH, '%m/%Y') END AS end_date"""


@query("x4_date_ranges", f"{_ROLES} FROM orders")
def _(s, d):
    t = sections(s, d).filter("section = 'experience'")
    return t.select("doc_id", F.posexplode(X.date_ranges(F.col("text"))).alias("pos", "x")).select("doc_id", "pos", F.col("x.start").alias("start_date"), F.col("x.end").alias("end_date"))


def _blocks(s, d):
    return X.experience_blocks(sections(s, d).filter("section = 'experience'").select("doc_id", "text"))


@query("x5_experience_blocks", f"{_ROLES}, 'Role ' || o_orderpriority AS role, 'Firm ' || o_orderstatus AS company, o_orderkey % 4 = 0 AS is_current, ['did ' || o_orderkey] AS description FROM orders")
def _(s, d):
    return _blocks(s, d)


@query("x6_education_entries", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Bachelor of Science' ELSE 'Bachelor of Arts' END AS degree, 'State University' AS institution, CASE WHEN doc_id % 2 = 0 THEN 1999 ELSE 2001 END AS year FROM {_N}")
def _(s, d):
    taught = sections(s, d).filter("section = 'education'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return X.education_entries(taught, r"(?i)\bbachelor\b", r"(?i)\buniversity\b").drop("pos")


@query("x7_split_items", f"SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS item FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['lift', 'drive', doc_id || ' cranes'] ELSE [doc_id || ' cranes', 'tow'] END AS l FROM {_N})")
def _(s, d):
    return X.split_items(sections(s, d).filter("section = 'skills'"), "text")


@query("x8_name_line", f"SELECT doc_id, {_NAME.format(id='doc_id')} AS name FROM {_N}")
def _(s, d):
    return X.name_line(lines(s, d))


# documents with an even id say no more in their header than an address
@query("x8_header_names", f"SELECT doc_id, {_NAME.format(id='doc_id')} AS name FROM ({_N}) n WHERE doc_id % 2 = 1")
def _(s, d):
    plain = F.when((F.col("section") == "header") & (F.col("doc_id") % 2 == 0), "me@x.org").otherwise(F.col("text"))
    return X.header_names(sections(s, d).select("doc_id", "section", plain.alias("text")))


@query("x9_assemble_record", f"SELECT o_custkey AS doc_id, {_NAME.format(id='o_custkey')} AS name, count(*) AS n_roles, 'Role ' || min_by(o_orderpriority, o_orderkey) AS first_role FROM orders GROUP BY 1")
def _(s, d):
    sec, ln = sections(s, d), lines(s, d)
    anchors = sec.filter("section = 'header'").select("doc_id", emails(F.col("text")).alias("emails"))
    rec = X.assemble_record(ln.select("doc_id").distinct(), anchors, _blocks(s, d), X.name_line(ln))
    return rec.select("doc_id", "name", F.size("experience").cast("long").alias("n_roles"), F.col("experience")[0]["role"].alias("first_role"))


@query("x9_documents_to_records", f"""SELECT o_custkey AS doc_id, {_NAME.format(id='o_custkey')} AS name, count(*) AS n_roles, 'Role ' || min_by(o_orderpriority, o_orderkey) AS first_role,
  CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 2 = 0 THEN 3 ELSE 2 END AS n_skills, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS n_education, 'p' || o_custkey || '@x.org' AS email FROM orders GROUP BY o_custkey""")
def _(s, d):
    # a third of the documents are without headers; an address stands above all
    heads = F.col("text").isin("Work Experience:", "Education & Training", "SKILLS") & (F.col("doc_id") % 3 == 0)
    rows = lines(s, d).filter(~heads).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    docs = rows.select("doc_id", F.concat(F.lit("p"), F.col("doc_id"), F.lit("@x.org\n"), F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("text"))
    out = X.documents_to_records(docs, _RULES, r"(?i)\bbachelor\b", r"(?i)\buniversity\b")
    return out.select("doc_id", "name", F.size("experience").cast("long").alias("n_roles"), F.col("experience")[0]["role"].alias("first_role"), F.size("skills").alias("n_skills"), F.size("education").alias("n_education"), "email")


@query("x10_reading_order", """WITH b AS (SELECT l_orderkey AS page_id, l_suppkey % 2 AS c, l_partkey AS y, l_linenumber AS pos, 'block of text number x' || l_partkey || ' and more of it' AS t FROM lineitem)
SELECT page_id, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY c, y, pos)) AS h FROM b GROUP BY 1""")
def _(s, d):
    text = F.concat(F.lit("block of text number x"), F.col("l_partkey"), F.lit(" and more of it"))
    y = F.col("l_partkey").cast("double")
    b = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.lit(595.0).alias("page_width"), F.col("l_linenumber").alias("pos"), (50.0 + 250.0 * (F.col("l_suppkey") % 2)).alias("x0"), y.alias("y0"), (y + 10).alias("y1"), text.alias("text"))
    return X.reading_order(b).select("page_id", F.size(F.split("text", "\n")).cast("long").alias("n"), F.md5("text").alias("h"))


# ---- streams and their batch twins


def _messages(s, d):
    e = F.col("event_id")
    body = F.when(e % 9 == 0, "{broken").when(e % 9 == 1, '{"job_id": null}').otherwise(F.to_json(F.struct(e.alias("job_id"), F.col("event_type").alias("kind"))))
    return table(s, d, "events").select(e.alias("message_id"), body.alias("body"))


@query("r1_parse_messages", "SELECT event_id AS job_id, event_type AS kind FROM events WHERE event_id % 9 > 1")
def _(s, d):
    return R.parse_messages(_messages(s, d), "body", "job_id long, kind string", ["job_id", "kind"])[0]


@query("r1_dead_letters", "SELECT event_id AS message_id FROM events WHERE event_id % 9 <= 1")
def _(s, d):
    return R.parse_messages(_messages(s, d), "body", "job_id long, kind string", ["job_id", "kind"])[1].select("message_id")


def _stream(s, d, name="events"):
    t = table(s, d, name)
    rows = s.readStream.schema(t.schema).parquet(f"{d}/{name}*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zoned time


@query("r2_skip_done", "SELECT DISTINCT user_id FROM events")
def _(s, d):
    e = table(s, d, "events")
    return R.skip_done(e, "user_id", "ts").select("user_id")


@query("r2_skip_done_stream", "SELECT DISTINCT user_id FROM events")
def _(s, d):
    return R.run_available(R.skip_done(_stream(s, d), "user_id", "ts", "365 days").select("user_id"), shared(s, "dedup"))


def _actions(df):
    kind = F.col("event_type")
    action = F.when(kind == "click", "claim").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("beat")
    return df.select((F.col("event_id") % 997).alias("job_id"), (F.col("event_id") % 97).alias("batch_id"), "ts", action.alias("action"))


_ACTIONS = "a AS (SELECT event_id % 997 AS job_id, event_id % 97 AS batch_id, ts, CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'beat' END AS action FROM events)"


@query("r3_job_state", f"""WITH {_ACTIONS}, j AS (SELECT job_id, min(CASE WHEN action = 'claim' THEN ts END) AS c, min_by(action, ts) FILTER (action IN ('completed', 'failed')) AS f FROM a GROUP BY 1)
SELECT job_id, CASE WHEN c IS NOT NULL AND f IS NOT NULL THEN f ELSE 'processing' END AS state, c AS claimed FROM j""")
def _(s, d):
    return R.job_state(_actions(table(s, d, "events")))


_PROGRESS = f"""WITH {_ACTIONS}, e AS (SELECT DISTINCT batch_id, job_id, first_value(action) OVER (PARTITION BY batch_id, job_id ORDER BY ts) AS action FROM a WHERE action IN ('completed', 'failed'))
SELECT batch_id, 'batch.completed' AS event, count(*) AS ended, count_if(action = 'failed') AS failed FROM e GROUP BY 1 HAVING count(*) >= 20 + batch_id % 20"""


@query("r3_job_state_stream", f"""WITH {_ACTIONS}, j AS (SELECT job_id, min(CASE WHEN action = 'claim' THEN ts END) AS c, min_by(action, ts) FILTER (action IN ('completed', 'failed')) AS f FROM a GROUP BY 1)
SELECT job_id, CASE WHEN c IS NOT NULL AND f IS NOT NULL THEN f ELSE 'processing' END AS state FROM j""")
def _(s, d):
    return R.run_available(R.job_state(_actions(_stream(s, d))).drop("claimed"), shared(s, "jobs"), "update", ["job_id"])


@query("r4_batch_progress", _PROGRESS)
def _(s, d):
    a = _actions(table(s, d, "events"))
    return R.batch_progress(a, a.select("batch_id").distinct().withColumn("total", 20 + F.col("batch_id") % 20))


@query("r4_batch_progress_stream", _PROGRESS)
def _(s, d):
    a = _actions(_stream(s, d)).withColumn("total", 20 + F.col("batch_id") % 20)
    return R.run_available(R.batch_progress_stream(a), shared(s, "batches"), "update", ["batch_id"])


@query("r4_batch_events_stream", f"""WITH {_ACTIONS}, e AS (SELECT DISTINCT batch_id, job_id, first_value(action) OVER (PARTITION BY batch_id, job_id ORDER BY ts) AS action FROM a WHERE action IN ('completed', 'failed')),
  n AS (SELECT batch_id, count(*) AS ended, count_if(action = 'failed') AS failed FROM e GROUP BY 1)
SELECT batch_id, 'batch.completed' AS event, ended, failed, CASE WHEN failed = 0 THEN 'completed' WHEN failed = ended THEN 'failed' ELSE 'partial' END AS status FROM n WHERE ended >= 20 + batch_id % 20""")
def _(s, d):
    a = _actions(_stream(s, d)).withColumn("total", 20 + F.col("batch_id") % 20)
    return R.run_available(T.batch_events(a), shared(s, "batches"), conf=T.STATE_STORE)


def _plain_times(df):
    """Times as the tables have them, without a zone."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name for f in df.schema))


_MARK = "w AS (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 10 MINUTE AS mark FROM events)"  # where a watermark of ten minutes stands at the end


@query("r3_job_states_stream", f"""WITH {_ACTIONS}, {_MARK}, j AS (SELECT job_id, min(CASE WHEN action = 'claim' THEN ts END) AS c, min_by(action, ts) FILTER (action IN ('completed', 'failed')) AS f, max(ts) AS last FROM a GROUP BY 1)
SELECT job_id, CASE WHEN c IS NOT NULL AND f IS NOT NULL THEN f ELSE 'processing' END AS state, c AS claimed FROM j
UNION ALL SELECT job_id, 'expired', c FROM j, w WHERE time_bucket(INTERVAL 1 MILLISECOND, last) + INTERVAL 1 HOUR <= mark""")
def _(s, d):
    return _plain_times(R.run_available(T.job_states(_actions(_stream(s, d))), shared(s, "jobs"), conf=T.STATE_STORE))


def _requests(df):
    return df.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("key"), "ts", F.get_json_object("props", "$.k").cast("long").alias("tokens"))


@query("r5_rate_windows", "SELECT user_id % 10 AS key, time_bucket(INTERVAL 60 SECOND, ts) AS start, count(*) AS n, greatest(count(*) - 1, 0) AS over FROM events GROUP BY 1, 2")
def _(s, d):
    return R.rate_windows(_requests(table(s, d, "events")), 1)


@query("r5_rate_verdicts", """WITH q AS (SELECT event_id AS id, user_id % 10 AS key, ts, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY key, e // 3600 ORDER BY ts, id) AS k FROM q)
SELECT id, key, k <= 1 AS allowed, CASE WHEN k > 1 THEN (e // 3600) * 3600 + 3600 - e END AS retry_after FROM n""")
def _(s, d):
    return R.rate_verdicts(_requests(table(s, d, "events")), 1, 3600)


@query("r6_failure_streaks", """WITH q AS (SELECT event_id AS id, user_id % 20 AS url, ts, event_type IN ('purchase', 'view') AS ok FROM events), r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY url ORDER BY ts, id) AS run FROM q),
  f AS (SELECT *, row_number() OVER (PARTITION BY url, run ORDER BY ts, id) AS n FROM r WHERE NOT ok)
SELECT url, min(ts) AS open_from, max(ts) + INTERVAL 300 SECOND AS open_to FROM f WHERE n >= 3 GROUP BY url, run""")
def _(s, d):
    q = table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("url"), "ts", F.col("event_type").isin("purchase", "view").alias("ok"))
    return R.failure_streaks(q, 3)


def _deliveries(df):
    return df.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("url"), "ts", F.col("event_type").isin("purchase", "view").alias("ok"))


def _circuits(until: str) -> str:
    """Circuits of three failures that close after two hours, row by row."""
    return f"""WITH RECURSIVE {_MARK}, q AS (SELECT user_id % 20 AS url, ts, event_type IN ('purchase', 'view') AS ok, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events, w WHERE {until}),
  f AS (SELECT url, n, ok, CASE WHEN ok THEN 0 ELSE 1 END AS count, NULL::TIMESTAMP AS since, ts AS last, NULL::TIMESTAMP AS a, NULL::TIMESTAMP AS b FROM q WHERE n = 1
    UNION ALL SELECT url, n, ok, CASE WHEN ok THEN 0 ELSE kept + 1 END, CASE WHEN kept + 1 = 3 THEN ts ELSE since END, ts,
      CASE WHEN cooled OR (ok AND kept >= 3) THEN since END, CASE WHEN cooled THEN last + INTERVAL 2 HOUR WHEN ok AND kept >= 3 THEN ts END
    FROM (SELECT q.*, f.since, f.last, f.count >= 3 AND q.ts >= f.last + INTERVAL 2 HOUR AS cooled, CASE WHEN f.count >= 3 AND q.ts >= f.last + INTERVAL 2 HOUR THEN 0 ELSE f.count END AS kept FROM f JOIN q ON q.url = f.url AND q.n = f.n + 1) x)
SELECT url, a AS open_from, b AS open_to FROM f WHERE a IS NOT NULL
UNION ALL SELECT url, since, last + INTERVAL 2 HOUR FROM f, w WHERE count >= 3 AND n = (SELECT max(n) FROM q WHERE q.url = f.url)"""


@query("r6_circuits", _circuits("true"))
def _(s, d):
    return _plain_times(T.circuits(_deliveries(table(s, d, "events")), 3, 7200))


@query("r6_circuits_stream", _circuits("ts <= mark") + " AND last + INTERVAL 2 HOUR <= mark")
def _(s, d):
    return _plain_times(R.run_available(T.circuit_stream(_deliveries(_stream(s, d)), 3, 7200), shared(s, "circuits"), conf=T.STATE_STORE))


@query("r7_retry_lineage", """WITH RECURSIVE j AS (SELECT o_orderkey AS job_id, CASE WHEN row_number() OVER w % 4 > 0 THEN lag(o_orderkey) OVER w END AS up FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  t AS (SELECT job_id, job_id AS root, 0 AS attempt FROM j WHERE up IS NULL UNION ALL SELECT j.job_id, t.root, t.attempt + 1 FROM j JOIN t ON j.up = t.job_id)
SELECT job_id, root, attempt, attempt = max(attempt) OVER (PARTITION BY root) AS latest FROM t""")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    j = table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.row_number().over(w) % 4 > 0, F.lag("o_orderkey").over(w)).alias("retried_from"))
    return R.retry_lineage(j)


def _packs(df):
    kind = F.col("event_type")
    act = F.when(kind == "click", "propose").when(kind == "purchase", "approve").when(kind == "error", "reject").when(kind == "view", "enable").otherwise("disable")
    return df.select((F.col("user_id") % 5).cast("string").alias("scope"), (F.col("user_id") % 7).cast("string").alias("owner"), F.col("event_id").alias("seq"), "ts", act.alias("action"), F.array(F.concat(F.lit("r"), F.col("event_id"))).alias("rules"))


def _packs_sql(source: str, seq: str) -> str:
    return f"""WITH a AS (SELECT CAST(user_id % 5 AS VARCHAR) AS scope, CAST(user_id % 7 AS VARCHAR) AS owner, {seq} AS seq, ['r' || event_id] AS r, CASE event_type WHEN 'click' THEN 'p' WHEN 'purchase' THEN 'a' WHEN 'error' THEN 'x' WHEN 'view' THEN 'e' ELSE 'd' END AS act FROM {source}),
  t AS (SELECT *, lag(act) OVER w AS pa, lag(r) OVER w AS pr FROM a WHERE act IN ('p', 'a', 'x') WINDOW w AS (PARTITION BY scope, owner ORDER BY seq)),
  b AS (SELECT scope, owner, min(seq) FILTER (act = 'p') AS begun, count_if(act = 'p') AS version FROM a GROUP BY 1, 2),
  ev AS (SELECT a.scope, a.owner, a.seq, a.act, t.pr FROM a JOIN b USING (scope, owner) LEFT JOIN t ON t.scope = a.scope AND t.owner = a.owner AND t.seq = a.seq WHERE a.seq >= begun AND (a.act <> 'a' OR t.pa = 'p')),
  f AS (SELECT scope, owner, arg_max(act, seq) AS last_act, max(seq) FILTER (act = 'a') AS approved_at, arg_max(pr, seq) FILTER (act = 'a') AS rules FROM ev GROUP BY 1, 2),
  l AS (SELECT scope, owner, arg_max(act, seq) AS last_turn, arg_max(r, seq) AS last_rules FROM t GROUP BY 1, 2),
  s AS (SELECT b.scope, b.owner, b.version, rules, last_turn, last_rules, CASE WHEN last_act IS NULL THEN 'none' WHEN last_act = 'p' THEN 'pending' WHEN last_act = 'a' THEN 'active' WHEN last_act = 'd' THEN 'disabled' WHEN approved_at IS NOT NULL THEN 'active' ELSE 'none' END AS status
    FROM b LEFT JOIN f ON f.scope = b.scope AND f.owner = b.owner LEFT JOIN l ON l.scope = b.scope AND l.owner = b.owner)
SELECT scope, owner, CASE WHEN status = 'active' THEN coalesce(rules, []) ELSE [] END AS rules, CASE WHEN last_turn = 'p' THEN last_rules ELSE [] END AS proposed, status, CAST(version AS INT) AS version FROM s"""


@query("r8_rule_pack_fold", _packs_sql("events", "event_id"))
def _(s, d):
    return R.rule_pack_fold(_packs(table(s, d, "events")).drop("ts"))


@query("r8_rule_packs_stream", _packs_sql(f"(WITH {_MARK} SELECT * FROM events, w WHERE ts <= mark)", "row_number() OVER (ORDER BY ts, event_id)"))
def _(s, d):
    return R.run_available(T.rule_packs(_packs(_stream(s, d))), shared(s, "packs"), key=["scope", "owner"], conf=T.STATE_STORE)


_DAYS = "SELECT CAST(ts AS DATE) AS day, count(*) AS jobs, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1"


@query("r9_usage", _DAYS)
def _(s, d):
    return R.usage_stream(_requests(table(s, d, "events")))


@query("r9_usage_stream", _DAYS)
def _(s, d):
    return R.run_available(R.usage_stream(_requests(_stream(s, d))), shared(s, "usage"), "update", ["day"])
