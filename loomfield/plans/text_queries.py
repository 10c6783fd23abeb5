"""Text and hygiene operators over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import text as T
from loomfield.operators import hygiene as H
from loomfield.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), '[\x{{E000}}-\x{{F8FF}}]', ' ', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '(?m)[\t \x{{A0}}\x{{202F}}\x{{3000}}]+$', '', 'g'), '^\s+|\s+$', '', 'g')"""


@query("t1_clean_text", f"SELECT doc_id, md5({_CLEAN.format(c='text')}) AS h, length({_CLEAN.format(c='text')}) AS n FROM documents")
def _(s, d):
    t = T.clean_text(F.col("text"))
    return docs(s, d).select("doc_id", F.md5(t).alias("h"), F.length(t).alias("n"))


@query("t1_clean_markup", f"SELECT page_id, md5({_CLEAN.format(c='html')}) AS h FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.clean_text(F.col("html"))).alias("h"))


@query("t2_text_quality_gate", r"""
WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents),
s AS (SELECT doc_id, body, regexp_replace(body, '[\s\x{A0}]', '', 'g') AS solid FROM b)
SELECT doc_id, length(body) < 120 OR len(regexp_extract_all(body, '\(cid:')) >= 5 OR length(solid) = 0
   OR length(regexp_replace(solid, '[^\p{L}\p{N}.,/\-:;()&''@]', '', 'g')) < 0.55 * length(solid)
   OR length(regexp_replace(solid, '[^\p{L}]', '', 'g')) < 0.40 * length(solid) AS low_quality
FROM s""")
def _(s, d):
    return docs(s, d).select("doc_id", T.low_quality(F.col("text")).alias("low_quality"))


@query("t3_anchor_emails", r"""
WITH e AS (SELECT doc_id, regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b') AS a,
           list_transform(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+ ?@ ?[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b'), lambda x: replace(x, ' ', '')) AS b FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS email FROM e)
SELECT DISTINCT doc_id, email FROM u""")
def _(s, d):
    return docs(s, d).select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


@query("t4_anchor_phones")
def _(s, d):
    return docs(s, d).select("doc_id", F.posexplode(T.phones(F.col("text"))).alias("pos", "phone"))


@query("t5_anchor_urls", r"""
WITH e AS (SELECT page_id, list_filter(regexp_extract_all(url || ' ' || html, '(?i)https?://[\w\-.]+\.[a-z]{2,}(?:/[\w\-._~:/?#\[\]@!$&''()*+,;=%]*)?'), lambda u: NOT contains(u, 'linkedin.com') AND NOT contains(u, 'github.com')) AS p FROM pages)
SELECT page_id, len(list_distinct(p)) AS n_portfolio, 0 AS n_linkedin, 0 AS n_github, p[1] AS first_url FROM e""")
def _(s, d):
    u = T.urls(F.concat_ws(" ", "url", "html"))
    return table(s, d, "pages").select(
        "page_id", F.size(u["portfolio"]).alias("n_portfolio"), F.size(u["linkedin"]).alias("n_linkedin"), F.size(u["github"]).alias("n_github"), F.try_element_at(u["portfolio"], F.lit(1)).alias("first_url")
    )


_KEY = r"trim(regexp_replace(regexp_replace(replace(lower(regexp_replace({c}, '[\x{{2013}}\x{{2014}}]', '-', 'g')), '&', ' and '), '\s*/\s*', '/', 'g'), '[\s\-]+', ' ', 'g'))"


@query("t6_match_key", f"SELECT p_partkey, {_KEY.format(c=chr(39).join(['p_name || ', ' & ', ' || p_type || ', ' / ', ' || p_brand']))} AS k FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.match_key(F.concat("p_name", F.lit(" & "), "p_type", F.lit(" / "), "p_brand")).alias("k"))


@query("t7_sanitize_contact", r"""
WITH c AS (SELECT c_custkey, ' ' || replace(c_name, '#', CASE WHEN c_custkey % 3 = 0 THEN '@x.' ELSE '@' END) || ' ' AS e, CASE c_custkey % 4 WHEN 0 THEN 'http://a.b/' || c_custkey WHEN 1 THEN 'x.org/' || c_custkey WHEN 2 THEN 'N/A' ELSE 'not given' END AS u, '(' || c_custkey || ') 234-567' AS p FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(lower(trim(e)), '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN lower(trim(e)) END AS email,
  CASE WHEN regexp_matches(trim(u), '(?i)^https?://') THEN trim(u) WHEN contains(trim(u), '.') AND NOT contains(trim(u), ' ') THEN 'https://' || trim(u) END AS url,
  CASE WHEN length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 THEN trim(p) END AS phone FROM c""")
def _(s, d):
    k = F.col("c_custkey")
    e = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.when(k % 3 == 0, "@x.").otherwise("@")), F.lit(" "))
    u = F.when(k % 4 == 0, F.concat(F.lit("http://a.b/"), k)).when(k % 4 == 1, F.concat(F.lit("x.org/"), k)).when(k % 4 == 2, "N/A").otherwise("not given")
    df = table(s, d, "customer").select("c_custkey", e.alias("email"), u.alias("url"), F.concat(F.lit("("), k, F.lit(") 234-567")).alias("phone"))
    return H.sanitize_contact(df, {"email": "email", "url": "url", "phone": "phone"})


@query("t8_sanitize_scalar", r"""
SELECT o_orderkey, CASE WHEN 1880 + o_orderkey % 200 BETWEEN 1900 AND 2035 THEN CAST(1880 + o_orderkey % 200 AS INT) END AS yr,
  CASE o_orderstatus WHEN 'F' THEN 'No' WHEN 'O' THEN 'Yes' ELSE 'N/A' END AS tri,
  greatest(0.0, least(1.0, o_totalprice / 300000.0)) AS conf, CAST(o_custkey AS VARCHAR) AS id FROM orders""")
def _(s, d):
    df = table(s, d, "orders").select(
        "o_orderkey", (F.lit(1880) + F.col("o_orderkey") % 200).cast("string").alias("yr"), F.when(F.col("o_orderstatus") == "F", " no ").when(F.col("o_orderstatus") == "O", "YES").otherwise("n/a").alias("tri"),
        (F.col("o_totalprice") / 300000.0).alias("conf"), F.col("o_custkey").alias("id"),
    )
    return H.sanitize_scalar(df, {"yr": "year", "tri": "tri", "conf": "confidence", "id": "id"})


def _dates(s, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 10
    f = lambda p: F.date_format(t, p)
    said = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy-M")).when(k == 2, f("M/d/yyyy")).when(k == 3, f("MM-dd-yy")).when(k == 4, f("M/yyyy"))
    said = said.when(k == 5, f("M/yy")).when(k == 6, f("yyyy")).when(k == 7, F.lit("02/30/1999")).when(k == 8, F.lit(" PRESENT ")).otherwise(F.lit("soon"))
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", said.alias("said"))


_DATES_SQL = r"""CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN strftime(o_orderdate, '%m/%Y') WHEN 5 THEN strftime(o_orderdate, '%m/%Y') WHEN 6 THEN strftime(o_orderdate, '%Y') WHEN 8 THEN 'Present' END"""


@query("t9_normalize_date", f"SELECT o_orderkey, {_DATES_SQL} AS norm FROM orders")
def _(s, d):
    return _dates(s, d).select("o_orderkey", T.normalize_date(F.col("said"), 2024).alias("norm"))


@query("t10_year_month", f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 IN (7, 8, 9) THEN NULL WHEN o_orderkey % 10 = 6 THEN year(o_orderdate) * 12 + 1 ELSE year(o_orderdate) * 12 + month(o_orderdate) END AS INT) AS months FROM orders")
def _(s, d):
    return _dates(s, d).select("o_orderkey", T.year_month(T.normalize_date(F.col("said"), 2024)).alias("months"))


@query("t11_dedup_phrase")
def _(s, d):
    df = table(s, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", "text").alias("text"))
    out = H.dedup_phrase(df, "text")
    return out.select("conv_id", "turn", F.md5("text").alias("h"), F.length("text").alias("n"))


@query("t12_tidy_raw", """
SELECT item_id, CASE WHEN len(ws) > 8 THEN regexp_replace(array_to_string(ws[1:8], ' '), '[ ,;:\\-]+$', '') || '…' ELSE array_to_string(ws, ' ') END AS raw
FROM (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM benchmark)""")
def _(s, d):
    return H.shorten(table(s, d, "benchmark").select("item_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("raw")), "raw", 8)


@query("t13_clean_list_items", r"""
SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[\n\x{2022}]'), lambda x: trim(regexp_replace(regexp_replace(x, '^\s*[-*]+\s*', ''), '\s+', ' ', 'g'))), lambda x: x <> '')) AS n_items FROM documents""")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(T.list_items(F.col("text"))).alias("n_items"))


_CREDS = ["RN", "BSN", "MSN", "CCRN"]


@query("t14_split_name_credentials", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 5 THEN 'Smith, Jane' ELSE split_part(c_name, '#', 1) END AS name, CASE c_custkey % 6 WHEN 0 THEN ['RN','BSN'] WHEN 1 THEN ['CCRN'] WHEN 2 THEN [] WHEN 3 THEN ['MSN'] WHEN 4 THEN ['BSN','RN'] ELSE ['RN'] END AS creds FROM customer""")
def _(s, d):
    k = F.col("c_custkey") % 6
    name = F.split_part("c_name", F.lit("#"), F.lit(1))
    said = F.when(k == 0, F.concat(name, F.lit(", RN, bsn"))).when(k == 1, F.concat(name, F.lit(" CCRN"))).when(k == 4, F.concat(name, F.lit(" RN, BSN"))).when(k == 5, "Smith, Jane RN").otherwise(name)
    df = table(s, d, "customer").select("c_custkey", said.alias("name"), F.when(k == 3, F.array(F.lit("MSN"))).otherwise(F.array().cast("array<string>")).alias("creds"))
    return H.split_name_credentials(df, "name", "creds", _CREDS)


@query("t15_canonical_case", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Machinery' WHEN 'BUILDING' THEN 'BUILDING' ELSE lower(c_mktsegment) END AS seg FROM customer")
def _(s, d):
    df = table(s, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("seg"))
    return H.canonical_case(df, "seg", upper=["building"], special={"machinery": "Machinery"})


@query("t16_map_degree", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Bachelor of Science in Nursing' WHEN 'O' THEN 'Associate Degree in Nursing' END AS degree,
  CASE o_orderstatus WHEN 'F' THEN 'BSN' WHEN 'O' THEN 'ADN' END AS tier, o_orderkey % 5 = 0 AS in_progress FROM orders""")
def _(s, d):
    st = F.col("o_orderstatus")
    said = F.concat(F.when(st == "F", "B.S.N.").when(st == "O", "adn").otherwise("trade school"), F.when(F.col("o_orderkey") % 5 == 0, " (in progress)").otherwise(""))
    aliases = s.createDataFrame([("bsn", "Bachelor of Science in Nursing", "BSN"), ("adn", "Associate Degree in Nursing", "ADN")], "alias string, degree string, tier string")
    return H.map_degree(table(s, d, "orders").select("o_orderkey", said.alias("said")), "said", aliases).drop("said")


@query("t17_expand_role", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'First Brand' WHEN p_brand = 'Brand#12' THEN 'Second Brand' ELSE p_brand END || ' - ' || p_type AS role FROM part""")
def _(s, d):
    terms = s.createDataFrame([("brand#11", "First Brand"), ("brand#12", "Second Brand")], "key string, canonical string")
    return H.expand_role(table(s, d, "part").select("p_partkey", F.concat_ws(" - ", "p_brand", "p_type").alias("role")), "role", terms)


@query("t18_backfill_fields", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 > 0 THEN o_orderstatus END, 'clerk') AS role, CASE WHEN o_orderkey % 4 = 0 THEN true END AS trauma FROM orders""")
def _(s, d):
    k = F.col("o_orderkey")
    df = table(s, d, "orders").select("o_orderkey", F.when(k % 3 > 0, F.col("o_orderpriority")).alias("role"), F.when(k % 2 > 0, F.col("o_orderstatus")).alias("profession"), F.lit("clerk").alias("agency"), F.when(k % 4 == 0, "II").alias("level"), F.lit(None).cast("boolean").alias("trauma"))
    return H.backfill_fields(df, {"role": ["profession", "agency"]}, {"trauma": "level"}).select("o_orderkey", "role", "trauma")


@query("t19_split_address", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'Rue de ' || c_custkey || ', Paris' ELSE c_custkey || ' Main St' END AS street, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'Town ' || c_nationkey END AS city,
  CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'TX' END AS state, CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 1 THEN '75001' ELSE NULL END AS zip FROM customer""")
def _(s, d):
    k = F.col("c_custkey")
    line = F.when(k % 3 == 2, F.concat(F.lit("Rue de "), k, F.lit(", Paris"))).otherwise(F.concat(k, F.lit(" Main St, Town "), F.col("c_nationkey"), F.when(k % 3 == 1, ", TX 75001").otherwise(", TX")))
    return H.split_address(table(s, d, "customer").select("c_custkey", line.alias("street")), "street", ["TX", "CA"])


@query("t20_infer_country", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Canada' WHEN c_custkey % 4 IN (1, 2) THEN 'United States' END AS country FROM customer")
def _(s, d):
    k = F.col("c_custkey") % 4
    df = table(s, d, "customer").select("c_custkey", F.when(k == 0, "Canada").otherwise(" ").alias("country"), F.when(k == 1, "tx").alias("state"), F.when(k == 2, "Austin, TX 75001").otherwise("x").alias("location"))
    return H.infer_country(df, ["TX", "CA"], "United States").select("c_custkey", "country")


@query("t21_extract_count", r"SELECT doc_id, TRY_CAST(replace(regexp_extract(text, '([0-9][0-9,]{0,8})', 1), ',', '') AS BIGINT) AS n FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.replace(F.regexp_extract("text", r"([0-9][0-9,]{0,8})", 1), F.lit(","), F.lit("")).try_cast("long").alias("n"))


@query("t22_classify_text", r"SELECT p_partkey, CASE WHEN regexp_matches(p_name || ' ' || p_type, '(?i)\bpromo') THEN 'promo' WHEN regexp_matches(p_name || ' ' || p_type, '(?i)\bstandard') THEN 'standard' WHEN regexp_matches(p_name || ' ' || p_type, '(?i)steel|large') THEN 'metal' END AS label FROM part")
def _(s, d):
    rules = [("promo", r"(?i)\bpromo"), ("standard", r"(?i)\bstandard"), ("metal", "(?i)steel|large")]
    return table(s, d, "part").select("p_partkey", T.classify([F.col("p_name"), F.col("p_type")], rules).alias("label"))


@query("t23_route_rows", r"""
SELECT o_orderkey, regexp_matches(o_orderpriority, '(?i)urgent|high') AS routed, CASE WHEN regexp_matches(o_orderpriority, '(?i)urgent|high') THEN CAST(regexp_extract(o_orderpriority, '([0-9]+)', 1) AS BIGINT) END AS hours FROM orders""")
def _(s, d):
    kept, routed = H.route_rows(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "(?i)urgent|high", ["o_orderpriority"], r"([0-9]+)")
    return kept.select("o_orderkey", F.lit(False).alias("routed"), F.lit(None).cast("long").alias("hours")).unionByName(routed.select("o_orderkey", F.lit(True).alias("routed"), "hours"))


@query("t24_scan_flags", r"""
SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN true END AS has_password, CASE WHEN contains(lower(text), 'license') THEN true END AS has_license,
  NOT contains(lower(text), '@') OR coalesce(NOT contains(lower(text), 'license'), true) AS risk FROM documents""")
def _(s, d):
    df = docs(s, d).select("doc_id", F.lower("text").alias("t"), F.when(F.lower("text").contains("@"), F.array(F.lit("@"))).otherwise(F.array().cast("array<string>")).alias("certs"))
    return H.scan_flags(df, "t", {"has_password": ["password"], "has_license": ["license"]}, "certs", ["@"], "has_license").select("doc_id", "has_password", "has_license", "risk")


@query("t25_expiry_warnings", """
WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_returnflag || l_linestatus AS name FROM lineitem WHERE l_returnflag || l_linestatus IN ('AF', 'RF', 'NO') AND l_quantity <= 25)
SELECT doc_id, 'No expiry date for: ' || string_agg(name, ', ' ORDER BY pos, name) AS warning FROM c GROUP BY doc_id""")
def _(s, d):
    expiry = F.when(F.col("l_quantity") > 25, F.col("l_shipdate").cast("string")).when(F.col("l_quantity") > 10, " ")
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("name"), expiry.alias("expiry"))
    return H.expiry_warnings(li, ["AF", "RF", "NO"])


@query("t26_name_email_mismatch", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'The address continues the surname: review the name.' END AS warning FROM customer""")
def _(s, d):
    df = table(s, d, "customer").select("c_custkey", F.lit("Ann Carter").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "ann.cartersmith@x.org").otherwise("ann.carter@x.org").alias("email"))
    return H.name_email_mismatch(df, "name", "email").select("c_custkey", "warning")


@query("t27_quality_warnings", """
SELECT doc_id, list_filter([CASE WHEN doc_id % 3 = 0 AND NOT contains(text, '@') THEN 'read by OCR, no email found' END, CASE WHEN length(text) > 20000 THEN 'text was cut' END], lambda x: x IS NOT NULL) AS warnings FROM documents""")
def _(s, d):
    df = docs(s, d).select("doc_id", (F.col("doc_id") % 3 == 0).alias("ocr_used"), F.lit(False).alias("partial"), F.col("text").contains("@").alias("has_email"), F.length("text").alias("n_chars"))
    return H.quality_warnings(df, 20000).select("doc_id", "warnings")


@query("t28_note_confidence", "SELECT event_id, CASE WHEN value < 10 AND event_id % 2 = 0 THEN 0.9 WHEN value < 10 THEN 0.7 ELSE value END AS confidence FROM events")
def _(s, d):
    df = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 > 0, F.col("event_type")).alias("value"), F.when(F.col("value") < 10, 0.0).otherwise(F.col("value")).alias("confidence"))
    return H.note_confidence(df).select("event_id", "confidence")


@query("t29_is_current_sync", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 8 THEN true ELSE false END AS is_current FROM orders")
def _(s, d):
    df = _dates(s, d).select("o_orderkey", T.normalize_date(F.col("said"), 2024).alias("end_date"), F.lit(False).alias("is_current"))
    return H.is_current_sync(df).select("o_orderkey", "is_current")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clean, gate and anchor all documents, then profile them by language and source."""
    t = F.col("t")
    df = docs(spark, d).select("lang", "source", T.clean_text(F.col("text")).alias("t"))
    df = df.select("lang", "source", T.low_quality(t).alias("low"), T.emails(t).alias("emails"), T.phones(t).alias("phones"))
    return df.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("low").alias("low_quality"), F.count_if(F.size("emails") > 0).alias("with_email"),
        F.count_if(F.size("phones") > 0).alias("with_phone"), F.sum(F.size("emails") + F.size("phones")).alias("anchors"),
    )


QUERIES["document_profile"] = flagship


@query("t13_clean_names", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Unknown' ELSE p_name END AS name FROM part")
def _(s, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    said = F.when(k % 5 == 0, F.when(k % 2 == 0, ' "}], ')).when(k % 5 == 1, F.concat(n, F.lit('"}],'))).when(k % 5 == 2, F.concat(F.lit("['"), n, F.lit("' "))).otherwise(n)
    return table(s, d, "part").select("p_partkey", H.clean_name(said).alias("name"))


@query("t16_progress_flag", "SELECT o_orderkey, o_orderkey % 6 < 4 AS in_progress FROM orders")
def _(s, d):
    k = F.col("o_orderkey") % 6
    marks = {"degree": F.when(k == 0, "BSN (In-Progress)").otherwise("BSN"), "field": F.when(k == 1, "currently enrolled").when(k == 4, "unexpectedly candidated"), "location": F.when(k == 2, "expected 2030").otherwise(" ")}
    return H.progress_flag(table(s, d, "orders").select("o_orderkey", *(v.alias(c) for c, v in marks.items()), F.when(k == 3, True).alias("in_progress")), list(marks)).select("o_orderkey", "in_progress")


@query("t17_expand_title", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Registered Nurse - Intensive Care' WHEN 1 THEN 'Registered Nurse - ' || p_type WHEN 2 THEN 'Lead - Intensive Care' WHEN 3 THEN 'Registered Nurse' WHEN 4 THEN 'Registered Nurse ' || chr(8211) || ' ' || p_type WHEN 5 THEN 'Charge nurse' ELSE 'Registered Nurse - a-b' END AS role FROM part""")
def _(s, d):
    k = F.col("p_partkey") % 7
    said = F.when(k == 0, "RN - icu").when(k == 1, F.concat(F.lit("rn "), "p_type")).when(k == 2, "Lead/ICU").when(k == 3, " RN ").when(k == 4, F.concat(F.lit("RN \u2013 "), "p_type")).when(k == 5, "Charge nurse").otherwise("rn, a-b")
    one = s.createDataFrame([("RN", "Registered Nurse")], "key string, canonical string")
    terms = s.createDataFrame([(1, "icu", "Intensive Care")], "priority int, key string, canonical string")
    return H.expand_title(table(s, d, "part").select("p_partkey", said.alias("role")), "role", one, terms)


@query("t19_refine_location", """SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN c_custkey || ' Main St, Suite 300' WHEN 2 THEN 'Rue de ' || c_custkey || ', Paris' WHEN 4 THEN NULL ELSE c_custkey || ' Main St' END AS location,
  CASE WHEN c_custkey % 5 = 0 THEN 'Old' WHEN c_custkey % 6 IN (2, 5) THEN NULL WHEN c_custkey % 6 = 1 THEN 'Town' || c_nationkey ELSE 'Town ' || c_nationkey END AS city, CASE WHEN c_custkey % 6 <> 2 THEN 'TX' END AS state, CASE WHEN c_custkey % 6 IN (0, 3) THEN '75001' END AS zip FROM customer""")
def _(s, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    home = F.concat(k, F.lit(" Main St"))
    line = (
        F.when(k % 6 == 0, F.concat(home, F.lit(", Town "), n, F.lit(", tx 75001"))).when(k % 6 == 1, F.concat(home, F.lit(", Suite 300 Town"), n, F.lit(", TX"))).when(k % 6 == 2, F.concat(F.lit("Rue de "), k, F.lit(", Paris")))
        .when(k % 6 == 3, F.concat(home, F.lit(" ,Town "), n, F.lit(", TX, 75001"))).when(k % 6 == 4, F.concat(F.lit("Town "), n, F.lit(", TX"))).otherwise(F.concat(home, F.lit(", TX")))
    )
    rows = table(s, d, "customer").select("c_custkey", line.alias("location"), F.when(k % 5 == 0, "Old").otherwise(" ").alias("city"), F.lit("").alias("state"), F.lit(None).cast("string").alias("zip"))
    return H.refine_location(rows, "location", ["TX", "CA"], ["st", "street", "suite", "road"])


@query("t22_classify_unset", r"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'set' WHEN o_orderkey % 4 = 0 THEN 'PRN' WHEN o_orderkey % 4 = 1 THEN 'Part-time' WHEN o_orderkey % 4 = 2 THEN 'Full-time' END AS kind FROM orders""")
def _(s, d):
    k = F.col("o_orderkey")
    role = F.when(k % 4 == 0, "per-diem, part time").when(k % 4 == 1, "full").when(k % 4 == 2, "full time")
    rows = table(s, d, "orders").select(k, F.when(k % 7 == 0, "set").otherwise(" ").alias("kind"), role.alias("role"), F.when(k % 4 == 1, "Part  time").alias("note"))
    rules = [("PRN", r"(?i)\b(prn|per[\s-]*diem)\b"), ("Part-time", r"(?i)\bpart[\s-]*time\b"), ("Full-time", r"(?i)\bfull[\s-]*time\b")]
    return H.classify_unset(rows, "kind", ["role", "note"], rules).select("o_orderkey", "kind")
