"""Scores of extracted records against labels: nine metrics, as hits and misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def folded(c: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def _anchor(key: Column) -> Column:
    """What a text that holds the key must hold: the key's first GRAM characters, the
    first one of a shorter key."""
    return F.when(F.length(key) >= GRAM, F.substring(key, 1, GRAM)).otherwise(F.substring(key, 1, 1))


def _grams(text: Column) -> Column:
    """The GRAMs of a text and its characters."""
    n = F.length(text)
    last = F.when(n >= GRAM, F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(last, lambda i: F.substring(text, i, F.lit(GRAM))), F.split(text, ""))


def find_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, text_pos, key_pos) where a text (doc_id, text_pos, text) holds a key
    (doc_id, key_pos, key) of its document as a substring. Not every pair is compared:
    each key is posted under one anchor, a text is looked up under those of its grams
    that are anchors in its document, and what meets there is compared whole. Empty keys
    are in no text here."""
    posted = keys.filter("key != ''").select("doc_id", "key_pos", "key", _anchor(F.col("key")).alias("anchor"))
    anchors = posted.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    looked = texts.join(anchors, "doc_id").select("doc_id", "text_pos", "text", F.explode(F.array_intersect(_grams(F.col("text")), F.col("anchors"))).alias("anchor"))
    return looked.join(posted, ["doc_id", "anchor"]).filter(F.contains("text", "key")).select("doc_id", "text_pos", "key_pos")


def score_records(outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, metric, hit, miss), a row for each metric that a label states.

    outputs: doc_id, personal (full_name, email, phone, phone_secondary, credentials[]),
    experience[] (company, role, start_date, end_date, city_id, state_id,
    specialties[] (specialty_id)), education[] (institution). labels: doc_id, personal
    (full_name, email, phone_digits, credentials[]), experience[] (company_key,
    start_date, end_date, catalog_city, state_id), education_keys[], negatives
    (no_phone_secondary_digits[], no_specialty_id[]). One row a document on both sides;
    null and empty say nothing. A document without output misses what its label states.

    A label's role is the first output role whose company or title holds its key; dates,
    cities and states are judged on found roles only. Precision is over output rows: one
    is expected that holds any key. Negatives hit where the value does not appear.
    """
    said = labels.select("doc_id", F.col("personal").alias("want"), F.col("education_keys"), F.col("negatives"))
    got = outputs.select("doc_id", F.col("personal").alias("have"), F.col("experience").alias("rows"), F.lit(True).alias("there"))
    both = said.join(got, "doc_id", "left")
    plain = [*_contacts(), *_negatives()]
    whole = both.select("doc_id", F.explode(F.concat(*plain)).alias("x")).select("doc_id", "x.metric", "x.ok")

    roles = labels.select("doc_id", F.posexplode("experience").alias("key_pos", "er")).withColumn("key", folded(F.col("er.company_key")))
    own = outputs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = own.select("doc_id", F.posexplode("experience").alias("text_pos", "ar"))
    rows = rows.withColumns({"company": folded(F.col("ar.company")), "title": folded(F.col("ar.role"))}).withColumn("text", F.concat("company", F.lit(" || "), "title"))
    met = find_keys(rows, roles)
    met = met.join(rows.select("doc_id", "text_pos", "company", "title"), ["doc_id", "text_pos"]).join(roles.select("doc_id", "key_pos", "key"), ["doc_id", "key_pos"])
    held = met.filter(F.contains("company", "key") | F.contains("title", "key"))
    first = held.groupBy("doc_id", "key_pos").agg(F.min("text_pos").alias("text_pos"))
    found = roles.join(first, ["doc_id", "key_pos"], "left").join(rows.select("doc_id", "text_pos", "ar"), ["doc_id", "text_pos"], "left")
    judged = found.select("doc_id", F.explode(_on_role()).alias("x")).filter("x.ok is not null").select("doc_id", "x.metric", "x.ok")

    # an empty key is in every row's text, though it finds no role
    bare = roles.filter("key = ''").select("doc_id", F.lit(True).alias("bare")).distinct()
    known = met.select("doc_id", "text_pos", F.lit(True).alias("known")).distinct()
    exact = rows.select("doc_id", "text_pos").join(known, ["doc_id", "text_pos"], "left").join(bare, "doc_id", "left")
    exact = exact.select("doc_id", F.lit("role_precision").alias("metric"), F.coalesce("known", "bare", F.lit(False)).alias("ok"))

    keys = labels.select("doc_id", F.posexplode("education_keys").alias("key_pos", "key")).withColumn("key", folded(F.col("key")))
    schools = own.select("doc_id", F.posexplode("education").alias("text_pos", "e")).select("doc_id", "text_pos", folded(F.col("e.institution")).alias("text"))
    named = find_keys(schools, keys).select("doc_id", "key_pos").distinct().withColumn("named", F.lit(True))
    some = schools.select("doc_id").distinct().withColumn("some", F.lit(True))
    taught = keys.join(named, ["doc_id", "key_pos"], "left").join(some, "doc_id", "left")
    taught = taught.select("doc_id", F.lit("education").alias("metric"), F.coalesce("named", (F.col("key") == "") & F.col("some"), F.lit(False)).alias("ok"))

    every = whole.unionByName(judged).unionByName(exact).unionByName(taught)
    return every.groupBy("doc_id", "metric").agg(F.count_if("ok").alias("hit"), F.count_if(~F.col("ok")).alias("miss"))


def _one(metric: str, ok: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), F.coalesce(ok, F.lit(False)).alias("ok"))


def _each(metric: str, items: Column, ok) -> Column:
    items = F.coalesce(items, F.array().cast("array<string>"))
    return F.transform(items, lambda x: _one(metric, ok(x)))


def _contacts() -> list[Column]:
    none = F.array().cast("array<struct<metric:string,ok:boolean>>")
    same = lambda f: folded(F.col(f"have.{f}")) == folded(F.col(f"want.{f}"))
    tests = {"full_name": same("full_name"), "email": same("email"), "phone_digits": digits(F.col("have.phone")) == F.col("want.phone_digits")}
    out = [F.when(F.col(f"want.{f}").isNotNull(), F.array(_one("contact", ok))).otherwise(none) for f, ok in tests.items()]
    have = F.transform(F.coalesce("have.credentials", F.array().cast("array<string>")), folded)
    return [*out, _each("credentials", F.col("want.credentials"), lambda x: F.array_contains(have, folded(x)))]


def _negatives() -> list[Column]:
    second = digits(F.col("have.phone_secondary"))
    ids = F.flatten(F.transform("rows", lambda r: F.coalesce(r["specialties"]["specialty_id"].cast("array<string>"), F.array().cast("array<string>"))))
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    return [
        _each("negatives", F.col("negatives.no_phone_secondary_digits"), lambda x: second != x),
        _each("negatives", F.col("negatives.no_specialty_id").cast("array<string>"), lambda x: ~F.exists(ids, lambda i: F.coalesce(i == x, F.lit(False)))),
    ]


def _on_role() -> Column:
    """What a label's role states, judged on the row that it found; ok is null where
    nothing is stated or no row was found."""
    there = F.col("text_pos").isNotNull()
    judge = lambda metric, stated, ok: F.struct(F.lit(metric).alias("metric"), F.when(there & stated, F.coalesce(ok, F.lit(False))).alias("ok"))
    date = lambda f: judge("date_accuracy", F.col(f"er.{f}").isNotNull(), folded(F.col(f"ar.{f}")) == folded(F.col(f"er.{f}")))
    return F.array(
        F.struct(F.lit("role_recall").alias("metric"), there.alias("ok")), date("start_date"), date("end_date"),
        judge("city_resolution", F.coalesce(F.col("er.catalog_city"), F.lit(False)), F.col("ar.city_id").isNotNull()),
        judge("geo_ids", F.col("er.state_id").isNotNull(), F.col("ar.state_id").cast("string") == F.col("er.state_id").cast("string")),
    )
