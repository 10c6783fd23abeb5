"""Field hygiene: DataFrame in, DataFrame out, no row lost unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import text as T
from loomfield.functions.udfs import drop_repeated_phrases
from loomfield.operators.resolve import resolve_term


def sanitize_contact(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: T.contact(F.col(c), k) for c, k in kinds.items()})


def sanitize_scalar(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: T.scalar(F.col(c), k) for c, k in kinds.items()})


def dedup_phrase(df: DataFrame, col: str) -> DataFrame:
    """One blank between words, adjacent repeats of a run gone until none is left, then
    later repeats of phrases of two to six words."""
    return df.withColumn(col, drop_repeated_phrases(F.col(col)))


def shorten(df: DataFrame, col: str, most: int = 8) -> DataFrame:
    words = F.split(col, " ")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), r"[ ,;:\-]+$", ""), F.lit("…"))
    return df.withColumn(col, F.when(F.size(words) > most, cut).otherwise(F.col(col)))


def tidy_raw(df: DataFrame, col: str, most: int = 8) -> DataFrame:
    return shorten(dedup_phrase(df, col), col, most)


def split_name_credentials(df: DataFrame, name: str, creds: str, known: list[str]) -> DataFrame:
    """Credentials after the name go to the list: all that follow the first comma if all
    are known, then the known words that end what is before it, or the whole (one word
    stays). The list keeps its order, each credential once in any case."""
    norm = lambda x: F.upper(F.regexp_replace(F.trim(x), r"^\.+|[.,]+$", ""))
    dictionary = F.array(*[F.lit(k.upper()) for k in known])
    said = lambda x: F.array_contains(dictionary, norm(x))
    n = F.trim(F.col(name))
    tail = F.filter(F.split(F.regexp_extract(n, r"^[^,]*,(.*)$", 1), r"[,\s]+"), lambda x: x != "")
    by_comma = (F.size(tail) > 0) & F.forall(tail, said)
    rows = df.withColumns({"_tail": F.when(by_comma, tail).otherwise(F.array().cast("array<string>")), "_words": F.split(F.trim(F.when(by_comma, F.regexp_extract(n, r"^([^,]*),", 1)).otherwise(n)), r"\s+")})
    # how many words from the end are known: the place of the first other one, read backwards
    other = F.array_position(F.transform(F.reverse("_words"), lambda x: (~said(x)).cast("int")), 1)
    run = F.least(F.when(other > 0, other - 1).otherwise(F.size("_words")), F.size("_words") - 1).cast("int")
    rows = rows.withColumn("_run", run)
    left = F.array_join(F.slice("_words", F.lit(1), F.size("_words") - F.col("_run")), " ")
    ended = F.slice("_words", F.size("_words") - F.col("_run") + 1, F.col("_run"))
    every = F.concat(F.coalesce(F.col(creds), F.array().cast("array<string>")), F.col("_tail"), ended)
    tidy = F.regexp_replace(left, r"^[ ,]+|[ ,]+$", "")
    return rows.withColumns({creds: F.array_distinct(F.transform(every, norm)), name: F.when(tidy != "", tidy).otherwise(n)}).drop("_tail", "_words", "_run")


def canonical_case(df: DataFrame, col: str, upper: list[str], special: dict[str, str]) -> DataFrame:
    key = F.lower(F.trim(F.col(col)))
    out = F.when(key.isin([u.lower() for u in upper]), F.upper(F.trim(F.col(col))))
    for k, v in special.items():
        out = out.when(key == k.lower(), v)
    return df.withColumn(col, out.otherwise(F.col(col)))


def map_degree(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """aliases (alias, degree, tier); dots and marks of progress don't count. Unknown:
    null degree and tier."""
    going = F.col(col).rlike(r"(?i)in progress|expected|pursuing|candidate|ongoing")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"\(.*?\)", " "), r"\.", ""))
    return df.withColumns({"in_progress": F.coalesce(going, F.lit(False)), "_k": key}).join(aliases.withColumnRenamed("alias", "_k"), "_k", "left").drop("_k")


def expand_role(df: DataFrame, col: str, terms: DataFrame) -> DataFrame:
    """Head and tail about the first dash, slash or comma, each by its term if it has
    one; the separator stays."""
    p = r"^(.*?)(\s+[-–—]\s+|\s*[/,]\s*)(.*)$"
    split = F.col(col).rlike(p)
    parts = {"_h": F.when(split, F.regexp_extract(col, p, 1)).otherwise(F.col(col)), "_s": F.when(split, F.regexp_extract(col, p, 2)).otherwise(""), "_t": F.when(split, F.regexp_extract(col, p, 3)).otherwise("")}
    df = df.withColumns(parts).withColumns({"_hk": F.lower(F.trim("_h")), "_tk": F.lower(F.trim("_t"))})
    head = terms.select(F.col("key").alias("_hk"), F.col("canonical").alias("_hc"))
    tail = terms.select(F.col("key").alias("_tk"), F.col("canonical").alias("_tc"))
    df = df.join(head, "_hk", "left").join(tail, "_tk", "left")
    return df.withColumn(col, F.concat(F.coalesce("_hc", "_h"), "_s", F.coalesce("_tc", "_t"))).drop("_h", "_s", "_t", "_hk", "_tk", "_hc", "_tc")


def backfill_fields(df: DataFrame, sources: dict[str, list[str]], flags: dict[str, str]) -> DataFrame:
    """Blank fields from the first filled source; flags true where their field is
    filled; nothing is overridden."""
    fill = {c: F.coalesce(*(T.blank_null(F.col(x)) for x in (c, *rest))) for c, rest in sources.items()}
    return df.withColumns(fill).withColumns({c: F.coalesce(F.col(c), F.when(T.blank_null(F.col(x)).isNotNull(), True)) for c, x in flags.items()})


def split_address(df: DataFrame, col: str, states: list[str]) -> DataFrame:
    """Only an unambiguous `street, city, ST [zip]` comes apart."""
    p = r"^(.+),\s*([^,]+),\s*([A-Za-z]{2})(?:\s+([0-9]{5}(?:-[0-9]{4})?))?$"
    ok = F.col(col).rlike(p) & F.upper(F.regexp_extract(col, p, 3)).isin(states)
    part = lambda i: F.when(ok, F.nullif(F.trim(F.regexp_extract(col, p, i)), F.lit("")))
    return df.withColumns({"city": part(2), "state": F.upper(part(3)), "zip": part(4), col: F.coalesce(part(1), F.col(col))})


def infer_country(df: DataFrame, states: list[str], country: str) -> DataFrame:
    """A blank country from a known state, or from `, ST 12345` in the location."""
    codes = "|".join(states)
    known = F.upper(F.trim("state")).isin(states) | F.col("location").rlike(rf",\s*({codes})\s+[0-9]{{5}}")
    return df.withColumn("country", F.coalesce(T.blank_null(F.col("country")), F.when(known, country)))


def route_rows(df: DataFrame, pattern: str, cols: list[str], hours: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows routed away with the number their first field states)."""
    hit = F.coalesce(F.concat_ws(" ", *cols).rlike(pattern), F.lit(False))
    said = F.coalesce(*(F.regexp_extract(c, hours, 1).try_cast("long") for c in cols))
    return df.filter(~hit), df.filter(hit).withColumn("hours", said)


def scan_flags(df: DataFrame, col: str, flags: dict[str, list[str]], certs: str, needed: list[str], must: str) -> DataFrame:
    """True or null for each flag's words; risk where no needed certificate is there or
    the flag `must` isn't true."""
    hit = lambda words: [F.col(col).contains(w) for w in words]
    out = df.withColumns({f: F.when(F.greatest(*h) if len(h := hit(ws)) > 1 else h[0], True) for f, ws in flags.items()})
    has = F.arrays_overlap(certs, F.array(*map(F.lit, needed)))
    return out.withColumn("risk", ~has | ~F.coalesce(must, F.lit(False)))


def expiry_warnings(certs: DataFrame, tracked: list[str]) -> DataFrame:
    """certs (doc_id, pos, name, expiry) to one warning a document."""
    rows = certs.filter(F.col("name").isin(tracked) & T.blank_null(F.col("expiry")).isNull())
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return rows.groupBy("doc_id").agg(F.concat(F.lit("No expiry date for: "), F.array_join(names, ", ")).alias("warning"))


def name_email_mismatch(df: DataFrame, name: str, email: str) -> DataFrame:
    """Warns where the address goes on after the surname with four letters or more that
    are no other part of the name."""
    words = F.transform(F.split(F.lower(F.trim(F.col(name))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    last = F.element_at(words, -1)
    local = F.regexp_replace(F.lower(F.split_part(F.col(email), F.lit("@"), F.lit(1))), "[^a-z]", "")
    at = F.position(last, local)
    rest = F.substr(local, at + F.length(last), F.length(local))
    odd = (F.length(last) >= 3) & (at > 0) & (F.length(rest) >= 4) & ~F.array_contains(words, rest)
    return df.withColumn("warning", F.when(odd, "The address continues the surname: review the name."))


def quality_warnings(df: DataFrame, most: int = 60000) -> DataFrame:
    ocr = F.when(F.col("ocr_used") & ~F.col("partial") & ~F.col("has_email"), "read by OCR, no email found")
    cut = F.when(F.col("n_chars") > most, "text was cut")
    return df.withColumn("warnings", F.array_compact(F.array(ocr, cut)))


def note_confidence(df: DataFrame) -> DataFrame:
    guess = F.when(F.col("value").isNull(), 0.9).otherwise(0.7)
    return df.withColumn("confidence", F.when(F.col("confidence") == 0, guess).otherwise(F.col("confidence")))


def is_current_sync(df: DataFrame) -> DataFrame:
    return df.withColumn("is_current", F.coalesce(F.col("end_date") == "Present", F.lit(False)) | F.coalesce("is_current", F.lit(False)))


#: Marks of something still going on.
PROGRESS = r"(?i)\b(in[\s-]?progress|current(?:ly)?\s+(?:student|enrolled)|candidate|pursuing|expected|anticipated|ongoing|to be completed)\b"


def progress_flag(df: DataFrame, cols: list[str], out: str = "in_progress", pattern: str = PROGRESS) -> DataFrame:
    """The flag where it is true already, or where a mark of progress stands in any of
    the columns; never unset."""
    said = F.concat_ws(" ", *(T.blank_null(F.col(c)) for c in cols)).rlike(pattern)
    before = F.coalesce(F.col(out), F.lit(False)) if out in df.columns else F.lit(False)
    return df.withColumn(out, before | F.coalesce(said, F.lit(False)))


def classify_unset(df: DataFrame, out: str, cols: list[str], rules: list[tuple[str, str]]) -> DataFrame:
    """The label of the first pattern that the filled columns match, where `out` is blank."""
    return df.withColumn(out, F.coalesce(T.blank_null(F.col(out)), T.classify([T.blank_null(F.col(c)) for c in cols], rules)))


def clean_name(c: Column, default: str = "Unknown") -> Column:
    """A name without the quotes, braces, brackets and commas of JSON around it."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"""^[\s"'{}\[\],]+|[\s"'{}\[\],]+$""", ""), F.lit("")), F.lit(default))


def expand_title(df: DataFrame, col: str, credentials: DataFrame, terms: DataFrame) -> DataFrame:
    """A title parted at its first dash, slash or comma, or else after a first word that
    is a credential: the head by credentials (key, canonical), the tail by the term
    dictionary (priority, key, canonical), both as they are where unknown; joined by a
    dash, a long one where the title has one."""
    mark = r"^([^\-\u2013/,]*?)\s*[-\u2013/,]\s*(.*)$"
    t = F.trim(F.col(col))
    parted = F.regexp_extract(t, mark, 2) != ""
    bare = F.regexp_replace(t, r"\s*[-\u2013/,]\s*$", "")
    first = F.substring_index(bare, " ", 1)
    known = credentials.groupBy(F.lower(F.trim("key")).alias("_hk")).agg(F.min("canonical").alias("_hc"))
    rows = df.withColumns({"_t": t, "_parted": parted, "_bare": bare, "_first": first})
    rows = rows.join(known.withColumnsRenamed({"_hk": "_fk", "_hc": "_fc"}), F.lower("_first") == F.col("_fk"), "left")
    spaced = ~F.col("_parted") & F.col("_bare").contains(" ") & F.col("_fc").isNotNull()
    head = F.when(F.col("_parted"), F.trim(F.regexp_extract("_t", mark, 1))).when(spaced, F.col("_first")).otherwise(F.col("_bare"))
    tail = F.when(F.col("_parted"), F.trim(F.regexp_extract("_t", mark, 2))).when(spaced, F.trim(F.expr("substring(_bare, length(_first) + 1)")))
    rows = rows.withColumns({"_head": head, "_tail": tail}).join(known, F.lower("_head") == F.col("_hk"), "left")
    rows = resolve_term(rows, "_tail", terms, "_long")
    sign = F.when(F.col("_t").contains("\u2013"), " \u2013 ").otherwise(" - ")
    whole = F.concat(F.coalesce("_hc", "_head"), F.coalesce(F.concat(sign, F.coalesce("_long", F.nullif(F.col("_tail"), F.lit("")))), F.lit("")))
    return rows.withColumn(col, whole).select(*df.columns)


def refine_location(df: DataFrame, col: str, states: list[str], street_words: list[str]) -> DataFrame:
    """Reduces an address line to its street and fills blank city, state and zip from
    its tail: `ST zip`, `ST`, or a zip with or without a state before it. Without such a
    tail the line stays. The part before the tail is the city, unless it is the only one
    and looks like a street (a digit first, or one of street_words); of a city that looks
    like one all but its last word go back to the street."""
    parts = F.filter(F.transform(F.split(F.col(col), ","), lambda x: F.trim(x)), lambda x: x != "")
    df = df.withColumn("_p", F.when(F.col(col).contains(","), parts)).withColumn("_n", F.size("_p"))
    last, before = F.get("_p", F.col("_n") - 1), F.get("_p", F.col("_n") - 2)
    both = r"^([A-Za-z]{2})\s+([0-9]{5}(?:-[0-9]{4})?)$"
    state_of = lambda x: F.when(F.upper(x).isin(states), F.upper(x))
    pair = state_of(F.regexp_extract(last, both, 1))
    zip_only = last.rlike(r"^[0-9]{5}(?:-[0-9]{4})?$")
    state = F.coalesce(pair, state_of(last), F.when(zip_only, state_of(before)))
    code = F.when(pair.isNotNull(), F.regexp_extract(last, both, 2)).when(zip_only, last)
    df = df.withColumns({"_state": state, "_zip": code}).withColumn("_tail", F.col("_state").isNotNull() | F.col("_zip").isNotNull())
    used = F.when(zip_only & F.col("_state").isNotNull(), 2).otherwise(1)
    df = df.withColumn("_r", F.when(F.col("_tail"), F.slice("_p", F.lit(1), F.col("_n") - used)))
    street = lambda x: x.rlike(rf"(?i)^[0-9]|\b(?:{'|'.join(street_words)})\b|#")
    end = F.get("_r", F.size("_r") - 1)
    city = F.when((F.size("_r") >= 2) | ~street(end), end)
    df = df.withColumn("_city", city).withColumn("_r", F.when(city.isNotNull(), F.slice("_r", F.lit(1), F.size("_r") - 1)).otherwise(F.col("_r")))
    glued = street(F.col("_city")) & F.col("_city").rlike(r"\s")
    rest = F.when(glued, F.array(F.regexp_replace("_city", r"\s+\S+$", ""))).otherwise(F.array().cast("array<string>"))
    line = F.nullif(F.regexp_replace(F.array_join(F.concat("_r", rest), ", "), r"^[ ,]+|[ ,]+$", ""), F.lit(""))
    city = F.when(glued, F.regexp_extract("_city", r"(\S+)$", 1)).otherwise(F.col("_city"))
    fill = lambda c, x: F.coalesce(T.blank_null(F.col(c)), x)
    new = {"city": fill("city", city), "state": fill("state", F.col("_state")), "zip": fill("zip", F.col("_zip")), col: F.when(F.col("_tail"), line).otherwise(F.col(col))}
    return df.withColumns(new).drop("_p", "_n", "_state", "_zip", "_tail", "_r", "_city")
