"""Text cleaning, contact anchors and scalar hygiene as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at a line's end, and line breaks.
SPACE = r"[\t \x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
BREAK = r"\r\n|[\r\x{85}\x{2028}\x{2029}]"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]"
PRIVATE = r"[\x{E000}-\x{F8FF}]"
UNSEEN = CONTROL[:-1] + PRIVATE[1:]
# Patterns of contact anchors.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
EMAIL_LOOSE = r"\b[A-Za-z0-9._%+\-]+ ?@ ?[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<![0-9])\+?[0-9][0-9\s\-.()]{6,18}[0-9](?![0-9])"
YEARS = r"(?i)^\s*(19|20)[0-9]{2}\s*[-–—]\s*((19|20)[0-9]{2}|present)\s*$"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[\w\-]+/?"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[\w\-]+/?"
PORTFOLIO = r"(?i)https?://[\w\-.]+\.[a-z]{2,}(?:/[\w\-._~:/?#\[\]@!$&'()*+,;=%]*)?"
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


# One class, possessive, and begun only where a run begins: linear, and no stack in long runs.
_EDGE = SPACE[:-1] + r"\n]"
_EDGES = rf"\A{_EDGE}++|(?<!{_EDGE}){_EDGE}++\z"
_LINE_END = rf"(?m)(?<!{SPACE}){SPACE}++$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def bound(c: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def clean_text(c: Column) -> Column:
    """Control and private-use characters to blanks, ligatures apart, at most one empty
    line in a row, no blanks at line ends or at either end of the text. Null: null."""
    c = F.regexp_replace(c, UNSEEN, " ")
    c = F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), BREAK, "\n")
    return trimmed(F.regexp_replace(c, _LINE_END, ""))


def low_quality(c: Column, least: int = 120, wordy: float = 0.55, letters: float = 0.40, cids: int = 5) -> Column:
    """Is the text too short, full of unmapped glyphs, or of too few word characters?"""

    def judged(body: Column) -> Column:
        def of_solid(solid: Column) -> Column:
            n = F.length(solid)
            n_wordy = F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}.,/\-:;()&'@]++", ""))
            n_letters = F.length(F.regexp_replace(solid, r"[^\p{L}]++", ""))
            return (n == 0) | (n_wordy < wordy * n) | (n_letters < letters * n)

        short = (F.length(body) < least) | (F.regexp_count(body, F.lit(r"\(cid:")) >= cids)
        return short | bound(F.regexp_replace(body, r"[\s\x{A0}]++", ""), of_solid)

    return bound(trimmed(c), judged)


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def emails(c: Column) -> Column:
    """Distinct addresses in order; with a blank beside the sign only where none is
    strict."""
    signed = F.when(c.contains("@"), c).when(c.isNotNull(), "")  # no sign, nothing to look for
    loose = F.array_distinct(F.transform(found(signed, EMAIL_LOOSE), lambda x: F.replace(x, F.lit(" "), F.lit(""))))
    return bound(F.array_distinct(found(signed, EMAIL)), lambda strict: F.when(F.size(strict) > 0, strict).otherwise(loose))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def distinct_by(c: Column, key) -> Column:
    """The items of an array whose key none before them has, in order: neighbours of a
    sorted array are compared, so the work doesn't grow with the square of the items."""
    ranked = F.array_sort(F.transform(c, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = bound(ranked, lambda r: F.filter(r, lambda x, i: (i == 0) | ~F.get(r, i - 1)["k"].eqNullSafe(x["k"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def phones(c: Column) -> Column:
    """Phone-shaped runs with 10 to 15 digits, or 7 to 15 after a plus; no year ranges;
    one spelling, the first, for the same digits."""
    ok = F.filter(
        F.transform(found(c, PHONE), lambda x: F.struct(F.trim(x).alias("said"), digits(x).alias("d"), x.rlike(YEARS).alias("years"))),
        lambda x: ~x["years"] & F.length(x["d"]).between(F.when(x["said"].startswith("+"), 7).otherwise(10), 15),
    )
    return F.transform(distinct_by(ok, lambda x: x["d"]), lambda x: x["said"])


def urls(c: Column) -> dict[str, Column]:
    """linkedin, github and portfolio links, distinct in order."""
    other = F.array_distinct(found(c, PORTFOLIO))
    return {
        "linkedin": F.array_distinct(found(c, LINKEDIN)),
        "github": F.array_distinct(found(c, GITHUB)),
        "portfolio": F.filter(other, lambda u: ~u.contains("linkedin.com") & ~u.contains("github.com")),
    }


def match_key(c: Column) -> Column:
    """The key that all resolvers join on: lower case, dashes alike, `and` for `&`, no
    blanks about a slash, hyphens and blanks as one blank."""
    c = F.lower(F.regexp_replace(c, r"[–—]", "-"))
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), r"(?<!\s)\s*+/\s*", "/")
    return F.trim(F.regexp_replace(c, r"[\s\-]+", " "))


def blank_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def contact(c: Column, kind: str) -> Column:
    """email, url or phone, or null where it doesn't look like one."""
    t = blank_null(c)
    if kind == "email":
        return F.when(F.lower(t).rlike(EMAIL_SHAPE), F.lower(t))
    if kind == "url":
        full = F.when(t.rlike(r"(?i)^https?://"), t).when(t.contains(".") & ~t.contains(" "), F.concat(F.lit("https://"), t))
        return F.when(F.length(full) <= 2048, full)
    return F.when(F.length(digits(t)).between(7, 15), t)


def scalar(c: Column, kind: str) -> Column:
    """year (1900 to 2035), tri (Yes, No, N/A), confidence (0 to 1, unparsable 0), note
    (the same, unparsable 0.5), id (as string) or text; blank is null."""
    if kind == "year":
        y = c.try_cast("int")
        return F.when(y.between(1900, 2035), y)
    if kind == "tri":
        t = F.lower(F.trim(c))
        return F.when(t.isin("yes", "true", "y"), "Yes").when(t.isin("no", "false", "n"), "No").when(t.isin("n/a", "na"), "N/A")
    if kind in ("confidence", "note"):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0 if kind == "confidence" else 0.5))))
    return blank_null(c.cast("string"))


# Months by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_number(c: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def _month_year(mo: Column, year: Column) -> Column:
    return F.when(mo.between(1, 12) & year.between(1900, 2035), F.concat(F.lpad(mo.cast("string"), 2, "0"), F.lit("/"), year.cast("string")))


def _full(mo: Column, day: Column, year: Column) -> Column:
    ok = mo.between(1, 12) & year.between(1900, 2035)
    last = F.day(F.last_day(F.when(ok, F.make_date(year, mo, F.lit(1)))))
    said = F.concat(F.lpad(mo.cast("string"), 2, "0"), F.lit("/"), F.lpad(day.cast("string"), 2, "0"), F.lit("/"), year.cast("string"))
    return F.when(ok & (day >= 1) & (day <= last), said)


def normalize_date(c: Column, as_of_year: int) -> Column:
    """MM/DD/YYYY, MM/YYYY, YYYY or Present, as precise as stated; null where nothing fits
    or the day doesn't exist. Years of two digits turn at 69; a numeric month with one
    reaches ten years past as_of_year, a written one without an apostrophe none."""
    t = F.trim(c)
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    word = lambda p: month_number(F.regexp_extract(t, p, 1))
    long_year = lambda y: F.when(y < 69, y + 2000).otherwise(y + 1900)
    iso, iso_month = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{4})-([0-9]{1,2})$"
    us, us_short = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$", r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2})$"
    month, month_short = r"^([0-9]{1,2})[/-]([0-9]{4})$", r"^([0-9]{1,2})[/-]([0-9]{2})$"
    day_said = r"^([A-Za-z]{3,9})\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})$"
    said, said_short = r"^([A-Za-z]{3,9})\.?\s+([0-9]{4})$", r"^([A-Za-z]{3,9})\.?\s+('?)([0-9]{2})$"
    yy = part(month_short, 2)
    named = part(said_short, 3)
    sure = (F.regexp_extract(t, said_short, 2) == "'") | (named > 31) | (long_year(named) <= as_of_year)
    year = t.try_cast("int")
    return (
        F.when(F.lower(t) == "present", "Present")
        .when(t.rlike(iso), _full(part(iso, 2), part(iso, 3), part(iso, 1)))
        .when(t.rlike(iso_month), _month_year(part(iso_month, 2), part(iso_month, 1)))
        .when(t.rlike(us), _full(part(us, 1), part(us, 2), part(us, 3)))
        .when(t.rlike(us_short), _full(part(us_short, 1), part(us_short, 2), long_year(part(us_short, 3))))
        .when(t.rlike(month), _month_year(part(month, 1), part(month, 2)))
        .when(t.rlike(month_short) & part(month_short, 1).between(1, 12) & (long_year(yy) <= as_of_year + 10), _month_year(part(month_short, 1), long_year(yy)))
        .when(t.rlike(day_said) & word(day_said).isNotNull(), _full(word(day_said), part(day_said, 2), part(day_said, 3)))
        .when(t.rlike(said) & word(said).isNotNull(), _month_year(word(said), part(said, 2)))
        .when(t.rlike(said_short) & word(said_short).isNotNull() & sure, _month_year(word(said_short), long_year(named)))
        .when(t.rlike(r"^[0-9]{4}$") & year.between(1900, 2035), t)
    )


def year_month(c: Column) -> Column:
    """Months since year 0 of a normalised date; a year alone is January; else null."""
    y = F.regexp_extract(c, r"([0-9]{4})$", 1).try_cast("int")
    m = F.regexp_extract(c, r"^([0-9]{2})/", 1).try_cast("int")
    return F.when(c.rlike(r"^(([0-9]{2}/){0,2})[0-9]{4}$"), y * 12 + F.coalesce(m, F.lit(1)))


def first_count(c: Column) -> Column:
    """The first run of digits, commas dropped, or null."""
    return F.replace(F.regexp_extract(c, r"([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("long")


def classify(columns: list[Column], rules: list[tuple[str, str]]) -> Column:
    """The label of the first pattern that the joined columns match."""
    joined, out = F.concat_ws(" ", *columns), F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(joined.rlike(pattern), label).otherwise(out)
    return out


def list_items(c: Column) -> Column:
    """Text into its lines or bullets, without a leading dash and doubled blanks."""
    parts = F.split(c, r"[\n\x{2022}]")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*[-*]+\s*", ""), r"\s+", " "))), lambda x: x != "")
