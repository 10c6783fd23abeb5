"""Secret scans with a randomness test battery. JVM operators only.

Beside the base patterns, every long token of an encoding's alphabet is tested for
looking random: Pearson's chi-squared for a uniform alphabet, a runs test on the
upper and lower half of the alphabet, and serial correlation of neighbouring symbols.
Where fewer than five of each symbol are expected chi-squared has no chi-squared
distribution; there its p-value is that of the pairs of equal symbols, which it is a
linear function of and which are near Poisson.
The three p-values join by Bonferroni. A token is written off as not random where its
p-value is rejected with the false discovery rate controlled at `rate` (Benjamini and
Hochberg) among tokens of its encoding and length class. On short tokens the tests
have little power, so those stay only with a p-value of SURE or more. Tokens that stay
are secrets. A token of a million symbols takes seconds: symbols are counted by 64
passes of a built-in replacement, and only serial correlation looks at each by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the battery looks at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
# Alphabets of the encodings, in order; "+/" and "-_" are one pair.
HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: A token is of the first one that has all its symbols.
ENCODINGS = (("hex", HEX_DIGITS), ("upper hex", HEX_DIGITS.upper()), ("base32", BASE32), ("lower base32", BASE32.lower()), ("base64", BASE64))
RATE, BINS, SURE = 0.05, 60, 0.1
CHUNK = 1000  # matches of a text whose places are worked out together
CLASSES = (24, 32, 48, 64)  # lengths at which a new length class begins


def placed(df: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds array<struct<start, stop, m>> `name`: the leftmost non-overlapping matches
    in `text` with code point offsets, m the given group. Offsets come from the
    matches and the pieces of text between them, summed up in chunks, so that the work
    grows with the matches and not with their square."""
    t, f, g, b = F.col("text"), f"{name}_f", f"{name}_g", f"{name}_b"
    df = df.withColumn(f, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    df = df.withColumns({b: F.when(F.size(f) > 0, F.split(t, pattern, -1)), g: F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else F.col(f)})
    none = F.array().cast("array<struct<start:int,stop:int,m:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc, x):
        a = acc["at"] + F.length(x[b])
        z = a + F.length(x[f])
        one = F.struct(a.alias("start"), z.alias("stop"), x[g].alias("m"))
        return F.struct(z.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # the last piece has no match after it
    steps = F.arrays_zip(F.slice(F.col(f), 1, F.size(f)), F.col(g), F.slice(F.col(b), 1, F.size(f))).cast(f"array<struct<{f}:string,{g}:string,{b}:string>>")
    lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)), zero, add))

    def moved(lots):
        before = lambda i: F.aggregate(F.slice(lots, F.lit(1), i), F.lit(0), lambda s, x: s + x["at"])
        return F.flatten(F.transform(lots, lambda x, i: _bound(before(i), lambda at: F.transform(x["out"], lambda m: F.struct((m["start"] + at).alias("start"), (m["stop"] + at).alias("stop"), m["m"].alias("m"))))))

    return df.withColumn(name, F.when(F.size(f) > 0, _bound(lots, moved)).otherwise(none)).drop(f, g, b)


def _bound(c: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


# The coefficients of a Chebyshev fit of erfc with a relative error of 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z: Column) -> Column:
    """Of the standard normal above z, as exact far out as in the middle."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + c
    upper = t * F.exp(poly - x * x) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


def poisson_from(c: Column, mean: Column) -> Column:
    """Probability that a Poisson variable is c at least (Wilson and Hilferty's cube root
    of the gamma variable that c events wait for); 1 for 0."""
    n = F.greatest(c, F.lit(1.0))
    return F.when(c < 1, 1.0).otherwise(normal_tail(((1 - 1 / (9 * n)) - F.pow(mean / n, 1 / 3)) * 3 * F.sqrt(n)))


def battery(t: Column, alphabet: Column) -> Column:
    """The p-value of the three tests on a token of two symbols or more over an alphabet."""
    k, n = F.length(alphabet).cast("double"), F.length(t).cast("double")
    counts = F.transform(F.split(alphabet, ""), lambda c: n - F.length(F.replace(t, c, F.lit(""))))
    pairs = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * (c - 1) / 2)

    def p_uniform(pairs):
        mean = n * (n - 1) / (2 * k)
        sparse = poisson_from(pairs, mean)
        v = 2 / (9 * (k - 1))
        chi = F.greatest(2 * pairs * k / n + k - n, F.lit(0.0))
        z = (F.pow(chi / (k - 1), 1 / 3) - (1 - v)) / F.sqrt(v)
        return F.when(n < 5 * k, sparse).otherwise(normal_tail(z))

    half = (k / 2).cast("int")
    high = F.call_function("translate", t, alphabet, F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), half)))
    turns = _bound(high, lambda h: (2 * n - F.length(F.replace(h, F.lit("01"), F.lit(""))) - F.length(F.replace(h, F.lit("10"), F.lit("")))) / 2)
    p_runs = 2 * normal_tail(F.greatest(F.abs(turns - (n - 1) / 2) - 0.5, F.lit(0.0)) / F.sqrt((n - 1) / 4))
    # neighbours' products, their mean taken off
    values = F.transform(F.split(t, ""), lambda c: F.coalesce(F.position(c, alphabet), F.lit(0)) - (k + 1) / 2)
    zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"))
    product = F.aggregate(values, zero, lambda a, v: F.struct(v.alias("last"), (a["sum"] + a["last"] * v).alias("sum")), lambda a: a["sum"])
    p_serial = 2 * normal_tail(F.abs(product) / ((k * k - 1) / 12 * F.sqrt(n - 1)))
    return F.least(F.lit(1.0), 3 * F.least(_bound(pairs, p_uniform), p_runs, p_serial))


def _judged(m: Column) -> Column:
    """struct<start, stop, cls, bin, sure>: a token's class (encoding and length), the bin
    of its p-value on a logarithmic scale, and whether that is SURE or more; symbols in
    URL form count as standard ones."""
    last = len(ENCODINGS) - 1
    alphabets = F.array(*(F.lit(a) for _, a in ENCODINGS))

    def told(x):
        length = reduce(lambda a, b: a + b, [(x["n"] >= c).cast("int") for c in CLASSES])
        level = F.least(F.lit(BINS - 1), F.floor(-4 * F.log10(F.greatest(x["p"], F.lit(1e-15)))).cast("int"))
        return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), (x["e"] * 10 + length).alias("cls"), level.alias("bin"), (x["p"] >= SURE).alias("sure"))

    def scored(t):
        encoding = F.coalesce(*(F.when(F.translate(t, a, "") == "", i) for i, (_, a) in enumerate(ENCODINGS[:last])), F.lit(last))
        return _bound(encoding, lambda e: F.struct(e.alias("e"), F.length(t).alias("n"), battery(t, F.get(alphabets, e)).alias("p")))

    return _bound(_bound(F.translate(m["m"], "-_", "+/"), scored), told)


def _tagged(found, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))


def _cutoffs(judged: DataFrame, rate: float) -> dict[int, int]:
    """For each class the least bin whose tokens are written off as not random: the
    step-up rule over binned p-values. At most classes x BINS rows reach the driver."""
    rows = judged.select(F.explode("tokens").alias("t")).groupBy("t.cls", "t.bin").count().collect()
    out = {}
    for cls in {r["cls"] for r in rows}:
        by_bin = {r["bin"]: r["count"] for r in rows if r["cls"] == cls}
        total, rejected, least = sum(by_bin.values()), 0, BINS
        for b in range(BINS - 1, -1, -1):
            rejected += by_bin.get(b, 0)
            if rejected and 10 ** (-b / 4) <= rate * rejected / total:
                least = b
        out[cls] = least
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex (base spans),
    base_sha256, spans (kind:start:end in code points, end exclusive, comma-joined;
    the battery's finds are of kind `random` and overlap no base span).

    Null and empty texts have no spans. Repeated rows give repeated results, though
    each counts among the tokens that false discovery control looks at. Other columns
    are ignored.
    """
    found = common.id_text(docs, id_col, text_col)
    for name, pattern, group in (("k0", ASSIGN, 2), ("k1", ACCESS, 0), ("k2", HEX, 0), ("raw", TOKEN, 0)):
        found = placed(found, name, pattern, group)
    found = found.select("doc_id", F.filter("k0", lambda m: F.length(m["m"]) >= 6).alias("k0"), "k1", "k2", "raw")
    spans = F.concat(*(_tagged(f"k{i}", i) for i in range(3)))
    found = found.select("doc_id", F.array_sort(spans).alias("base"), *(F.size(f"k{i}").cast("long").alias(n) for i, n in enumerate(("n_assign", "n_access", "n_hex"))), "raw")
    apart = F.filter("raw", lambda m: ~F.exists("base", lambda s: (s["start"] < m["stop"]) & (m["start"] < s["stop"])))
    judged = found.select("doc_id", "base", "n_assign", "n_access", "n_hex", F.transform(apart, _judged).alias("tokens"))
    judged = common.kept_in_store(judged)
    least = _cutoffs(judged, rate)
    table = F.create_map(*[F.lit(x) for kv in (least or {-1: BINS}).items() for x in kv])
    random = F.filter("tokens", lambda m: (m["bin"] < table[m["cls"]]) & ((m["cls"] % 10 > 0) | m["sure"]))
    every = F.array_sort(F.concat("base", _tagged(random, 3)))
    names = F.array(*map(F.lit, ("assign", "access", "hex", "random")))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")
    return judged.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(common.documents(spark, sf_dir))
