"""Files, catalogs, captured responses and sinks."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# File types by extension, and the first bytes of each type.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "rtf": "rtf", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "webp": "webp"}
MAGIC = {"pdf": ["25504446"], "docx": ["504B0304"], "rtf": ["7B5C727466"], "png": ["89504E470D0A1A0A"], "jpeg": ["FFD8FF"], "tiff": ["49492A00", "4D4D002A"], "webp": ["52494646"]}
DIRECT, IMAGES = ("docx", "rtf"), ("png", "jpeg", "tiff", "webp")


#: Members that a zip of a type must hold: whole names, or folders by their last slash.
MEMBERS = {"docx": ("[Content_Types].xml", "word/")}
HEAD = 12  # bytes that tell any of the types


def _opened(path: str):
    """A file of any store that Arrow can open, for ranged reads."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(inner)


def _holds(file, members: tuple[str, ...]) -> bool:
    """Whether a zip's directory, which is at the file's end, lists the members. Nothing
    is decompressed, and nothing but the directory is read."""
    try:
        with zipfile.ZipFile(file) as z:
            names = set(z.namelist())
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
        return False
    return all(m in names or (m.endswith("/") and any(n.startswith(m) for n in names)) for m in members)


def scan_files(spark: SparkSession, path: str, extensions: dict | None = None, magic: dict | None = None, members: dict | None = None) -> DataFrame:
    """(path, ext, file_type, length, ok, reason) of all files below a path: the type by
    extension, and the first bytes must be that type's; WEBP needs its inner mark, and a
    zip type its members in the zip's own directory.

    Spark lists the files without their contents; executors then read 12 bytes of each,
    and of zip types the directory at the end, so neither the number of bytes below the
    path nor the size of a file matters. A file that can't be opened is rejected with
    that reason; one without a byte isn't in Spark's listing.
    """
    extensions, magic, members = extensions or EXTENSIONS, magic or MAGIC, members if members is not None else MEMBERS
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.create_map(*[F.lit(x) for kv in extensions.items() for x in kv])[ext]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", ext.alias("ext"), kind.alias("file_type"))

    def look(frames):
        for df in frames:
            heads, found = [], []
            for p, n, t in zip(df["path"], df["length"], df["file_type"], strict=True):
                head, held = b"", None
                if t is not None and n:
                    try:
                        with _opened(p) as f:
                            head = f.read_at(min(HEAD, n), 0)
                            held = _holds(f, members[t]) if t in members else None
                    except (OSError, ValueError):
                        head = None
                heads.append(head)
                found.append(held)
            yield df.assign(head=heads, held=found)

    df = listed.mapInPandas(look, "path string, length long, ext string, file_type string, head binary, held boolean")
    head, starts = F.hex("head"), F.lit(False)
    for t, heads in magic.items():
        for h in heads:
            starts = starts | ((F.col("file_type") == t) & head.startswith(h))
    webp = (F.col("file_type") != "webp") | (F.substring(head, 17, 8) == "57454250")
    reason = F.when(F.col("file_type").isNull(), "unsupported").when(F.col("length") == 0, "empty").when(F.col("head").isNull(), "unreadable").when(~starts, "content is not of its type").when(~(webp & F.coalesce("held", F.lit(True))), "inner marks are missing")
    return df.select("path", "ext", "file_type", "length", reason.isNull().alias("ok"), reason.alias("reason"))


def split_accepted(df: DataFrame, max_bytes: int = 10 << 20, max_files: int = 200) -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped with reason) of (batch_id, path, length, ok, reason): too large
    ones, and those past the batch's cap in order of path, are skipped."""
    why = F.when(~F.col("ok"), F.coalesce("reason", F.lit("rejected"))).when(F.col("length") > max_bytes, "too large")
    rows = df.withColumn("reason", why)
    nth = F.count_if(F.col("reason").isNull()).over(Window.partitionBy("batch_id").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(nth > max_files, "batch is full")))
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def route_strategy(df: DataFrame, text: str = "text", least: int = 100) -> DataFrame:
    """Adds strategy (direct, digital or ocr) and needs_async."""
    t = F.col("file_type")
    plan = F.when(t.isin(*DIRECT), "direct").when((t == "pdf") & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= least), "digital").otherwise("ocr")
    return df.withColumn("strategy", plan).withColumn("needs_async", F.col("strategy") == "ocr")


def _catalog(df: DataFrame, spec: dict[str, list[str]], order: Column) -> DataFrame:
    """Columns by the first alias that is there and filled; rows without id or name go."""

    def filled(n: str) -> Column:
        return F.nullif(F.trim(n), F.lit("")) if df.schema[n].dataType.typeName() == "string" else F.col(n)

    def pick(c: str, names: list[str]) -> Column:
        there = [filled(n) for n in names if n in df.columns]
        return (F.coalesce(*there) if there else F.lit(None).cast("string")).alias(c)

    out = df.select(order.alias("_o"), *(pick(c, names) for c, names in spec.items()))
    out = out.withColumns({"id": F.trim(F.col("id").cast("string")), "name": F.trim(F.col("name").cast("string"))}).filter("id != '' and name != ''")
    return out.withColumnRenamed("_o", "ord")


def _place(within: Column) -> Column:
    """The order of rows over all files of a path: by file, place in it, and row."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), within.cast("long").alias("row"))


def load_catalog_json(spark: SparkSession, path: str, spec: dict[str, list[str]], envelopes: tuple = ("records", "data", "items")) -> DataFrame:
    """A bare list of objects, or an object that holds one under an envelope name, in one
    or several files; ord (file, block, row) is the order over all of them."""
    df = spark.read.option("multiLine", "true").json(path)
    for e in envelopes:
        if e in df.columns:
            df = df.select("_metadata", F.posexplode(e).alias("_p", "_r")).select(_place(F.col("_p")).alias("_ord"), "_r.*")
            return _catalog(df, spec, F.col("_ord"))
    df = df.select("*", _place(F.monotonically_increasing_id()).alias("_ord"))
    return _catalog(df, spec, F.col("_ord"))


def load_catalog_csv(spark: SparkSession, path: str, spec: dict[str, list[str]], keywords: str = "keywords") -> DataFrame:
    """The same from CSV; a keywords cell is parted at bars, else commas."""
    df = spark.read.option("header", "true").csv(path)
    df = df.select("*", _place(F.monotonically_increasing_id()).alias("_ord"))
    out = _catalog(df, spec, F.col("_ord"))
    if keywords not in out.columns:
        return out
    k = F.col(keywords)
    parts = F.when(k.contains("|"), F.split(k, r"\|")).otherwise(F.split(k, ","))
    return out.withColumn(keywords, F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def load_or_empty(spark: SparkSession, load, path: str | None, schema: str) -> DataFrame:
    """load(spark, path), or no rows where the path is unset, missing or unreadable."""
    if not path:
        return spark.createDataFrame([], schema)
    try:
        return load(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def flatten_hierarchy(df: DataFrame) -> DataFrame:
    """(category, professions[name, groups[name, items[id, name]], items[id, name]]) to
    (category, profession, group, id, name, ord), nameless items dropped, source order."""
    p = df.select("category", F.monotonically_increasing_id().alias("o1"), F.posexplode("professions").alias("o2", "p"))
    grouped = p.select("category", "o1", "o2", "p.name", F.posexplode("p.groups").alias("o3", "g")).select("category", "o1", "o2", F.col("name").alias("profession"), "o3", F.col("g.name").alias("group"), F.posexplode("g.items").alias("o4", "i"))
    plain = p.select("category", "o1", "o2", F.col("p.name").alias("profession"), F.lit(1 << 20).alias("o3"), F.lit(None).cast("string").alias("group"), F.posexplode("p.items").alias("o4", "i"))
    rows = grouped.unionByName(plain).filter("trim(i.name) != ''")
    return rows.select("category", "profession", "group", "i.id", "i.name", F.struct("o1", "o2", "o3", "o4").alias("ord"))


def flatten_geography(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, country, code, states[id, state, statecode]) to countries and states, rows
    half there dropped."""
    whole = df.filter("id is not null and trim(country) != ''")
    states = whole.select(F.col("id").alias("country_id"), F.posexplode("states").alias("ord", "s")).select("country_id", "ord", "s.id", F.col("s.state").alias("name"), F.col("s.statecode").alias("code"))
    return whole.select("id", F.col("country").alias("name"), "code"), states.filter("id is not null and trim(name) != ''")


def flatten_facilities(df: DataFrame) -> DataFrame:
    rows = df.select(F.posexplode("facilities").alias("ord", "f")).select("ord", "f.*")
    return rows.filter("id is not null and trim(name) != ''")


def keyword_overlay(catalog: DataFrame, overlay: DataFrame) -> DataFrame:
    """Adds (name, extra[]) keywords to the records of exactly that name."""
    none = F.array().cast("array<string>")
    more = overlay.groupBy("name").agg(F.flatten(F.collect_list("extra")).alias("extra"))
    out = catalog.join(more, "name", "left")
    return out.withColumn("keywords", F.array_distinct(F.concat(F.coalesce("keywords", none), F.coalesce("extra", none)))).drop("extra")


def ingest_envelopes(responses: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """(id, status, body) to (rows, errors). A 200 with success false or without a data
    list is malformed; entries that are no objects go."""
    body = F.try_parse_json("body")
    ok = F.coalesce(F.try_variant_get(body, "$.success", "boolean"), F.lit(True))
    data = F.from_json(F.get_json_object("body", "$.data"), f"array<{item}>")
    s = F.col("status")
    why = F.when(s == 401, "auth").when(s == 403, "forbidden").when(s == 429, "rate_limited").when(s >= 500, "server").when((s != 200) | ~ok | data.isNull(), "malformed")
    rows = responses.withColumns({"error": why, "data": data})
    return rows.filter("error is null").select("id", F.explode("data").alias("row")).filter("row is not null"), rows.filter("error is not null").select("id", "error")


def write_results(df: DataFrame, cap: int = 400_000) -> DataFrame:
    """(job_id, result, partial) as stored: a result over the cap is a stub with a
    warning."""
    js = F.to_json(F.struct("result"))
    big = F.octet_length(js) > cap
    return df.select("job_id", F.when(F.col("partial"), "partial").otherwise("completed").alias("status"), F.when(~big, F.col("result")).alias("result"), F.when(big, "result_too_large").alias("warning"))


def audit_sink(log: DataFrame, path: str, tenant: str = "tenant") -> None:
    """Appends to the log, one folder a day; inside a file rows are clustered by tenant
    and time, so a tenant's rows are few row groups of each file."""
    by = [c for c in (tenant, "ts") if c in log.columns]
    log.withColumn("day", F.to_date("ts")).sortWithinPartitions("day", *by).write.mode("append").partitionBy("day").parquet(path)


def log_page(log: DataFrame, tenant, since: datetime, after: tuple[datetime, int] | None = None, size: int = 100) -> DataFrame:
    """One page of a tenant's rows since a time, oldest first by (ts, id), from a log that
    audit_sink wrote: the rows that follow `after`, the (ts, id) of the last row seen.
    Days before the page's first aren't read, and of the others only what may hold the
    tenant; each task keeps `size` rows at most."""
    first = since if after is None else max(since, after[0])
    rows = log.filter((F.col("day") >= F.lit(first.date())) & (F.col("tenant") == F.lit(tenant)) & (F.col("ts") >= F.lit(since)))
    if after is not None:
        ts, last = F.lit(after[0]), F.lit(after[1])
        rows = rows.filter((F.col("ts") >= ts) & ((F.col("ts") > ts) | (F.col("id") > last)))
    return rows.orderBy("ts", "id").limit(size)


def log_pages(log: DataFrame, tenant, since: datetime, size: int = 100) -> Iterator[list]:
    """The pages one after another, as rows, until one isn't full."""
    after = None
    while True:
        page = log_page(log, tenant, since, after, size).collect()  # `size` rows
        if page:
            yield page
        if len(page) < size:
            return
        after = (page[-1].ts, page[-1].id)


def expire(df: DataFrame, as_of, ttl: str, at: str = "ts") -> DataFrame:
    return df.filter(F.col(at) + F.expr(f"interval {ttl}") > F.lit(as_of).cast("timestamp"))


_POINTER = "version long, snapshot string, rows long"


def catalog_refresh(new: DataFrame, path: str, checks: dict[str, str] | None = None) -> dict:
    """Publishes a snapshot in two steps: it is written beside the others, what was
    written is read and counted, and only then a pointer to it is added. An empty one,
    or one with rows that break a check (name: SQL condition that each row must meet),
    is refused. Until the pointer is there, and if any step fails, readers get what they
    got before; a new snapshot never touches an old one's files."""
    spark = new.sparkSession
    name = uuid.uuid4().hex
    new.write.parquet(f"{path}/snapshots/{name}")
    there = spark.read.schema(new.schema).parquet(f"{path}/snapshots/{name}")
    broken = [F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(k) for k, c in (checks or {}).items()]
    told = there.agg(F.count(F.lit(1)).alias("n"), *broken).first()
    refused = [k for k in checks or {} if told[k]]
    if not told.n or refused:
        return {"written": False, "rows": told.n, "refused": refused or ["empty"]}
    version = (_published(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(version, name, told.n)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return {"written": True, "rows": told.n, "version": version}


def _published(spark: SparkSession, path: str) -> DataFrame:
    return load_or_empty(spark, lambda s, p: s.read.schema(_POINTER).parquet(p), f"{path}/published", _POINTER)


def catalog_current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The snapshot last published, or that of a version."""
    rows = _published(spark, path)
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    last = rows.orderBy(F.desc("version"), F.desc("snapshot")).first()
    if last is None:
        raise ValueError(f"nothing has been published at {path}")
    return spark.read.parquet(f"{path}/snapshots/{last.snapshot}")
