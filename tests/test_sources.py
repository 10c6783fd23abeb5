"""Files by ranged reads, catalogs over several files, pages of a log, published snapshots."""

import os
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomfield.sources import files


def packed(path, *names):
    with zipfile.ZipFile(path, "w") as z:
        for n in names:
            z.writestr(n, "x" * 100)


def test_types_are_told_by_heads_and_directories(spark, tmp_path):
    (tmp_path / "below").mkdir()
    packed(tmp_path / "good.docx", "[Content_Types].xml", "word/document.xml")
    packed(tmp_path / "other zip.docx", "[Content_Types].xml", "xl/workbook.xml")
    packed(tmp_path / "names.docx", "[Content_Types].xml", "a/word/document.xml")
    (tmp_path / "told.docx").write_bytes(b"PK\x03\x04 plain text that names [Content_Types].xml and word/document.xml")
    (tmp_path / "cut.docx").write_bytes((tmp_path / "good.docx").read_bytes()[:-30])
    (tmp_path / "below" / "UP.PDF").write_bytes(b"%PDF-1.7")
    (tmp_path / "short.pdf").write_bytes(b"%P")
    (tmp_path / "empty.pdf").write_bytes(b"")  # Spark lists no file without a byte
    (tmp_path / "a.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8 ")
    (tmp_path / "b.webp").write_bytes(b"RIFF\0\0\0\0WAVEfmt ")
    (tmp_path / "noext").write_bytes(b"%PDF")
    with open(tmp_path / "large ü#1%20.pdf", "wb") as f:  # three gigabytes, of which nothing is on the disk
        f.write(b"%PDF-1.4")
        f.truncate(3 << 30)
    with open(tmp_path / "large.docx", "wb") as f:
        f.truncate(5 << 30)
    got = {os.path.basename(r.path): (r.file_type, r.ok, r.reason) for r in files.scan_files(spark, str(tmp_path)).collect()}
    bad, marks = "content is not of its type", "inner marks are missing"
    assert got == {
        "good.docx": ("docx", True, None), "other zip.docx": ("docx", False, marks), "names.docx": ("docx", False, marks), "told.docx": ("docx", False, marks), "cut.docx": ("docx", False, marks),
        "UP.PDF": ("pdf", True, None), "short.pdf": ("pdf", False, bad), "a.webp": ("webp", True, None), "b.webp": ("webp", False, marks),
        "noext": (None, False, "unsupported"), "large ü#1%20.pdf": ("pdf", True, None), "large.docx": ("docx", False, bad),
    }


def test_the_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    plan = files.scan_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]


SPEC = {"id": ["id", "key"], "name": ["name", "title"], "keywords": ["keywords"]}


def test_blank_aliases_and_order_over_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"records": [{"id": " ", "key": "k1", "name": "B one"}, {"id": "k2", "name": "", "title": "B two"}]}')
    (tmp_path / "a.json").write_text('{"records": [{"id": "a1", "name": "A one"}, {"id": null, "key": null, "name": "none"}, {"id": "a2", "name": "A two"}]}')
    got = files.load_catalog_json(spark, str(tmp_path), SPEC).orderBy("ord").collect()
    assert [(r.id, r.name) for r in got] == [("a1", "A one"), ("a2", "A two"), ("k1", "B one"), ("k2", "B two")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "2.csv").write_text("id,key,name,keywords\n,k9,Nine,a|b\n")
    (tmp_path / "c" / "1.csv").write_text('id,key,name,keywords\n7,,Seven,"x, y"\n8,,,z\n')
    got = files.load_catalog_csv(spark, str(tmp_path / "c"), SPEC).orderBy("ord").collect()
    assert [(r.id, r.name, r.keywords) for r in got] == [("7", "Seven", ["x", "y"]), ("k9", "Nine", ["a", "b"])]


def test_pages_join_up_and_read_only_their_days(spark, tmp_path):
    t0 = datetime(2024, 3, 1)
    rows = [(i, i % 3, t0 + timedelta(hours=6 * (i // 2))) for i in range(120)]  # two rows at each time
    files.audit_sink(spark.createDataFrame(rows, "id long, tenant long, ts timestamp").repartition(4), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    since = t0 + timedelta(days=3)
    want = sorted((ts, i) for i, tenant, ts in rows if tenant == 1 and ts >= since)
    for size in (1, 7, len(want), 1000):
        pages = list(files.log_pages(log, 1, since, size))
        assert [(r.ts, r.id) for p in pages for r in p] == want and all(len(p) == size for p in pages[:-1])
    assert list(files.log_pages(log, 99, since)) == []
    page = files.log_page(log, 1, since, want[20], 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(tenant,1)" in plan
    read = page._jdf.queryExecution().optimizedPlan().toString()
    assert str(want[20][0].date()) in read or "day" in read


def test_a_snapshot_is_there_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "catalog")
    with pytest.raises(ValueError):
        files.catalog_current(spark, path)
    one = spark.range(5).selectExpr("id", "concat('n', id) as name")
    assert files.catalog_refresh(one, path) == {"written": True, "rows": 5, "version": 1}
    assert files.catalog_refresh(one.filter("false"), path)["refused"] == ["empty"]
    assert files.catalog_refresh(one.withColumn("name", F.when(F.col("id") > 0, F.col("name"))), path, {"named": "name != ''", "ids": "id >= 0"})["refused"] == ["named"]
    broken = one.withColumn("name", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        files.catalog_refresh(broken, path)
    assert files.catalog_current(spark, path).count() == 5
    # a snapshot made from the one that stands
    more = files.catalog_current(spark, path).unionByName(spark.sql("select 9L as id, 'n9' as name"))
    assert files.catalog_refresh(more, path)["version"] == 2
    assert files.catalog_current(spark, path).count() == 6 and files.catalog_current(spark, path, 1).count() == 5
