"""The Merkle manifest against a plain version that keeps all levels."""

import hashlib
import zlib

import pytest

from loomfield.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """(root, for each leaf the siblings of each level, left and right ones)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(nodes)):
        path, j = [], i
        for level in levels[:-1]:
            a = j // 8 * 8
            path.append((level[a:j], level[j + 1 : a + 8]))
            j //= 8
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(framed, r)), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([y[2] for y in sorted(langs[x], key=lambda y: y[:3])]) for x in names}
    root, tops = plain_tree([trees[x][0] for x in names]) if names else (None, [])
    out = []
    for lang, top in zip(names, tops, strict=True):
        for (*_, leaf, r), own in zip(sorted(langs[lang], key=lambda y: y[:3]), trees[lang][1], strict=True):
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4]:
                node = h(*map(framed, r[:4]), framed("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in own + top:
                node = h(*left, node, *right)
            out.append((r[0], leaf, trees[lang][0], root, h(*(x for left, right in own + top for x in left + right)), node, node == root))
    return sorted(out, key=str)


SCHEMA = "extra string, `path` int, doc_id long, source string, lang string, n_chars long, text string, `pos` int"


def table(spark, tmp_path, rows):
    # columns that clash with names of the operator's own
    spark.createDataFrame([("x", 1, *r, 2) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("sizes", [{}, {"en": 9, "": 7, "dé": 64, None: 1}, {"a": 513, "b": 65, None: 512, **{f"l{i}": 1 for i in range(9)}}])
def test_every_shape(spark, tmp_path, sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7 % 1009, f"s{i % 3}" if i % 5 else None, lang, i if i % 4 else None, None if i % 11 == 0 else "" if i % 13 == 0 else f"Some Téxt {i}"))
    got = merkle.op11_merkle_manifest(spark, table(spark, tmp_path, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_repeated_rows_null_ids_and_a_long_text(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(4, "s", "en", 1, "Twice")] * 2 + [(4, "s", "en", 1, "Other"), (None, "s", "en", 2, "X" * 2_000_000)]
    got = merkle.op11_merkle_manifest(spark, table(spark, tmp_path, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_stored_levels_are_every_third(spark):
    rows = spark.range(600).selectExpr("cast(null as string) as lang", "id as doc_id", "sha2(cast(id as string), 256) as leaf")
    tree = merkle.grow(rows.selectExpr("'k' as key", "doc_id", "leaf as node"), ["doc_id"])
    assert [sorted((r.n, len(r.nodes)) for r in level.collect()) for level in tree.levels] == [[(600, 88), (600, 512)], [(2, 2)]]
    assert tree.roots.first().node == plain_tree([r.leaf for r in rows.orderBy("doc_id").collect()])[0]


def test_any_other_leaf_fails(spark):
    rows = spark.range(20).selectExpr("'en' as lang", "id as doc_id", "sha2(cast(id as string), 256) as leaf", "sha2(cast(id + 1 as string), 256) as other")
    out = merkle.manifest(rows)
    from pyspark.sql import functions as F

    told = out.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"), (merkle.fold(F.col("other"), F.col("path")) == F.col("root")).alias("other"))
    assert {tuple(r) for r in told.collect()} == {(True, False)}
