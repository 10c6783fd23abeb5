"""Secret scans, language fits and scratch tables against plain versions."""

import math
import os
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import common, content_sort, language, randomness

from brute import BASE64, ftrl, secrets


def some_texts(rng):
    made = ["", None, "password: hunter22 token=a.b_c-d=", 'API_KEY" = \'zzzzzz\'', "\u212aey = toKen:abcdef \U0001f600 AKIA" + "Z9" * 9, "token=abc token=abcdef passwd=secret:tokens1"]
    for _ in range(250):
        said = []
        for _ in range(rng.randrange(8)):
            kind, n = rng.randrange(8), rng.randrange(18, 90)
            said += {
                0: lambda: rng.choices(BASE64[:62] + "-_", k=n),  # noqa: B023
                1: lambda: rng.choices("0123456789ABCDEF", k=n),  # noqa: B023
                2: lambda: rng.choices("abcdefghijklmnopqrstuvwxyz234567", k=n),  # noqa: B023
                3: lambda: rng.choice(["the/path/of/some_file_name/", "snake_case_identifier_name_", "aaaa"]) * 3,
                4: lambda: rng.choices("0123456789abcdef", k=n),  # noqa: B023
                5: lambda: ["AKIA", *rng.choices(string.ascii_uppercase + string.digits, k=n // 3)],  # noqa: B023
                6: lambda: [rng.choice(["secret", "Password", "api_key", "apikey"]), rng.choice([":", " = ", "='", '": "']), *rng.choices(string.ascii_letters, k=rng.randrange(3, 12))],
                7: lambda: "w\u00f6rter \u4e2d\U0001f600 und mehr",
            }[kind]()
            said += rng.choice([" ", "\n", ", ", "\U0001f600"])
        made.append("".join(said))
    return made


def test_secrets_against_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**9 + i, t) for i, t in enumerate(some_texts(random.Random(8)))]
    want = secrets(rows)
    out = randomness.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in out} == want
    assert sum("random" in w[4] for w in want.values()) > 100 and all(sum(w[k] for w in want.values()) > 20 for k in range(3))


def test_fit_against_one_coordinate_at_a_time():
    rng = np.random.default_rng(3)
    k, bits, rows = 3, 5, []
    for i in range(60):
        some = np.sort(rng.choice(1 << bits, 6, replace=False)).astype(np.int32)
        value = rng.random(6) + (some % k == i % k)
        rows.append((i % k, some, value / np.sqrt((value * value).sum())))
    w, t = language.fit(rows[:45], rows[45:], k, bits)
    orders = [np.random.default_rng(e).permutation(45).tolist() for e in range(language.EPOCHS)]
    plain = np.array(ftrl([(c, s.tolist(), v.tolist()) for c, s, v in rows[:45]], k, bits, orders=orders))
    assert np.allclose(w, plain, atol=1e-9) and (plain == 0).any() and (plain != 0).any()

    def loss(t):
        out = 0.0
        for c, some, v in rows[45:]:
            x = [(sum(a * plain[f][j] for f, a in zip(some, v)) + plain[-1][j]) / t for j in range(k)]
            out -= x[c] - math.log(sum(map(math.exp, x)))
        return out

    grid = [math.exp(-4 + 7 * i / 400) for i in range(401)]
    assert loss(t) <= min(map(loss, grid)) + 1e-6


@pytest.mark.parametrize("kept_id", [None, 6])
def test_languages_of_rows_without_or_under_one_id(spark, kept_id):
    rng = random.Random(5)
    part = {"de": ["schn", "ung", "ver"], "es": ["cion", "los", "que"]}
    rows = [(i if la == "de" else kept_id, " ".join(rng.choice(part[la]) + rng.choice(part[la]) for _ in range(12)), la) for i in range(400) for la in part]
    out = language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=100).collect()
    assert sum(r.lang_pred == "es" for r in out) == sum(r.lang_pred == "de" for r in out) == 400


def test_scratch_removes_what_operators_wrote_inside(spark):
    here = common.shared_folder(spark).removeprefix("file:")
    before = common.kept_in_store(spark.range(3).toDF("doc_id"))
    there = set(os.listdir(here))
    docs = spark.createDataFrame([(i, "same" if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string")
    out = f"{here}/out-{random.random()}"
    with common.scratch(spark):
        content_sort.exact_dedup(docs, ranges=8).write.parquet(out)
        assert len(set(os.listdir(here)) - there) >= 3
    assert set(os.listdir(here)) - there == {os.path.basename(out)}
    assert before.count() == 3 and spark.read.parquet(out).filter("kept").count() == 21
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.written(docs)
        raise ZeroDivisionError
    assert set(os.listdir(here)) - there == {os.path.basename(out)}
    assert common.kept_in_store(docs.agg(F.count("*"))).count() == 1


def test_runs_of_a_cut_text_are_compared_whole(spark, monkeypatch):
    """Texts that share a digest, as no two known ones do, stay apart."""
    monkeypatch.setattr(content_sort.F, "sha2", lambda c, n: F.lit("one digest"))
    rows = [(i, ("left", "right", "le ft")[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for ranges in (1, 8):
        out = content_sort.exact_dedup(docs, ranges=ranges).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == [(i, 1 if i % 3 == 1 else 2, 100 if i % 3 == 1 else 200) for i in range(300)]
        assert [r.doc_id for r in out if r.kept] in ([1, 2], [2, 1])
