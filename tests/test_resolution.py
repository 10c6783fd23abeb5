"""Resolution inside scopes, expansion, dictionaries as tables, cities of city-only roles, records of whole documents."""

import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from loomfield.operators import resolve, rollup, segment


def test_a_typo_stays_in_its_scope(spark):
    cat = spark.createDataFrame([(1, 1, "intensive care unit", None, "RN"), (2, 2, "long term care", "long term care facility", "LPN"), (3, 3, "therapy", None, None)], "ord int, id int, name string, full_name string, scope string")
    rows = [(1, "intensive care unt", "LPN"), (2, "intensive care unt", "RN"), (3, "intensive care unt", None), (4, "intensive care unt", "LPN/RN"), (5, "long term care facility", "LPN"), (6, "long term cares", "nurse"), (7, None, "RN")]
    probe = spark.createDataFrame(rows, "row_id int, said string, scope string")
    scopes = resolve.scope_keys(probe, "row_id", "scope", {"nurse": ["rn", "lpn"]})
    out = resolve.match_fuzzy(probe, "row_id", resolve.candidate_keys_org(probe, "row_id", "said"), cat, scopes=scopes)
    got = {r.row_id: (r.match_id, r.match_tier) for r in out.collect()}
    assert got == {1: (None, None), 2: (1, "fuzzy"), 3: (1, "fuzzy"), 4: (1, "fuzzy"), 5: (2, "full_name"), 6: (2, "fuzzy"), 7: (None, None)}
    # without scopes the first row finds what is only another's
    free = resolve.match_fuzzy(probe, "row_id", resolve.candidate_keys_org(probe, "row_id", "said"), cat)
    assert {r.row_id: r.match_id for r in free.collect()}[1] == 1


def test_scoped_near_matches_are_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    records = [(i, i, n, None, rng.choice(["a", "b", "c", None])) for i, n in enumerate(base)]

    def bent(t):
        i = rng.randrange(len(t))
        return t[:i] + rng.choice(["", "x", t[i] * 2]) + t[i + 1 :]

    rows = [(i, bent(rng.choice(base)), rng.choice(["a", "b", "a/b", None])) for i in range(150)]
    probe = spark.createDataFrame(rows, "row_id int, said string, scope string")
    cat = spark.createDataFrame(records, "ord int, id int, name string, full_name string, scope string")
    cands = resolve.candidate_keys_org(probe, "row_id", "said")
    keys = {}
    for r in cands.collect():
        keys.setdefault(r.row_id, []).append((r.cand_pos, r.key))
    for threshold in (0.9, 0.85, 0.75):
        want = {}
        for i, _, scope in rows:
            own = set((scope or "").split("/")) | {scope} if scope else set()
            best = min(((-SequenceMatcher(None, k, n, autojunk=False).ratio(), o, p) for _, o, n, _, s in records if not own or s in own for p, k in keys.get(i, [])), default=(0,))
            want[i] = best[1] if -best[0] >= threshold else None
        out = resolve.match_fuzzy(probe, "row_id", cands, cat, threshold, scopes=resolve.scope_keys(probe, "row_id", "scope"))
        assert {r.row_id: r.match_id for r in out.collect()} == want
        assert sum(v is not None for v in want.values()) > 40


def test_the_bag_bound_is_one(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aab c.") for _ in range(rng.randrange(1, 14)))
    pairs = [(word(), word()) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("bound", resolve.bag_bound(F.col("a"), F.col("b"))).collect()
    for r in rows:
        assert r.bound == SequenceMatcher(None, r.a, r.b, autojunk=False).quick_ratio() >= SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()


def test_expansion_of_a_leading_credential(spark):
    terms = spark.createDataFrame([(1, "icu", "Intensive Care"), (2, "ot - home", "Home Therapy"), (3, "pt", "Physical Therapist")], "priority int, key string, canonical string")
    heads = spark.createDataFrame([(1, "OT", "Occupational Therapist"), (2, "ot", "Other"), (3, "PT", "Physical Therapist")], "priority int, key string, expansion string")
    names = spark.createDataFrame([("Occupational Therapist - Acute Care",), ("Physical Therapist/Pool",)], "name string")
    rows = [(1, "OT - acute  care"), (2, "ot/Acute-Care"), (3, "OT – Acute Care"), (4, "OT - Home"), (5, "OT - Sea"), (6, "X1 - Acute Care"), (7, "PT - pool"), (8, "ICU"), (9, None), (10, ""), (11, "OT Acute Care")]
    got = {r.i: r.canonical for r in resolve.expand_term(spark.createDataFrame(rows, "i int, said string"), "said", terms, heads, names).collect()}
    acute = "Occupational Therapist - Acute Care"
    assert got == {1: acute, 2: acute, 3: acute, 4: "Home Therapy", 5: None, 6: None, 7: None, 8: "Intensive Care", 9: None, 10: None, 11: None}


def test_longest_whole_words_of_a_large_dictionary(spark):
    words = spark.range(100_000).selectExpr("concat('term ', id, ' of many') as word").unionByName(spark.createDataFrame([("line",), ("arterial line",), ("IV/PICC",), ("a b c d e f g h i j",), ("",), (None,)], "word string"))
    said = ["Arterial-line work", "deadline", "the LINE", "iv picc", "level iv", "put Term 4321 of many here", "term 4321 of", "x a b c d e f g h i j y", None, " "]
    terms = spark.createDataFrame(list(enumerate(said)), "pos int, term string").withColumn("doc_id", F.lit(1))
    got = {r.pos: r.word for r in resolve.word_hits(terms, words).collect()}
    assert got == {0: "arterial line", 2: "line", 3: "IV/PICC", 5: "term 4321 of many", 7: "a b c d e f g h i j"}


def test_terms_once_in_order_with_groups(spark):
    terms = [(1, 0, " ICU "), (1, 1, "intensive care"), (1, 2, "bls"), (1, 3, "Knitting"), (1, 4, "KNITTING"), (1, 5, "EKG rhythms"), (1, 6, " "), (2, 0, None), (3, 0, "Unit X")]
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    dictionary = one([(1, "icu", "Intensive Care"), (2, "unit x", "Unit X")], "priority int, key string, canonical string")
    out = resolve.validate_term_tables(one(terms, "doc_id int, pos int, term string"), dictionary, one([("intensive care", "Critical")], "name string, group string"), one([("BLS",)], "name string"), one([("ekg",)], "word string"))
    got = {r.doc_id: (r.total, r.recognised, r.ratio, r.known, r.unknown, r.groups) for r in out.collect()}
    assert got == {1: (4, 3, 0.75, ["Intensive Care", "bls", "EKG rhythms"], ["Knitting"], {"Intensive Care": "Critical", "bls": "Certification", "EKG rhythms": "Clinical Skill"}), 3: (1, 1, 1.0, ["Unit X"], [], {})}


def test_cities_bring_their_place(spark):
    states = spark.createDataFrame([(1, 10, 1, "MI", "Michigan"), (2, 11, 1, "NY", "New York"), (3, 20, 2, "NY", "Nyland")], "ord int, id int, country_id int, code string, name string")
    cities = spark.createDataFrame([(100, "Lansing", 10, 1), (101, "Batavia", 11, 1), (102, "Batavia", 10, 1)], "id int, city string, state_id int, country_id int")
    docs = spark.createDataFrame([(1, "1 Road, Lansing, MI 48901"), (2, "somewhere"), (3, None), (4, "2 Road\nTown, New York"), (5, None), (6, "x, MI")], "doc_id int, address string")
    rows = [
        (1, 0, None, None, "Lansing", None), (1, 1, 1, 11, "Batavia", None), (1, 2, None, None, "Batavia", None), (1, 3, None, 11, "Lansing", None),
        (2, 0, 1, 11, "Batavia", None), (2, 1, None, None, "Batavia", None), (3, 0, None, None, "Lansing", None), (4, 0, None, None, "batavia", None), (4, 1, None, None, "Lansing", None),
        (5, 0, 1, 11, None, None), (5, 1, 1, 10, None, None), (5, 2, None, None, "Lansing", None), (6, 0, None, None, "Batavia", 7), (6, 1, None, None, None, None),
    ]
    out = resolve.resolve_role_cities(docs, spark.createDataFrame(rows, "doc_id int, pos int, country_id int, state_id int, city string, city_id int"), states, cities)
    got = {(r.doc_id, r.pos): (r.city_id, r.country_id, r.state_id, r.state_confidence) for r in out.collect()}
    assert got == {
        (1, 0): (100, 1, 10, 1.0), (1, 1): (101, 1, 11, None), (1, 2): (102, 1, 10, 1.0), (1, 3): (100, 1, 11, None), (2, 0): (101, 1, 11, None), (2, 1): (101, 1, 11, 1.0), (3, 0): (None, None, None, None),
        (4, 0): (101, 1, 11, 1.0), (4, 1): (None, None, None, None), (5, 0): (None, 1, 11, None), (5, 1): (None, 1, 10, None), (5, 2): (None, None, None, None), (6, 0): (7, None, None, None), (6, 1): (None, None, None, None),
    }


RULES = {"experience": ["experience"], "education": ["education"], "skills": ["skills"], "summary": ["summary"], "certifications": ["certifications"]}
JOBS = "Nurse\nMercy\nMay 2019 - Present\n- cared"


def test_records_with_and_without_sections(spark):
    texts = {
        1: f"Ann Lee, RN\nann@x.org +1 415 555 0100\nSummary\nkind\nExperience\n{JOBS}\nEducation\nBachelor of Arts\nState University\n2001\nSkills\nEKG, IV\nCertifications\nBLS; ACLS",
        2: f"Bo Diaz\nhttps://github.com/bo\n\n{JOBS}\n\nCook\nDiner\n2001 - 2003",
        3: None, 4: "", 5: "1\n2\n3\n4\n5\nLate Name", 6: f"Skills\nEKG\nEducation\nnothing here\n{JOBS}",
    }
    out = segment.documents_to_records(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), RULES, r"(?i)\bbachelor\b", r"(?i)\buniversity\b")
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(texts)
    one, two = got[1], got[2]
    assert (one.name, one.email, one.phone, one.summary, one.skills, one.certifications) == ("Ann Lee", "ann@x.org", "+1 415 555 0100", "kind", ["EKG", "IV"], ["BLS", "ACLS"])
    assert [(e.role, e.company, e.start_date, e.end_date, e.is_current, e.description) for e in one.experience] == [("Nurse", "Mercy", "05/2019", "Present", True, ["cared"])]
    assert [(e.degree, e.institution, e.year) for e in one.education] == [("Bachelor of Arts", "State University", 2001)]
    # no sections: the roles come from the whole text, the name from its first five lines
    assert (two.name, two.github, [e.role for e in two.experience], two.skills, two.education) == ("Bo Diaz", "https://github.com/bo", ["Nurse", "Cook"], [], [])
    assert got[5].name is None and got[3].experience == [] and got[4].skills == []
    assert got[6].experience == []  # it has sections, though none of experience


def test_sketches_and_exact_ranks(spark):
    rng = random.Random(6)
    values = [rng.lognormvariate(3, 2) for _ in range(20_000)] + [5.0] * 4000
    rows = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)] + [(0, None)], "day int, duration_ms double")
    ordered = sorted(values)
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    exact = rollup.nearest_ranks(rows, "duration_ms", ps).first()
    assert exact.n == len(values) and [exact[k] for k in ps] == [ordered[round(p * (len(values) - 1))] for p in ps.values()]
    none = rollup.nearest_ranks(rows.filter("false"), "duration_ms", ps).first()
    assert none.n == 0 and none.p50 is None
    days = rollup.latency_sketches(rows, "day").withColumn("all", F.lit(1))
    told = rollup.sketch_percentiles(days, "all", {"p50": 0.5, "p95": 0.95}).first()
    assert told.n == len(values)
    for p, v in ((0.5, told.p50), (0.95, told.p95)):
        low, high = sum(x < v for x in values), sum(x <= v for x in values)
        off = max(0, low - p * len(values), p * len(values) - high) / len(values)
        assert off <= 0.017


def test_alike_names_meet_their_own_record_only(spark, monkeypatch):
    rng = random.Random(4)
    orgs = [(i, i, f"General Supplier {i:09d} Hospital") for i in rng.sample(range(100_000), 120)]
    said = [(i, n if k % 4 == 0 else n.replace("spit", "spt") if k % 4 == 1 else n.replace("General ", "") if k % 4 == 2 else "unknown") for k, (i, _, n) in enumerate(orgs)]
    met = []
    rated = resolve.rated
    monkeypatch.setattr(resolve, "rated", lambda pairs, *rest: met.append(pairs) or rated(pairs, *rest))
    probe = spark.createDataFrame(said, "row_id int, said string")
    out = resolve.match_org(probe, "row_id", "said", spark.createDataFrame(orgs, "ord int, id int, name string"), ("hospital", "general"))
    got = {r.row_id: (r.match_id, r.match_tier) for r in out.collect()}
    tiers = ("name", "fuzzy", "containment", None)
    assert got == {i: (i if k % 4 < 3 else None, tiers[k % 4]) for k, (i, _) in enumerate(said)}
    assert sum(p.count() for p in met) < 2 * len(orgs)


def test_a_key_one_character_over_is_not_always_the_best(spark):
    cat = [(i, i, n, None) for i, n in enumerate(("abcabcabd", "bcabcab", "general ward", "generals ward", "ward b", "ward c"))]
    probe = spark.createDataFrame([(1, "abcabcab"), (2, "general wards"), (3, "ward a"), (4, "generalward"), (5, "ward bc")], "row_id int, said string")
    catalog = spark.createDataFrame(cat, "ord int, id int, name string, full_name string")
    cands = resolve.candidate_keys_org(probe, "row_id", "said")
    for t in (0.8, 0.9):
        got, want = ({tuple(r) for r in resolve.match_fuzzy(probe, "row_id", cands, catalog, t, blocked=b).collect()} for b in (True, False))
        assert got == want


def test_documents_are_segmented_in_one_pass(spark):
    rules = {"work": ["work", "jobs & posts"], "skills": ["skills"]}
    rows = [(1, 0, "Ann"), (1, 1, "WORK:"), (1, 2, " a "), (1, 3, ""), (1, 4, "Skills"), (1, 5, "b"), (1, 6, "jobs & posts"), (1, 7, "c"), (2, 0, "x"), (2, 1, "Skills"), (2, 2, "y"), (3, 0, "Work"), (3, 1, "Skills"), (3, 2, "z"), (4, 0, "skills and work")]
    lines = segment.section_headers(spark.createDataFrame(rows, "doc_id int, pos int, text string"), rules)
    out = segment.segment(lines)
    assert sorted(map(tuple, out.collect())) == [
        (1, 0, "header", "Ann"), (1, 1, "work", "a \n\nc"), (1, 2, "skills", "b"), (2, 0, "full_text", "x\nSkills\ny"), (3, 0, "full_text", "Work\nSkills\nz"), (4, 0, "full_text", "skills and work"),
    ]
    # the lines are read once, and shuffled once
    plan = segment.segment(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_lines_take_a_partition_for_so_many_orders(spark, tmp_path):
    from loomfield.plans import intake_queries
    from loomfield.sources.tables import parts_of

    o = spark.range(1000).selectExpr("id o_orderkey", "id % 90 o_custkey", "'F' o_orderstatus", "timestamp '1998-02-06' o_orderdate", "'5-LOW' o_orderpriority")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    assert parts_of(spark.read.parquet(f"{tmp_path}/orders.parquet"), 100) == 10 and parts_of(o, 10**6) == spark.sparkContext.defaultParallelism
    plan = intake_queries.QUERIES["x2_segment"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "REPARTITION_BY_NUM" in plan


def test_rebalanced_buckets_meet_in_one_grouping(spark):
    from loomfield.operators.reconcile import rebalance_buckets

    df = lambda rows: spark.createDataFrame(rows, "doc_id int, name string")
    skills, certs, licenses = df([(1, "BLS"), (1, "lift"), (1, "Rn"), (2, None)]), df([(1, "RN "), (1, "acls"), (2, None), (3, "bls")]), df([(3, "Bls"), (2, None)])
    got = rebalance_buckets(skills, certs, licenses, ["rn"], ["bls"], 3)
    assert [Counter(map(tuple, x.collect())) for x in got] == [Counter([(1, "lift"), (2, None)]), Counter([(1, "BLS"), (1, "acls"), (2, None)]), Counter([(1, "RN "), (3, "Bls"), (2, None)])]
    assert all("Join" not in x._jdf.queryExecution().executedPlan().toString() for x in got)


def test_leaves_meet_in_as_many_partitions_as_told(spark):
    from loomfield.operators import jsondiff

    rows = spark.createDataFrame([(i, "a", str(i), ["a"]) for i in range(9)], "id int, path string, value string, sort array<string>")
    assert "REPARTITION_BY_NUM" in jsondiff.json_diff(rows, rows, 7)._jdf.queryExecution().executedPlan().toString()
