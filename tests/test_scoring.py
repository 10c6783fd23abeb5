"""Extraction scores on literal records, and the substring join against all pairs."""

import random

from loomfield.operators import scoring

OUT = "doc_id long, personal struct<full_name:string,email:string,phone:string,phone_secondary:string,credentials:array<string>>, experience array<struct<company:string,role:string,start_date:string,end_date:string,city_id:string,state_id:string,specialties:array<struct<specialty_id:string>>>>, education array<struct<institution:string>>"
LABEL = "doc_id long, personal struct<full_name:string,email:string,phone_digits:string,credentials:array<string>>, experience array<struct<company_key:string,start_date:string,end_date:string,catalog_city:boolean,state_id:int>>, education_keys array<string>, negatives struct<no_phone_secondary_digits:array<string>,no_specialty_id:array<string>>"


def role(company="Mercy General Hospital", title="Staff Nurse", start="03/2020", end="Present", city="7", state="12", ids=()):
    return (company, title, start, end, city, state, [(i,) for i in ids])


def person(second=None, phone="+1 (415) 555-0100", creds=("RN", "BSN")):
    return ("Ana  Lima", "ANA@example.org", phone, second, list(creds))


ASKED = ("ana lima", "ana@example.org", "14155550100", ["rn"])
KEY = ("mercy  General", "03/2020", "present", True, 12)


def scores(spark, out, label):
    rows = scoring.score_records(spark.createDataFrame(out, OUT), spark.createDataFrame(label, LABEL)).collect()
    return {r.metric: (r.hit, r.miss) for r in rows}


CASES = [
    # all right
    ([person(), [role()], [("State College of Nursing",)]], [ASKED, [KEY], ["college of"], None], {"contact": (3, 0), "credentials": (1, 0), "role_recall": (1, 0), "date_accuracy": (2, 0), "city_resolution": (1, 0), "geo_ids": (1, 0), "role_precision": (1, 0), "education": (1, 0)}),
    # the first role that holds the key is judged; a later one that fits better is not
    ([None, [role(start="01/2001"), role()], None], [None, [KEY], None, None], {"role_recall": (1, 0), "date_accuracy": (1, 1), "city_resolution": (1, 0), "geo_ids": (1, 0), "role_precision": (2, 0)}),
    # a placeholder employer is found by its title; an invented role costs precision only
    ([None, [role("Various", "Travel Tech"), role("Nowhere Inc", "Wizard")], None], [None, [("travel tech", None, None, None, None)], None, None], {"role_recall": (1, 0), "role_precision": (1, 1)}),
    # a missing role counts against recall, and what it states isn't judged
    ([None, [], []], [None, [KEY], ["x"], None], {"role_recall": (0, 1), "education": (0, 1)}),
    # an unresolved city counts where the catalog has it
    ([None, [role(city=None, state="9")], None], [None, [KEY], None, None], {"role_recall": (1, 0), "date_accuracy": (2, 0), "city_resolution": (0, 1), "geo_ids": (0, 1), "role_precision": (1, 0)}),
    ([None, [role(city=None)], None], [None, [("mercy", None, None, False, None)], None, None], {"role_recall": (1, 0), "role_precision": (1, 0)}),
    # negatives: values that must not be there
    ([person(second="555-0199"), [role(ids=["41", None])], None], [None, [], [], (["5550199", "1"], ["41", "42"])], {"negatives": (2, 2), "role_precision": (0, 1)}),
    ([person(), [], None], [None, None, None, (["5550199"], ["41"])], {"negatives": (2, 0)}),
    # an empty key finds no role, but is in every row's text
    ([None, [role(), role("A", "B")], None], [None, [("  ", None, None, None, None), ("a", None, None, None, None)], None, None], {"role_recall": (1, 1), "role_precision": (2, 0)}),
    ([("Someone", None, None, None, None), None, None], [ASKED, None, None, None], {"contact": (0, 3), "credentials": (0, 1)}),
]


def test_metrics(spark):
    outs = [(i, *out) for i, (out, _, _) in enumerate(CASES)] + [(99, *CASES[0][0])]
    labels = [(i, *label) for i, (_, label, _) in enumerate(CASES)]
    got = {}
    for r in scoring.score_records(spark.createDataFrame(outs, OUT), spark.createDataFrame(labels, LABEL)).collect():
        got.setdefault(r.doc_id, {})[r.metric] = (r.hit, r.miss)
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_documents_without_output_miss(spark):
    assert scores(spark, [], [(1, ASKED, [KEY], ["a"], (["1"], None))]) == {"contact": (0, 3), "credentials": (0, 1), "role_recall": (0, 1), "education": (0, 1), "negatives": (1, 0)}
    assert scores(spark, [(1, None, [role()], None)], []) == {}


def test_substring_join_is_the_cross_join(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(rng.randrange(n)))
    texts = [(i % 5, i, word(14)) for i in range(200)]
    keys = [(i % 5, i, word(6)) for i in range(120)]
    want = sorted((d, t, k) for d, t, x in texts for e, k, y in keys if d == e and y and y in x)
    got = scoring.find_keys(spark.createDataFrame(texts, "doc_id long, text_pos int, text string"), spark.createDataFrame(keys, "doc_id long, key_pos int, key string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
