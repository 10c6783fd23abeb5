"""Stateful job streams: order, redelivery, late rows, and the end of state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomfield.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)
FAR = timedelta(days=30)  # a row that far on takes the watermark past all others


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def run(spark, tmp_path, schema, files, operator, rows_only=True):
    """The operator over a stream of one file a micro-batch."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = jobs.run_available(operator(source), f"{tmp_path}/run", conf=stateful.STATE_STORE)
    return sorted((tuple(r) for r in out.collect()), key=str)


def left_in(spark, tmp_path, name):
    return spark.read.format("statestore").option("path", f"{tmp_path}/run/state").option("stateVarName", name).load().count()


EVENTS = "batch_id long, job_id long, ts timestamp, action string, total long"


def test_batches_complete_once(spark, tmp_path):
    files = [
        [(1, 11, at(0), "claim", 2), (1, 11, at(1), "completed", None), (2, 21, at(1), "failed", 2), (None, 5, at(1), "completed", 1)],
        # 11 is delivered again, and ends a second time; 12 ends the batch; 21 ended earlier as completed
        [(1, 11, at(1), "completed", None), (1, 11, at(2), "failed", None), (1, 12, at(3), "failed", None), (2, 21, at(0), "completed", None)],
        [(1, 12, at(3), "failed", None), (1, 13, at(4), "completed", None), (2, 22, at(5), "completed", None), (2, None, at(5), "completed", None), (2, 23, at(5), None, None)],
        [(3, 31, at(60), "completed", 2)],
        [(4, 41, at(60), "claim", 2)],  # rows up to minute 50 are late from here on
        [(2, 22, at(6), "completed", None), (3, 32, at(20), "completed", None)],  # both late
    ]
    got = run(spark, tmp_path, EVENTS, files, stateful.batch_events)
    want = [(1, "batch.completed", 2, 1, "partial"), (2, "batch.completed", 2, 0, "completed")]
    assert got == sorted(want, key=str)
    assert left_in(spark, tmp_path, "jobs") == 1  # the one job of the batch that waits


def test_state_of_batches_goes(spark, tmp_path):
    files = [[(b, b, at(b), "completed", 2) for b in range(50)], [(99, 1, at(0) + FAR, "claim", 5)]]
    assert run(spark, tmp_path, EVENTS, files, stateful.batch_events) == []
    assert left_in(spark, tmp_path, "jobs") == 0 and left_in(spark, tmp_path, "batch") == 1


JOBS = "job_id long, ts timestamp, action string"


def test_jobs_change_and_expire(spark, tmp_path):
    files = [
        [(1, at(2), "claim"), (1, at(1), "claim"), (2, at(1), "completed"), (3, at(1), None)],
        [(1, at(3), "failed"), (1, at(4), "completed"), (2, at(2), "claim"), (1, at(3), "failed")],
        [(9, at(80), "claim")],  # past the first jobs' hour, by the delay too
        [(9, at(81), "partial")],
    ]
    got = run(spark, tmp_path, JOBS, files, stateful.job_states)
    want = [(1, "processing", at(1)), (1, "failed", at(1)), (1, "expired", at(1)), (2, "processing", None), (2, "completed", at(2)), (2, "expired", at(2)), (3, "processing", None), (3, "expired", None), (9, "processing", at(80)), (9, "partial", at(80))]
    assert got == sorted(want, key=str)


def test_state_of_many_jobs_stays_bounded(spark, tmp_path):
    files = [[(1000 * h + i, at(180 * h + i % 60), "claim") for i in range(200)] for h in range(4)]
    got = run(spark, tmp_path, JOBS, files, stateful.job_states)
    assert sum(r[1] == "expired" for r in got) == 600
    assert left_in(spark, tmp_path, "job") == 200  # those of the last hour


def plain_circuits(rows, n, reset):
    """rows (url, id, ts, ok), by the clock: what a circuit breaker does that is asked at
    each delivery."""
    out = []
    for url in {r[0] for r in rows}:
        count = 0
        for _, _, ts, ok in sorted((r for r in rows if r[0] == url), key=lambda r: (r[2], r[1])):
            if count >= n and ts - last >= timedelta(seconds=reset):  # noqa: F821
                out.append((url, since, last + timedelta(seconds=reset)))  # noqa: F821
                count = 0
            if ok:
                if count >= n:
                    out.append((url, since, ts))  # noqa: F821
                count = 0
            else:
                count, last = count + 1, ts
                since = ts if count == n else since if count > n else None  # noqa: F821
        if count >= n:
            out.append((url, since, last + timedelta(seconds=reset)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_circuits_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, t = [], T0
    for i in range(400):
        t += timedelta(seconds=rng.choice([0, 5, 30, 200, 301]))
        rows.append((f"u{rng.randrange(4)}", i, t, rng.random() < 0.25))
    rows.append((None, 400, t, False))
    want = plain_circuits(rows[:-1], 3, 300)
    schema = "url string, id long, ts timestamp, ok boolean"
    assert len(want) > 15
    table = spark.createDataFrame(rows, schema)
    assert sorted((tuple(r) for r in stateful.circuits(table, 3, 300).collect()), key=str) == want
    # four files in order, shuffled inside each and across their edges by less than the delay
    files = [rows[:100], rows[100:200], rows[200:300], rows[300:]]
    for a, b in zip(files, files[1:], strict=False):
        a[-5:], b[:5] = b[:5], a[-5:]
    for f in files:
        rng.shuffle(f)
    files.append([("end", 9999, t + FAR, True)])
    assert run(spark, tmp_path, schema, files, lambda s: stateful.circuit_stream(s, 3, 300, "1 hour")) == want
    assert left_in(spark, tmp_path, "waiting") == 1 and left_in(spark, tmp_path, "now") <= 5


def test_rule_packs_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [("s", f"p{rng.randrange(12)}", i, at(i / 10), rng.choice(["propose", "approve", "reject", "enable", "disable", None]), [f"r{i}"] * rng.randrange(3)) for i in range(300)]
    rows += [("t", "told", 300, at(31), "propose", None), (None, "lost", 301, at(31), "propose", ["x"])]
    schema = "scope string, owner string, seq long, ts timestamp, action string, rules array<string>"
    batch = jobs.rule_pack_fold(spark.createDataFrame(rows, schema).filter("scope = 's'").drop("ts"))
    want = {r.owner: (r.rules, r.proposed, r.status, r.version) for r in batch.collect()}
    mixed = rows[:]
    rng.shuffle(mixed)
    files = [mixed[:120], mixed[120:], [("end", "end", 0, at(0) + FAR, "enable", [])]]
    source = None
    for i, f in enumerate(files):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = jobs.run_available(stateful.rule_packs(source, "1 hour"), f"{tmp_path}/run", key=["scope", "owner"], conf=stateful.STATE_STORE)
    got = {r.owner: (r.rules, r.proposed, r.status, r.version) for r in out.collect()}
    assert got.pop("told") == ([], [], "pending", 1)
    assert got == want
    assert left_in(spark, tmp_path, "waiting") == 1
    assert out.filter(F.col("owner") == "end").isEmpty()


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, EVENTS, [[]], stateful.batch_events) == []
    assert stateful.circuits(spark.createDataFrame([], "url string, id long, ts timestamp, ok boolean")).count() == 0
