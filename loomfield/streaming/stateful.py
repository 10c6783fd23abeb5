"""Job logs as keyed stateful streams, with event-time timers.

Each operator is a transformWithStateInPandas over a stream with a watermark. Times go
through Python as microseconds, so the session's time zone plays no part. Rows later
than the watermark, and rows without a time or a key, drop. State has an end everywhere:
a timer clears what no row can reach any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomfield.streaming.jobs import FINAL

HOUR = 3_600_000  # ms

#: What these operators need of the session that runs them.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _keyed(stream: DataFrame, ts: str, delay: str, keys: list[str], columns: list) -> tuple:
    """The stream with a watermark, grouped by its keys; us is the time in microseconds.
    Rows without a time, or without a key, which Python would tell from itself, drop.
    (No name starts with an underscore: the rows pass through named tuples.)"""
    rows = stream.withWatermark(ts, delay).select(*keys, ts, F.unix_micros(ts).alias("us"), *columns).dropna(subset=[ts, *keys])
    return rows.groupBy(*keys), ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def _frame(key: tuple, keys: list[str], rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([dict(zip(keys, key, strict=True)) | r for r in rows])


class _Moving:
    """One timer of a key, which is moved instead of added to."""

    def __init__(self, handle):
        self.handle = handle
        self.at = handle.getValueState("timer", "at long")

    def move(self, to: int | None) -> None:
        was = self.at.get()[0] if self.at.exists() else None
        if was == to:
            return
        if was is not None:
            self.handle.deleteTimer(was)
        if to is None:
            self.at.clear()
        else:
            self.handle.registerTimer(to)
            self.at.update((to,))

    def spent(self) -> None:
        """The timer has fired."""
        self.at.clear()

    def get(self) -> int | None:
        return self.at.get()[0] if self.at.exists() else None


class _BatchProgress(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.timer = _Moving(handle)
        self.batch = handle.getValueState("batch", "total long, ended long, failed long, done boolean")
        self.jobs = handle.getMapState("jobs", "job_id string", "us long, failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, ended, failed, done = self.batch.get() if self.batch.exists() else (0, 0, 0, False)
        last = 0
        for df in rows:
            last = max(last, int(df["us"].max()))
            if done:
                continue
            most = df["total"].max()
            total = max(total, 0 if pd.isna(most) else int(most))
            for r in df[df["ended"]].sort_values(["us", "bad"]).drop_duplicates("job").to_dict("records"):
                job, us, bad = (r["job"],), int(r["us"]), bool(r["bad"])
                if not self.jobs.containsKey(job):
                    ended, failed = ended + 1, failed + bad
                else:  # an earlier end of a job that has been counted
                    was = self.jobs.getValue(job)
                    if (was[0], was[1]) <= (us, bad):
                        continue
                    failed += bad - bool(was[1])
                self.jobs.updateValue(job, (us, bad))
        if not done and 0 < total <= ended:
            done = True
            self.jobs.clear()  # one flag is left of the batch until its time is over
            status = "completed" if not failed else "failed" if failed == ended else "partial"
            yield _frame(key, ["batch_id"], [{"event": "batch.completed", "ended": ended, "failed": failed, "status": status}])
        self.batch.update((total, ended, failed, done))
        self.timer.move(max(self.timer.get() or 0, last // 1000 + self.ttl))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.spent()
        self.batch.clear()
        self.jobs.clear()
        return iter(())


def batch_events(events: DataFrame, delay: str = "10 minutes", ttl_ms: int = 24 * HOUR) -> DataFrame:
    """A stream of events (batch_id, job_id, ts, action, total: of the batch, may be null
    on job rows) to one batch.completed row a batch, when its distinct ended jobs reach
    its total: batch_id, event, ended, failed, status. A job counts once, by its earliest
    final action known; rows delivered again change nothing and repeat no event. A
    batch's state goes ttl_ms after its last row, and that of its jobs when it completes.
    Rows without an action or job only move the batch's time."""
    ended = F.coalesce(F.col("action").isin(*FINAL) & F.col("job_id").isNotNull(), F.lit(False))
    by, key = _keyed(events, "ts", delay, ["batch_id"], [F.col("job_id").cast("string").alias("job"), F.col("total").cast("long").alias("total"), ended.alias("ended"), (F.col("action") == "failed").alias("bad")])
    return by.transformWithStateInPandas(_BatchProgress(ttl_ms), f"{key}, event string, ended long, failed long, status string", "Append", "EventTime")


class _JobState(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.timer = _Moving(handle)
        self.job = handle.getValueState("job", "claimed long, ended long, action string, said string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        claimed, ended, action, said = self.job.get() if self.job.exists() else (None, None, None, None)
        last, before = 0, claimed
        for df in rows:
            last = max(last, int(df["us"].max()))
            claims, ends = df[df["action"] == "claim"], df[df["action"].isin(FINAL)]
            if len(claims):
                claimed = min(int(claims["us"].min()), claimed if claimed is not None else 1 << 62)
            if len(ends):
                us, act = min(zip(ends["us"].astype(int), ends["action"], strict=True))
                if ended is None or (us, act) < (ended, action):
                    ended, action = int(us), str(act)
        state = action if claimed is not None and ended is not None else "processing"
        if (state, claimed) != (said, before):
            yield _frame(key, ["job_id"], [{"state": state, "_claimed": claimed}])
        self.job.update((claimed, ended, action, state))
        self.timer.move(max(self.timer.get() or 0, last // 1000 + self.ttl))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        claimed = self.job.get()[0] if self.job.exists() else None
        self.timer.spent()
        self.job.clear()
        yield _frame(key, ["job_id"], [{"state": "expired", "_claimed": claimed}])


def job_states(events: DataFrame, delay: str = "10 minutes", ttl_ms: int = HOUR) -> DataFrame:
    """A stream of events (job_id, ts, action) to (job_id, state, claimed), a row at each
    change: the first claim by time starts a job, the first final action ends it, and
    pending reads as processing. A job's state goes ttl_ms after its last row, with a
    row whose state is expired; what comes after that begins anew."""
    by, key = _keyed(events, "ts", delay, ["job_id"], ["action"])
    out = by.transformWithStateInPandas(_JobState(ttl_ms), f"{key}, state string, _claimed long", "Append", "EventTime")
    return out.select("job_id", "state", F.timestamp_micros("_claimed").alias("claimed"))


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then folds them in order of time
    and sequence. What is held of a key is what came within the watermark's delay."""

    ROW = ""  # the columns after _us

    def init(self, handle) -> None:
        self.timer = _Moving(handle)
        self.waiting = handle.getListState("waiting", f"us long, {self.ROW}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = self.timer.get()
        for df in rows:
            new = [self.row(r) for r in df.to_dict("records")]
            self.waiting.appendList(new)
            soon = -(-min(r[0] for r in new) // 1000)  # a timer's time is in whole milliseconds
            first = soon if first is None else min(first, soon)
        self.timer.move(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.spent()
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready, later = [r for r in held if r[0] <= mark], [r for r in held if r[0] > mark]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        out, wake = self.fold(ready, mark)
        soon = [-(-t // 1000) for t in ([later[0][0]] if later else []) + ([wake] if wake is not None else [])]
        if soon:
            self.timer.move(max(min(soon), mark // 1000 + 1))
        if out:
            yield _frame(key, self.KEYS, out)

    def row(self, r: dict) -> tuple:
        raise NotImplementedError

    def fold(self, rows: list[tuple], mark: int) -> tuple[list[dict], int | None]:
        """(rows to put out, when to be called again though no row comes)."""
        raise NotImplementedError


def streak(state: tuple[int, int, int], us: int, ok: bool, n: int, reset: int) -> tuple[tuple[int, int, int], tuple[int, int] | None]:
    """One delivery against (failures in a row, since when open, last failure): the new
    state, and (open_from, open_to) of a circuit that this delivery finds closed or
    closes. An open circuit closes reset after its last failure and starts at nought."""
    count, since, last = state
    closed = None
    if count >= n and us - last >= reset:
        closed, count = (since, last + reset), 0
    if ok:
        if count >= n:
            closed = (since, us)
        return (0, 0, 0), closed
    count += 1
    return (count, us if count == n else since, us), closed


class _Circuits(_InOrder):
    KEYS, ROW = ["url"], "seq long, ok boolean"

    def __init__(self, n: int, reset: int):
        self.n, self.reset = n, reset

    def init(self, handle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "count long, since long, last long")

    def row(self, r: dict) -> tuple:
        return int(r["us"]), int(r["id"]), bool(r["ok"])

    def fold(self, rows, mark):
        state, out = tuple(self.now.get()) if self.now.exists() else (0, 0, 0), []
        for us, _, ok in rows:
            state, closed = streak(state, us, ok, self.n, self.reset)
            if closed:
                out.append(closed)
        count, since, last = state
        if count >= self.n and last + self.reset <= mark:
            out.append((since, last + self.reset))
            state = (0, 0, 0)
        if state[0]:
            self.now.update(state)
        else:
            self.now.clear()
        return [{"_from": a, "_to": b} for a, b in out], state[2] + self.reset if state[0] >= self.n else None


def circuit_stream(deliveries: DataFrame, n: int = 5, reset: int = 300, delay: str = "10 minutes") -> DataFrame:
    """A stream of deliveries (url, id, ts, ok) to (url, open_from, open_to), a row when
    a circuit closes: n failures in a row open it at the nth; it closes with a success,
    or by a timer reset seconds after the last failure, and failures count from nought
    again. Rows are taken in order of time and id once the watermark has passed them, so
    what the stream gives doesn't depend on the order in which they come. A missing ok
    counts as a failure."""
    by, key = _keyed(deliveries, "ts", delay, ["url"], [F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.coalesce("ok", F.lit(False)).alias("ok")])
    out = by.transformWithStateInPandas(_Circuits(n, reset * 1_000_000), f"{key}, _from long, _to long", "Append", "EventTime")
    return out.select("url", F.timestamp_micros("_from").alias("open_from"), F.timestamp_micros("_to").alias("open_to"))


def circuits(deliveries: DataFrame, n: int = 5, reset: int = 300, until=None) -> DataFrame:
    """circuit_stream() over a table: the circuits closed by `until` (a timestamp; None:
    all). Rows of a url are folded one after another in a sorted partition, with one
    state in memory, however many there are."""
    gap = reset * 1_000_000
    stop = F.lit(1 << 62) if until is None else F.unix_micros(until)
    rows = deliveries.select("url", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.coalesce("ok", F.lit(False)).alias("ok"), stop.alias("stop")).dropna(subset=["url", "us"]).filter("us <= stop")
    key = rows.schema["url"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        url, state, stop, seen = None, (0, 0, 0), 0, False

        def ended():
            return [(url, state[1], state[2] + gap)] if seen and state[0] >= n and state[2] + gap <= stop else []

        for df in batches:
            out = []
            for u, us, _, ok, stop_ in df.itertuples(index=False):
                if not seen or u != url:
                    out += ended()
                    url, state, seen = u, (0, 0, 0), True
                stop = stop_
                state, closed = streak(state, us, ok, n, gap)
                if closed:
                    out.append((u, *closed))
            yield pd.DataFrame(out, columns=["url", "_from", "_to"])
        yield pd.DataFrame(ended(), columns=["url", "_from", "_to"])

    out = rows.repartition("url").sortWithinPartitions("url", "us", "id").mapInPandas(run, f"url {key}, _from long, _to long")
    return out.select("url", F.timestamp_micros("_from").alias("open_from"), F.timestamp_micros("_to").alias("open_to"))


def next_pack(pack: tuple, action: str, rules: list[str]) -> tuple:
    """A rule pack (rules, proposed, status, version; status None before any proposal)
    after one action."""
    own, waiting, status, version = pack
    if action == "propose":
        return own, rules, "pending", version + 1
    if status is None:
        return pack
    if action == "approve":
        return (waiting, [], "active", version) if waiting else pack
    if action == "disable":
        return own, waiting, "disabled", version
    if action in ("reject", "enable"):
        return own, [] if action == "reject" else waiting, "active" if own else "none", version
    return pack


class _Packs(_InOrder):
    KEYS, ROW = ["scope", "owner"], "seq long, action string, rules array<string>"

    def init(self, handle) -> None:
        super().init(handle)
        self.pack = handle.getValueState("pack", "rules array<string>, proposed array<string>, status string, version int")

    def row(self, r: dict) -> tuple:
        return int(r["us"]), int(r["seq"]), r["action"], [] if r["rules"] is None else [str(x) for x in r["rules"]]

    def fold(self, rows, mark):
        own, waiting, status, version = self.pack.get() if self.pack.exists() else ([], [], None, 0)
        pack = (list(own), list(waiting), status, version)
        for _, _, action, rules in rows:
            pack = next_pack(pack, action, list(rules))
        self.pack.update(pack)
        own, waiting, status, version = pack
        said = {"rules": own if status == "active" else [], "proposed": waiting, "status": status or "none", "version": version}
        return [said] if rows else [], None


def rule_packs(actions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of actions (scope, owner, seq, ts, action, rules) to the packs' states as
    they change: scope, owner, rules, proposed, status, version. Actions wait until the
    watermark has passed them and are then folded in order of time and sequence number,
    so shuffled input comes to what jobs.rule_pack_fold gives. A pack's state stays, as a
    pack has no end; its actions don't."""
    by, key = _keyed(actions, "ts", delay, ["scope", "owner"], [F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), "action", "rules"])
    return by.transformWithStateInPandas(_Packs(), f"{key}, rules array<string>, proposed array<string>, status string, version int", "Append", "EventTime")
