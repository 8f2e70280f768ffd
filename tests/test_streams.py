"""Streams over several files give what batches give."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from bagflow.jobs.registry import log
from bagflow.operators import bags, feeds, keyed
from bagflow.streaming import live


def source(spark, sf, tmp_path, parts=3):
    ev = log(spark, sf).select("event_id", "user_id", "event_type", "cents", "lat", "lon", "ts")
    step = F.col("event_id") % 1000
    for k in range(parts):
        ev.filter((step >= k * 1000 // parts) & (step < (k + 1) * 1000 // parts)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return ev, stream


def test_last_n(spark, sf, tmp_path):
    ev, stream = source(spark, sf, tmp_path)
    live.use_rocksdb(spark)
    feed = live.stream_diff(stream, 3, "user_id", "event_id", "cents")
    live.start(feed, str(tmp_path / "c"), path=str(tmp_path / "out")).awaitTermination()
    got = live.last_n_of(spark.read.parquet(str(tmp_path / "out")))
    want = feeds.last_n(ev, 3, "event_id", "user_id").select("user_id", "event_id", "cents")
    assert Counter(map(tuple, got.select("key", "step", "value").collect())) == Counter(map(tuple, want.collect()))


def test_majority_snapshots(spark, sf, tmp_path):
    ev, stream = source(spark, sf, tmp_path)
    live.use_rocksdb(spark)
    state = str(tmp_path / "state")
    live.start(live.stream_position_state(stream, "user_id", "event_id", "lat", "lon"), str(tmp_path / "c"), batch=live.stream_majority(spark, state)).awaitTermination()
    want = keyed.latest(keyed.user_state(ev, "user_id", "event_id", "lat", "lon").select("user_id", "event_id", "current_direction"), "user_id", "event_id")
    want = bags.majority(want.filter("current_direction is not null"), "current_direction")
    assert live.majority_of(live.snapshot(spark, state)).collect() == want.collect()


def test_lease_and_lost_versions(spark, sf, tmp_path):
    ev, stream = source(spark, sf, tmp_path)
    state = str(tmp_path / "state")
    live.start(stream, str(tmp_path / "c"), batch=live.stream_lease(state, "ts", "48 hours")).awaitTermination()
    assert live.snapshot(spark, state).count() == feeds.lease(ev, "48 hours", "ts").count()
    with pytest.raises(RuntimeError, match="no state of batch"):
        live._version(spark, str(tmp_path / "other"), 4)


def test_do_apply_gets_current_values(spark, sf, tmp_path):
    ev, stream = source(spark, sf, tmp_path)
    seen = []
    sides = [stream.filter(f"event_type = '{k}'") for k in ("click", "view")]
    tagged, batch = live.do_apply(lambda a, b: seen.append((a.count(), b.count(), a.columns)), str(tmp_path / "state"), *sides)
    live.start(tagged, str(tmp_path / "c"), batch=batch).awaitTermination()
    step = F.col("event_id") % 1000
    want = [[ev.filter(f"event_type = '{k}'").filter(step < n * 1000 // 3).count() for k in ("click", "view")] for n in (1, 2, 3)]
    assert sorted(list(s[:2]) for s in seen) == sorted(want) or [list(s[:2]) for s in seen][-1] == want[-1] and len(seen) == 3
    assert seen[0][2] == ev.columns
    # a batch that is repeated replaces its own rows
    live.start(tagged, str(tmp_path / "c"), batch=batch).awaitTermination()
    batch(ev.filter("event_id < 0").withColumn("__input", F.lit(0)), 99)
    assert len(seen) == 3


def test_delay_and_expiring_leases(spark, sf, tmp_path):
    ev, stream = source(spark, sf, tmp_path, parts=1)
    live.use_rocksdb(spark)
    feed = live.stream_diff(stream, 3, "user_id", "event_id", "cents")
    live.start(feed, str(tmp_path / "c"), path=str(tmp_path / "out")).awaitTermination()
    got = live.last_n_of(live.delayed(spark.read.parquet(str(tmp_path / "out"))))
    rows = feeds.last_n(ev, 4, "event_id", "user_id")
    want = rows.join(keyed.latest(ev.select("user_id", "event_id"), "user_id", "event_id"), ["user_id", "event_id"], "left_anti").select("user_id", "event_id", "cents")
    assert Counter(map(tuple, got.select("key", "step", "value").collect())) == Counter(map(tuple, want.collect()))
    timed = live.stream_lease_timers(stream, "user_id", "ts", "48 hours", "10 minutes")
    query = live.start(timed, str(tmp_path / "c2"), path=str(tmp_path / "out2"))
    query.awaitTermination()
    live_rows = live.leased_of(spark.read.parquet(str(tmp_path / "out2")))
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    newest = ev.agg(F.max(ms)).first()[0]
    assert live_rows.agg(F.sum("multiplicity")).first()[0] == ev.filter(ms + 48 * 3_600_000 > newest - 600_000).count()
    assert live.dropped_late(query) == 0


class Held:
    """A state variable in memory."""

    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    put = update = lambda self, x: setattr(self, "now", x)


def test_large_keys_are_not_held_whole():
    n = 120_000
    last, position = live.LastN(3, "step", "value", "long"), live.Position()
    last.held, position.held = Held(), Held()
    tracemalloc.start()
    ops = Counter(r.op for r in last.handleInputRows((1,), (Row(step=i * 7919 % n, value=i) for i in range(n)), None))
    step = -1
    for r in position.handleInputRows((1,), (Row(step=i * 7919 % n, lat=float(i * 7919 % n), lon=0.5) for i in range(n)), None):
        assert r.step == step + 1 and r.prev_lat == (float(step) if step >= 0 else None)
        step = r.step
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ops == {"add": n, "remove": n - 3} and [x[0] for x in last.held.now] == [n - 3, n - 2, n - 1]
    assert step == n - 1 and position.held.now == (float(n - 1), 0.5)
    assert peak < 25e6


def test_last_n_with_nulls_and_late_rows():
    last = live.LastN(2, "step", "value", "long")
    last.held = Held()
    feed = [[(5, None), (5, 1), (7, 2)], [(6, None), (1, 9), (None, 3)]]
    out = [r for batch in feed for r in last.handleInputRows((1,), iter([Row(step=s, value=v) for s, v in batch]), None)]
    left = Counter((r.step, r.value) for r in out if r.op == "add")
    left.subtract(Counter((r.step, r.value) for r in out if r.op == "remove"))
    assert +left == {(7, 2): 1, (6, None): 1} and last.held.now == [(6, None), (7, 2)]
    assert list(live.sorted_rows(iter([(2, "a"), (1, "b"), (None, "c"), (2, "d"), (1, "e")]), most=2, chunk=1)) == [(None, "c"), (1, "b"), (1, "e"), (2, "a"), (2, "d")]


def test_delay_of_a_batch_whose_rows_come_in_any_order():
    last = live.LastN(2, "step", "value", "long")
    last.held = Held()
    out = [r for r in last.handleInputRows((1,), (Row(step=s, value=s) for s in (4, 1, 3, 2)), None) if r.at < 4]
    left = Counter(r.step for r in out if r.op == "add")
    left.subtract(r.step for r in out if r.op == "remove")
    assert sorted((+left).elements()) == [2, 3]


class Handle:
    """State variables and timers of one key in memory, with the number of calls."""

    def __init__(self):
        self.now, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, *schemas):  # noqa: N802
        return MapOf(self)

    def getValueState(self, name, schema):  # noqa: N802
        held = Held()
        held.clear = lambda: setattr(held, "now", None)
        return held

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class MapOf:
    def __init__(self, handle):
        self.handle = handle

    def _called(self):
        self.handle.calls += 1
        return self.handle.now

    def containsKey(self, key):  # noqa: N802
        return key in self._called()

    def getValue(self, key):  # noqa: N802
        return self._called()[key]

    def updateValue(self, key, value):  # noqa: N802
        self._called()[key] = value

    def removeKey(self, key):  # noqa: N802
        del self._called()[key]


class Clock:
    """A watermark, and the time of a timer that ran out."""

    def __init__(self, now, at=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: now, lambda: at


def expire(leased, handle, now):
    for at in sorted(t for t in handle.timers if t <= now):
        yield from leased.handleExpiredTimer((1,), Clock(now), Clock(now, at))
        handle.timers.discard(at)


def test_leases_by_parts_give_back_every_time_once_it_has_passed():
    rnd = random.Random(3)
    leased, handle = live.Leased("ts", 50, most=4), Handle()
    leased.init(handle)
    alive, now = Counter(), 0
    for _ in range(60):
        arrived = [rnd.randrange(now, now + 40) for _ in range(rnd.choice([1, 3, 30]))]
        assert [r.at_ms for r in leased.handleInputRows((1,), (Row(__ms=t) for t in arrived), Clock(now))] == sorted(arrived)
        alive.update(arrived)
        now = max(now, max(arrived) - rnd.choice([0, 10]), now + rnd.choice([0, 60]))
        gone = {t: n for t, n in alive.items() if t + 50 <= now}
        assert [(r.at_ms, r.n) for r in expire(leased, handle, now)] == sorted(gone.items())
        alive = Counter({t: n for t, n in alive.items() if t not in gone})
        assert len(handle.timers) == bool(alive) and all(len(at) <= 4 for at, _ in handle.now.values())
    list(expire(leased, handle, now + 1000))
    assert not handle.now and not handle.timers


def test_leases_cost_few_state_calls():
    leased, handle = live.Leased("ts", 50), Handle()
    leased.init(handle)
    assert len(list(leased.handleInputRows((1,), (Row(__ms=t) for t in range(10_000)), Clock(0)))) == 10_000
    assert sum(r.n for r in expire(leased, handle, 9000)) == 8951
    assert handle.calls < 50
