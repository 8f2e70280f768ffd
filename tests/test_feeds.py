"""Collections after each step, by the scripts of FIXTURES.md and by a replay of the rules on random logs."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from bagflow.operators import feeds, pacing

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "seq long, ts timestamp, key string, value long"


def log(spark, text: str, times: list[int] | None = None):
    """Rows from 'a1 b2' (keyed) or '1 2' (all under one key), at times in ms."""
    items = text.split()
    rows = []
    for i, x in enumerate(items):
        key, value = (x[0], x[1:]) if x[0].isalpha() else ("", x)
        rows.append((i + 1, START + timedelta(milliseconds=times[i] if times else i), key, int(value)))
    return spark.createDataFrame(rows, SCHEMA)


def bag(df) -> Counter:
    return Counter(r["key"] + str(r["value"]) for r in df.collect())


SOURCES = [
    # log, times, buffer, lease, keyed, the bag after each step
    ("1 2 3", None, None, None, False, ["1", "1 2", "1 2 3"]),
    ("a1 b1 a2 a3", None, None, None, True, ["a1", "a1 b1", "a1 a2 b1", "a1 a2 a3 b1"]),
    ("1 2 3", None, 2, None, False, ["1", "1 2", "2 3"]),
    ("a1 b1 c1 a2 a3", None, 2, None, True, ["a1", "a1 b1", "a1 b1 c1", "a1 a2 b1 c1", "a2 a3 b1 c1"]),
    ("1 2 3 4", [0, 1000, 2100, 5100], None, 2, False, ["1", "1 2", "2 3", "4"]),
    ("a1 a2 a3 b1", [0, 1, 1001, 2101], None, 2, True, ["a1", "a1 a2", "a1 a2 a3", "a3 b1"]),
    ("1 2 3 4", [0, 1, 1001, 2101], 2, 2, False, ["1", "1 2", "2 3", "3 4"]),
    ("a1 a2 a3 b1", [0, 1, 1001, 2101], 2, 2, True, ["a1", "a1 a2", "a2 a3", "a3 b1"]),
    ("1 2 3 4 5 6 7", [0, 1, 2, 3, 4, 2104, 2105], 3, 2, False, ["1", "1 2", "1 2 3", "2 3 4", "3 4 5", "6", "6 7"]),
]


@pytest.mark.parametrize("text,times,n,seconds,keyed,expected", SOURCES)
def test_scripts(spark, text, times, n, seconds, keyed, expected):
    v = feeds.validity(log(spark, text, times), "seq", key="key" if keyed else None, n=n, timeout=f"{seconds} seconds" if seconds else None, ts="ts").cache()
    before = Counter()
    for step, want in enumerate(expected, 1):
        want = Counter(want.split())
        assert bag(feeds.state_at(v, step)) == want
        assert bag(feeds.delay(v, step)) == before
        assert bag(feeds.diff_remove(v, step)) == before + bag(feeds.diff_add(v, step)) - want
        before = want
    assert bag(feeds.states(v, 1, len(expected)).filter(F.col("step") == len(expected))) == before


def replay(rows, n, timeout, keyed):
    """Which steps each row enters and leaves at, by the rules, one step at a time."""
    held, out = [], {}
    for seq, t, key, _ in rows:
        for x in [x for x in held if timeout is not None and x[1] < t - timeout]:
            held.remove(x)
            out[x[0]] = seq
        mine = [x for x in held if x[2] == key or not keyed]
        if n is not None and len(mine) >= n:
            held.remove(mine[0])
            out[mine[0][0]] = seq
        held.append((seq, t, key))
    return out


@pytest.mark.parametrize("n,timeout,keyed", [(3, None, True), (None, 50, True), (2, 60, True), (4, None, False), (3, 40, False)])
def test_replay(spark, n, timeout, keyed):
    rnd = random.Random(7)
    t, rows = 0, []
    for i in range(400):
        t += rnd.choice([0, 1, 1, 2, 30])
        rows.append((i + 1, t, rnd.choice("abcde"), rnd.randrange(5)))
    df = spark.createDataFrame([(s, START + timedelta(milliseconds=ms), k, v) for s, ms, k, v in rows], SCHEMA)
    v = feeds.validity(df, "seq", key="key" if keyed else None, n=n, timeout=f"{timeout} milliseconds" if timeout else None, ts="ts")
    assert {r["seq"]: r["valid_to"] for r in v.collect() if r["valid_to"] is not None} == replay(rows, n, timeout, keyed)


def test_expiries_cross_buckets(spark):
    rows = [(i + 1, START + timedelta(seconds=10 * i if i < 40 else 4000 + i), "a", i) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    small = {r["seq"]: r["expire_at"] for r in feeds.expiries(df, "25 seconds", "ts", "seq", rows_per_bucket=3).collect()}
    times = [r[1] for r in rows]
    assert small == {i + 1: next((j + 1 for j in range(80) if times[j] > times[i] + timedelta(seconds=25)), None) for i in range(80)}


def test_ticks_keep_rows_that_come_and_go(spark):
    df = log(spark, "a1 a2 b1 a3", [0, 1, 2, 3])
    v = feeds.validity(df, "seq", key="key", n=2, ts="ts", tick="1 second")
    tick = v.first()["valid_from"]
    assert bag(feeds.diff_add(v, tick)) == Counter({"a1": 1, "a2": 1, "b1": 1, "a3": 1})
    assert bag(feeds.diff_remove(v, tick)) == Counter({"a1": 1})


def test_lease_renew(spark):
    df = log(spark, "1 2 1 3", [0, 500, 1900, 3000])
    assert bag(feeds.lease(df, "2 seconds", "ts")) == Counter(["1", "3"])
    assert bag(feeds.lease(df, "2 seconds", "ts", renew=True, element=["value"])) == Counter(["1", "1", "3"])


def test_dense_steps_and_running_sum(spark):
    df = spark.createDataFrame([(i * i, i) for i in range(1, 200)], "seq long, v long")
    got = {r["seq"]: r["step"] for r in feeds.dense_steps(df, "seq", rows_per_bucket=10).collect()}
    assert got == {i * i: i for i in range(1, 200)}
    sums = {r["seq"]: r["s"] for r in pacing.running_sum(df, "seq", "v", "s", rows_per_bucket=10).collect()}
    assert sums == {i * i: i * (i + 1) // 2 for i in range(1, 200)}


def test_throttle_fills_ticks(spark):
    df = log(spark, "1 2 3", [0, 100, 3500])
    got = [(r["tick"], r["value"]) for r in pacing.throttle(df, "1 second", "ts", "seq", "value").orderBy("tick").collect()]
    first = got[0][0]
    assert [(t - first, v) for t, v in got] == [(0, 2), (1, 2), (2, 2), (3, 3)]


def test_empty_logs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert feeds.validity(empty, "seq", n=2, timeout="1 second", ts="ts").count() == 0
    assert feeds.lease(empty, "1 second", "ts").count() == 0
    assert pacing.running_sum(empty, "seq", "value", "s").count() == 0
    assert pacing.throttle(empty, "1 second", "ts", "seq", "value").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_bursts_and_outliers_spread_over_ranges(spark, seed):
    """90 % of the rows in one hour of a year, and one time far from all others."""
    rnd = random.Random(seed)
    start = 1_700_000_000
    times = sorted([start + rnd.randrange(3600) for _ in range(1800)] + [start + rnd.randrange(86400 * 365) for _ in range(199)] + [start + 10**9])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    numbered = df.withColumn("b", feeds.ranges(df, F.col("t"), 50))
    sizes = [r["count"] for r in numbered.groupBy("b").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 200 and len(sizes) > 20
    order = [r["b"] for r in numbered.orderBy("t").collect()]
    assert order == sorted(order)
    many = df.withColumn("b", feeds.ranges(df, F.col("t"), 10, most_cuts=7))
    order = [r["b"] for r in many.orderBy("t").collect()]
    assert order == sorted(order) and len(set(order)) > 20
    got = {r["seq"]: r["expire_at"] for r in feeds.expiries(df, "60 seconds", "ts", "seq", rows_per_bucket=50).collect()}
    assert got == {i: next((j for j in range(i, 2000) if times[j] > t + 60), None) for i, t in enumerate(times)}
    gaps = df.withColumn("seq", F.col("seq") * F.col("seq"))
    assert {r["seq"]: r["step"] for r in feeds.dense_steps(gaps, "seq", rows_per_bucket=50).collect()} == {i * i: i + 1 for i in range(2000)}
    assert {r["seq"]: r["s"] for r in pacing.running_sum(df, "t", "seq", "s", rows_per_bucket=50).filter("seq = 1999").collect()} == {1999: 1999 * 1000}


def test_a_hot_key_meets_no_window_of_its_own(spark):
    rnd = random.Random(5)
    rows = [(i * 3, "hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None]), rnd.randrange(100)) for i in range(1500)]
    df = spark.createDataFrame(rows, "seq long, key string, v long")
    for k in (2, -1):
        got = {r["seq"]: (r["o"], r["s"]) for r in feeds.beside(df, "key", "seq", k, hot_rows=200, o="v", s="seq").collect()}
        of = {}
        for r in rows:
            of.setdefault(r[1], []).append(r)
        want = {r[0]: (of[r[1]][i + k][2], of[r[1]][i + k][0]) if 0 <= i + k < len(of[r[1]]) else (None, None) for rs in of.values() for i, r in enumerate(rs)}
        assert got == want
    small = feeds.beside(df, "key", "seq", 1, o="v")
    assert Counter(map(tuple, small.collect())) == Counter(map(tuple, feeds.beside(df, "key", "seq", 1, hot_rows=100, o="v").collect()))
    tasks = feeds.dense_steps(df.filter("key = 'hot'"), "seq", "d", 50, key="key")
    assert [r["d"] for r in tasks.orderBy("seq").collect()] == list(range(1, tasks.count() + 1))
