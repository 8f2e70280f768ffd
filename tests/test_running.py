"""Running folds within both bounds, and of keys that no task holds whole, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bagflow.operators import feeds, pacing

HOUR = 3600


def arrivals(n=900, ties=False, seed=1):
    rnd = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([0, 1] if ties else [1, 1, 2, 40, 900])
        rows.append((i * 3, rnd.choice(["hot"] * 9 + ["a", None]), t, rnd.choice([None, *range(-50, 50)])))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "seq long, k string, s long, v long")
    return df.withColumn("ts", F.timestamp_seconds("s")).repartition(5)


def plain(rows, fold, last=None, span=None):
    out = {}
    for i, (seq, k, t, _) in enumerate(rows):
        mine = [r for r in rows[: i + 1] if r[1] == k]
        if span is not None:
            mine = [r for r in mine if r[2] >= t - span]
        got = [r[3] for r in mine[-last if last else 0 :] if r[3] is not None]
        out[seq] = fold(got) if got else None
    return out


FOLDS = [("sum", F.sum, sum), ("max", F.max, max), ("min", F.min, min)]


@pytest.mark.parametrize(
    ("last", "span", "hot_rows", "fold"),
    [(None, None, 40, 0), (None, None, 10**6, 1), (7, None, 40, 1), (60, None, 10**6, 2), (60, None, 40, 0), (None, 600, 40, 2), (None, 600, 10**6, 0), (7, 600, 40, 0), (7, 600, 10**6, 1), (60, 3000, 10**6, 2), (None, 100_000, 40, 1)],
)
def test_running_folds(spark, last, span, hot_rows, fold):
    rows = arrivals(600)
    df = frame(spark, rows)
    name, agg, plainly = FOLDS[fold]
    out = pacing.running(df, "k", "seq", "x", agg("v"), rows=last, span=span and f"{span} seconds", ts="ts", merge=name, hot_rows=hot_rows)
    assert out.columns == [*df.columns, "x"]
    assert {r["seq"]: r["x"] for r in out.collect()} == plain(rows, plainly, last, span)


def test_any_fold_within_both_bounds(spark):
    rows = [r for r in arrivals(300) if r[3] is not None]
    for hot_rows in (30, 10**6):
        out = pacing.running(frame(spark, rows), "k", "seq", "x", F.collect_list("v"), rows=4, span="500 seconds", ts="ts", hot_rows=hot_rows)
        assert {r["seq"]: r["x"] for r in out.collect()} == plain(rows, lambda got: got, 4, 500)


def test_equal_times_never_reach_back_beyond_the_span(spark):
    rows = arrivals(400, ties=True)
    out = pacing.running(frame(spark, rows), "k", "seq", "x", F.min("s"), rows=5, span="2 seconds", ts="ts")
    assert all(r["x"] >= r["s"] - 2 for r in out.collect())


def test_a_hot_key_is_in_no_task_whole(spark):
    rows = [(i, "hot", i, 1) for i in range(10_000)]
    df = frame(spark, rows)
    seen = df.withColumn("r", feeds.ranges(df, F.col("seq"), 500)).groupBy("r").count().agg(F.max("count"), F.count("*")).first()
    assert seen[0] <= 1200 and seen[1] >= 10
    for span in (None, "5000 seconds"):
        out = pacing.running(df, "k", "seq", "x", F.count("*"), merge="sum", hot_rows=500, span=span, ts="ts")
        assert "hashpartitioning(k" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "__range" in plan
        assert out.filter(F.col("x") != F.least(F.col("seq") + 1, F.lit(5001 if span else 10**9))).count() == 0


def test_ranges_by_search_and_by_comparison(spark):
    df = frame(spark, arrivals(3000))
    for few in (64, 2):
        number = feeds.range_of(df, F.col("s"), 40, 20, few=few)
        got = [r[0] for r in df.orderBy("s").select(number(F.col("s"))).collect()]
        assert got == sorted(got) and len(set(got)) > 30
        same = df.select(number(F.col("s")).alias("a"), feeds.range_of(df, F.col("s"), 40, 20)(F.col("s")).alias("b"))
        assert same.filter("a <> b").count() == 0
        ends = df.limit(1).select(number(F.lit(-(10**6))), number(F.lit(10**9))).first()
        assert tuple(ends) == (0, max(got))


def test_empty_and_null_times(spark):
    df = frame(spark, []).select("seq", "k", "v", "ts")
    assert pacing.running(df, "k", "seq", "x", F.sum("v"), rows=2, span="1 hour", ts="ts", merge="sum", hot_rows=0).collect() == []


@pytest.mark.parametrize(("span", "size"), [(0, 30), (1, 7), (50, 30), (5000, 30), (10**7, 200)])
def test_spans_of_a_hot_key_take_a_fixed_number_of_steps_a_row(spark, span, size):
    rows = arrivals(500, ties=span < 100, seed=5)
    df = frame(spark, rows).unionByName(frame(spark, [(-1, "hot", None, 7), (-2, "hot", None, 4)]))
    out = pacing._with_times_before(df, "k", "seq", "x", F.min("v"), f"{span} seconds", "ts", pacing.MERGES["min"], size)
    frames = out._jdf.queryExecution().analyzed().toString().split("specifiedwindowframe(")[1:]
    assert frames and all("unboundedpreceding" in f[:40].lower() for f in frames)
    # rows of one time are in each other's span, as are rows without one
    want = {seq: min((r[3] for r in rows if r[1] == k and t - span <= r[2] <= t and r[3] is not None), default=None) for seq, k, t, _ in rows}
    assert {r["seq"]: r["x"] for r in out.filter("k is not null").collect()} == {s: x for s, x in want.items() if rows[s // 3][1] is not None} | {-1: 4, -2: 4}
