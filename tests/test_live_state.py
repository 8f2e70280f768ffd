"""State tables and the live operators on them, batch by batch: each batch function is given batches as a stream gives them."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bagflow.operators import bags, feeds, keyed, pacing
from bagflow.streaming import keyed_state, live, tables


def arrivals(n, keys="ab", seed=0, values=4):
    rnd = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([1, 1, 3, 10, 40])
        rows.append((i + 1, t, rnd.choice(keys), rnd.randrange(values)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "seq long, s long, k string, v long")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def batches(rows, *sizes):
    at = 0
    for n in sizes:
        yield rows[at : at + n]
        at += n
    yield rows[at:]


def drive(spark, batch, rows, *sizes):
    for epoch, part in enumerate(batches(rows, *sizes)):
        batch(frame(spark, part), epoch)


def bag(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


# --- the table ----------------------------------------------------------------------------------------------------------------


def folders(path):
    return {os.path.relpath(d, path) for d, _, names in os.walk(path) if any(n.endswith(".parquet") for n in names)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    table = tables.Buckets(spark, path, ["k"], 16)
    df = spark.range(4000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    table.write(0, df, table.touched(df))
    before = table.version(0)["entries"]
    assert len(before) == 16 and table.snapshot().count() == 4000
    one = spark.createDataFrame([(7, 1)], "k long, v int")
    touched = table.touched(one)
    now = table.read(0, df.schema, touched).filter("k <> 7").unionByName(one)
    table.write(1, now, touched)
    after = table.version(1)["entries"]
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == touched
    assert table.snapshot().count() == 4000 and table.snapshot(0).agg(F.sum("v")).first()[0] == 0 and table.snapshot(1).agg(F.sum("v")).first()[0] == 1
    # the same batch again changes nothing
    table.write(1, table.read(0, df.schema, touched).filter("k <> 7").unionByName(one), touched)
    assert table.snapshot().count() == 4000 and table.snapshot().agg(F.sum("v")).first()[0] == 1
    # a bucket without rows goes
    table.write(2, table.read(1, df.schema, touched).limit(0), touched)
    assert len(table.version(2)["entries"]) == 15


def test_old_versions_go_and_losses_are_errors(spark, tmp_path):
    path = str(tmp_path / "t")
    table = tables.Buckets(spark, path, ["k"], 4)
    for epoch in range(7):
        rows = spark.createDataFrame([(k, epoch) for k in range(40)] if epoch == 0 else [(epoch % 2, epoch)], "k int, e int")
        touched = table.touched(rows)
        old = table.read(epoch - 1, rows.schema, touched)
        table.write(epoch, old.unionByName(rows), touched)
    assert sorted(n for n in os.listdir(f"{path}/versions") if not n.startswith((".", "_"))) == ["4", "5", "6"]
    used = {e["folder"] for v in (4, 5, 6) for e in table.version(v)["entries"].values()}
    assert folders(path) == used and table.snapshot().count() == 46
    with pytest.raises(RuntimeError, match="no state of batch 3"):
        table.version(3)
    with pytest.raises(RuntimeError, match="no version yet"):
        tables.Buckets(spark, str(tmp_path / "none")).snapshot()
    os.rename(f"{path}/{sorted(used & {e['folder'] for e in table.version(6)['entries'].values()})[0]}", str(tmp_path / "gone"))
    with pytest.raises(RuntimeError, match="has lost"):
        table.snapshot()


def test_applied_parts_are_merged(spark, tmp_path):
    seen, state = [], str(tmp_path / "s")
    df = lambda *vs: spark.createDataFrame([(v, v % 2) for v in vs], "v long, __input int")
    _, batch = live.do_apply(lambda a, b: seen.append((sorted(r["v"] for r in a.collect()), b.count())), state, *[df(0).drop("__input")] * 2, parts=3)
    for epoch in range(10):
        batch(df(2 * epoch, 2 * epoch + 1), epoch)
        assert seen[-1] == (list(range(0, 2 * epoch + 1, 2)), epoch + 1)
        assert len(tables.Buckets(spark, state).version(epoch)["entries"]) <= 4
    batch(df(18, 19), 9)  # once more
    assert seen[-1] == (list(range(0, 19, 2)), 10)


# --- per-key state ------------------------------------------------------------------------------------------------------------


def positions(spark, rows):
    return frame(spark, rows).withColumns({"lat": F.col("v") * 0.37 + F.col("seq") % 7 * 0.1, "lon": F.col("seq") % 5 * 0.2})


def test_user_states_and_counts_by_retraction(spark, tmp_path):
    rows = [*arrivals(120, "abcde", 1), (121, 10**4, None, 1), (122, 10**4 + 1, None, 2), (123, 10**4 + 2, "new", 1)]
    state, out, counts = (str(tmp_path / n) for n in ("s", "o", "c"))
    batch = keyed_state.then(keyed_state.user_states(state, out, "k", "seq", "lat", "lon", date="ts", buckets=4), out, keyed_state.label_counts(counts, "k", "seq", "last_direction", "current_direction"))
    want = keyed.user_state(positions(spark, rows), "k", "seq", "lat", "lon").drop("v").persist()
    done = 0
    for epoch, part in enumerate(batches(rows, 30, 1, 0, 60)):
        batch(positions(spark, part), epoch)
        done += len(part)
        newest = keyed.latest(want.filter(F.col("seq") <= (part[-1][0] if part else done)).select("k", "seq", "current_direction"), "k", "seq")
        labels = bags.multiplicities(newest.filter("current_direction is not null"), "current_direction")
        assert bag(live.snapshot(spark, counts), "label", "n") == bag(labels, "current_direction", "n")
        assert live.snapshot(spark, state).groupBy("k").count().agg(F.max("count")).first()[0] <= 2
    columns = ["k", "seq", "lat", "lon", "ts", "current_direction", "last_direction"]
    assert bag(tables.results(spark, out), *columns) == bag(want, *columns)


def test_counts_cost_what_a_batch_brings(spark, tmp_path):
    """Ten times the keys: the counts that a batch writes are as large."""
    sizes = []
    for n in (200, 2000):
        counts = str(tmp_path / f"c{n}")
        batch = keyed_state.label_counts(counts, "k", "seq", "b", "a")
        batch(spark.range(n).select(F.col("id").alias("k"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("b"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("a")), 0)
        batch(spark.createDataFrame([(0, 10**6, "x", "y"), (1, 10**6, "y", "y"), (0, 10**6 + 1, "y", "z")], "k long, seq long, b string, a string"), 1)
        assert bag(live.snapshot(spark, counts), "label", "n") == Counter({("x", -(-n // 3) - 1): 1, ("y", n - -(-n // 3)): 1, ("z", 1): 1})
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{counts}/rows/1") for f in names))
    assert sizes[1] < 1.2 * sizes[0]


def test_states_are_forgotten_after_their_ttl(spark, tmp_path):
    rows = [(1, 0, "a", 1), (2, 10, "a", 2), (3, 500, "a", 3), (4, 505, "a", 1)]
    batch = keyed_state.user_states(str(tmp_path / "s"), str(tmp_path / "o"), "k", "seq", "lat", "lon", date="ts", ttl="100 seconds")
    for epoch, part in enumerate(batches(rows, 2, 1)):
        batch(positions(spark, part), epoch)
    got = {r["seq"]: r["current_direction"] for r in tables.results(spark, str(tmp_path / "o")).collect()}
    assert got[1] is None and got[2] is not None and got[3] is None and got[4] is not None


@pytest.mark.parametrize("hot_rows", [5_000_000, 6])
def test_zip_latches_both_sides(spark, tmp_path, hot_rows):
    rows = arrivals(60, "abc", 3)
    left, right = ([r for r in rows if r[0] % 3 == m or r[2] == "c" and m == 0] for m in (0, 1))
    right = [r for r in right if r not in left]

    def sides(part):
        return [frame(spark, [r for r in part if r in side]).select("k", "seq", F.col("v").alias(n), F.col("ts").alias(f"{n}_ts")) for side, n in ((left, "x"), (right, "y"))]

    out = str(tmp_path / "o")
    for epoch, part in enumerate(batches(rows, 5, 30)):
        tagged, batch = keyed_state.zipped(*sides(part), "k", "seq", str(tmp_path / "s"), out, buckets=3, hot_rows=hot_rows)
        batch(tagged, epoch)
    want, now = Counter(), defaultdict(dict)
    for r in rows:
        if r in left or r in right:
            now[r[2]]["x" if r in left else "y"] = r[3]
            if len(now[r[2]]) == 2:
                want[r[2], r[0], now[r[2]]["x"], now[r[2]]["y"]] += 1
    assert bag(tables.results(spark, out), "k", "seq", "x", "y") == want and not any(k == "c" for k, *_ in want)
    with pytest.raises(ValueError, match="both sides"):
        keyed_state.zipped(left_df := frame(spark, left), left_df, "k", "seq", "", "")


# --- folds of bounded collections -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bounds", "fold"), [({"rows": 3}, "all"), ({"span": "30 seconds"}, "all"), ({"rows": 3, "span": "30 seconds"}, "most"), ({"rows": 40, "merge": "max"}, "most")])
def test_live_folds_equal_batch_folds(spark, tmp_path, bounds, fold):
    rows = arrivals(90, "ab", 5, values=50)
    agg = F.max("v") if fold == "most" else F.collect_list("v")
    state, out = str(tmp_path / "s"), str(tmp_path / "o")
    drive(spark, keyed_state.folded(state, out, "seq", "x", agg, key="k", ts="ts", columns=["v"], buckets=3, **bounds), rows, 20, 30)
    want = pacing.running(frame(spark, rows), "k", "seq", "x", agg, ts="ts", **bounds)
    shown = F.col("x").cast("string")
    assert bag(tables.results(spark, out), "seq", "k", shown) == bag(want, "seq", "k", shown)
    if "rows" in bounds:
        assert live.snapshot(spark, state).groupBy("k").count().agg(F.max("count")).first()[0] <= bounds["rows"]


def test_live_fold_of_a_bag(spark, tmp_path):
    rows = arrivals(50, "abc", 6, values=90)
    out = str(tmp_path / "o")
    drive(spark, keyed_state.folded(str(tmp_path / "s"), out, "seq", "most", F.max("v"), rows=5, columns=["v"]), rows, 7, 7, 20)
    assert {r["seq"]: r["most"] for r in tables.results(spark, out).collect()} == {r[0]: max(x[3] for x in rows[max(0, i - 4) : i + 1]) for i, r in enumerate(rows)}
    with pytest.raises(ValueError, match="bound"):
        keyed_state.folded("", "", "seq", "x", F.max("v"))


# --- buffers and leases -----------------------------------------------------------------------------------------------------------


def after_each(spark, script, keyed_by, **bounds):
    """The collection after each message of a script of (key, value, ms), a batch each."""
    path = bounds.pop("path")
    batch = keyed_state.bounded(f"{path}/s", f"{path}/o", "seq", key="k" if keyed_by else None, ts="ts", buckets=4, **bounds)
    held, seen = Counter(), []
    for i, (k, v, ms) in enumerate(script):
        row = spark.createDataFrame([(i, k, v, ms)], "seq long, k string, v long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        batch(row, i)
        for r in tables.results(spark, f"{path}/o", i).collect():
            assert r["at"] == i
            held[r["k"], r["v"]] += 1 if r["op"] == "add" else -1
        seen.append(sorted((k + str(v) if keyed_by else v) for (k, v), n in held.items() for _ in range(n)))
    return seen


def test_scripts_of_buffers_and_leases(spark, tmp_path):
    def x1(*values):
        return [("", *v) for v in values]

    def run(name, script, keyed_by, **bounds):
        return after_each(spark, script, keyed_by, path=tmp_path / str(name), **bounds)

    assert run(2, x1((1, 0), (2, 1000), (3, 2100), (4, 5100)), False, timeout="2 seconds") == [[1], [1, 2], [2, 3], [4]]
    assert run(3, [("a", 1, 0), ("a", 2, 1), ("a", 3, 1001), ("b", 1, 2101)], True, n=2, timeout="2 seconds") == [["a1"], ["a1", "a2"], ["a2", "a3"], ["a3", "b1"]]
    # a buffer of two on a leased source of three
    assert run(4, x1((1, 0), (2, 1), (3, 2), (4, 2102), (5, 2103)), False, n=min(2, 3), timeout="2 seconds") == [[1], [1, 2], [2, 3], [4], [4, 5]]
    script = [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 1, 3), ("d", 1, 2103), ("e", 1, 2104)]
    assert run(6, script, True, n=2, timeout="2 seconds") == [["a1"], ["a1", "a2"], ["a2", "a3"], ["a2", "a3", "b1"], ["d1"], ["d1", "e1"]]


@pytest.mark.parametrize(("bounds", "key"), [({"n": 2}, None), ({"timeout": "40 seconds"}, "k"), ({"n": 3, "timeout": "40 seconds"}, "k")])
def test_live_bounds_equal_batch_intervals(spark, tmp_path, bounds, key):
    rows = arrivals(80, "abcd", 8)
    state, out = str(tmp_path / "s"), str(tmp_path / "o")
    drive(spark, keyed_state.bounded(state, out, "seq", key=key, ts="ts", buckets=3, **bounds), rows, 25, 0, 30)
    v = feeds.validity(frame(spark, rows), "seq", key=key, ts="ts", **bounds)
    got = tables.results(spark, out)
    assert bag(got.filter("op = 'add'"), "seq", "k", "v", "at") == bag(v, "seq", "k", "v", "valid_from")
    assert bag(got.filter("op = 'remove'"), "seq", "k", "v", "at") == bag(v.filter("valid_to is not null"), "seq", "k", "v", "valid_to")
    assert bag(live.snapshot(spark, state), "seq") == bag(v.filter("valid_to is null"), "seq")
    assert got.join(frame(spark, rows).select(F.col("seq").alias("at"), F.col("ts").alias("t")), "at").filter("at_ts = t").count() == got.count()


def plain_renewals(rows, wait):
    """Replays arrivals one by one: an arrival renews its element, then elements past their lease go."""
    last, copies, out = {}, Counter(), []
    for seq, t, k, v in rows:
        out.append(("add", seq, k, v, 1))
        last[k, v] = t
        copies[k, v] += 1
        for e in [e for e, at in last.items() if at < t - wait]:
            out.append(("remove", seq, *e, copies.pop(e)))
            del last[e]
    return Counter(out), {e: n for e, n in copies.items()}


def test_renewed_leases_equal_a_replay(spark, tmp_path):
    rows = arrivals(150, "abc", 9)
    state, out = str(tmp_path / "s"), str(tmp_path / "o")
    drive(spark, keyed_state.renewed(state, out, ["k", "v"], "seq", "ts", "35 seconds", buckets=3), rows, 40, 1, 0, 70)
    want, alive = plain_renewals(rows, 35)
    assert bag(tables.results(spark, out), "op", "at", "k", "v", "n") == want
    assert {(r["k"], r["v"]): r["n"] for r in live.snapshot(spark, state).collect()} == alive
    for hot_rows in (10, 10**6):
        runs = pacing.renewals(frame(spark, rows), ["k", "v"], "seq", "ts", "35 seconds", hot_rows=hot_rows)
        assert bag(runs.filter("expire_at is not null"), F.lit("remove"), "expire_at", "k", "v", "n") == Counter({x: n for x, n in want.items() if x[0] == "remove"})


def test_leased_parts_leave_when_they_have_expired(spark, tmp_path):
    rows = arrivals(60, "ab", 10)
    state = str(tmp_path / "s")
    batch = keyed_state.leased(state, "ts", "20 seconds")
    for epoch, part in enumerate(batches(rows, 10, 10, 0, 10, 10, 10)):
        batch(frame(spark, part), epoch)
        so_far = rows[: part[-1][0]] if part else so_far
        assert bag(live.snapshot(spark, state), "seq") == bag(feeds.lease(frame(spark, so_far), "20 seconds", "ts"), "seq")
    assert len(tables.Buckets(spark, state).version(6)["entries"]) <= 3


def test_bag_counts_over_batches(spark, tmp_path):
    rows = arrivals(80, "lr", 11)
    state = str(tmp_path / "s")
    for epoch, part in enumerate(batches(rows, 30, 1, 0, 20)):
        sides = [frame(spark, part).filter(f"k = '{s}'").select("v") for s in "lr"]
        tagged, batch = keyed_state.bag_counts(*sides, state, buckets=2)
        batch(tagged, epoch)
    sides = [Counter(r[3] for r in rows if r[2] == s) for s in "lr"]
    for kind, want in (("union", sides[0] | sides[1]), ("subtract", sides[0] - sides[1]), ("intersection", sides[0] & sides[1])):
        assert {r["v"]: r["multiplicity"] for r in live.bag_op(live.snapshot(spark, state), kind).collect()} == want


# --- ticks --------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("key", ["k", None])
def test_throttle_gives_silent_keys_every_tick(spark, tmp_path, key):
    rows = [(1, 5, "a", 1), (2, 6, "a", 2), (3, 7, "b", 3), (4, 31, "b", 4), (5, 32, "b", 5), (6, 33, "b", 6), (7, 75, "c", 7), (8, 81, "b", 8)]
    out = str(tmp_path / "o")
    drive(spark, keyed_state.throttled(str(tmp_path / "s"), out, "10 seconds", "ts", "seq", "seq", "v", key=key, buckets=2), rows, 2, 2, 1, 0, 2)
    want = pacing.throttle(frame(spark, rows), "10 seconds", "ts", "seq", "seq", "v", key=key).filter("tick < 8")
    columns = [*([key] if key else []), "tick", "seq", "v"]
    got = bag(tables.results(spark, out), *columns)
    assert got == bag(want, *columns)
    if key:
        assert [t for k, t, *_ in sorted(got) if k == "a"] == list(range(8))


def test_a_paced_stream(spark, tmp_path):
    """`every` starts batches by the clock, and files that come later are later batches."""
    rows, source = arrivals(30, "ab", 12), str(tmp_path / "in")
    frame(spark, rows[:10]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(frame(spark, rows[:1]).schema).parquet(source)
    out = str(tmp_path / "o")
    batch = keyed_state.throttled(str(tmp_path / "s"), out, "10 seconds", "ts", "seq", "seq", key="k")
    query = live.start(stream, str(tmp_path / "c"), batch=batch, every="300 milliseconds")
    try:
        query.processAllAvailable()
        for part in (rows[10:20], rows[20:]):
            frame(spark, part).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    assert query.exception() is None and len(os.listdir(f"{tmp_path}/s/versions")) >= 3
    last = rows[-1][1] // 10
    want = pacing.throttle(frame(spark, rows), "10 seconds", "ts", "seq", "seq", key="k").filter(F.col("tick") < last)
    assert bag(tables.results(spark, out), "k", "tick", "seq") == bag(want, "k", "tick", "seq")


def test_both_lists_of_a_tick(spark, tmp_path):
    """+a1 +a2 +b1 +a3 -a3 in one tick on a buffer of two: a1 and a3 came in and went out."""
    live.use_rocksdb(spark)
    feed = [(1, "add", "a", 1, 0), (2, "add", "a", 2, 1), (3, "add", "b", 1, 2), (4, "add", "a", 3, 3), (5, "remove", "a", 3, 4), (6, "remove", "a", 9, 5), (7, "add", "b", 2, 12)]
    source = str(tmp_path / "in")
    for part in (feed[:2], feed[2:6], feed[6:]):
        df = spark.createDataFrame(part, "seq long, op string, k string, v long, s long").withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    changes = live.stream_buffer(stream, 2, "k", "seq", "op", "v", "ts")
    out = str(tmp_path / "o")
    live.start(changes, str(tmp_path / "c"), batch=keyed_state.ticked(str(tmp_path / "s"), out, "10 seconds", "ts")).awaitTermination()
    got = [(r["op"], r["at"], r["key"], r["value"], r["tick"]) for r in tables.results(spark, out).collect()]
    assert sorted((k + str(v), t) for op, _, k, v, t in got if op == "add") == [("a1", 0), ("a2", 0), ("a3", 0), ("b1", 0)]
    assert sorted((k + str(v), at) for op, at, k, v, _ in got if op == "remove") == [("a1", 4), ("a3", 5)]
    assert bag(live.snapshot(spark, str(tmp_path / "s")), "key", "value", "tick") == Counter({("b", 2, 1): 1})


def test_a_late_row_joins_two_sessions(spark, tmp_path):
    live.use_rocksdb(spark)
    source = str(tmp_path / "in")
    parts = [[("a", 0), ("a", 5), ("b", 1)], [("a", 22)], [("a", 13)], [("c", 300)], [("c", 301)]]
    for p in parts:
        df = spark.createDataFrame(p, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = live.stream_sessions(stream, "k", "ts", "10 seconds", "60 seconds")
    live.start(out, str(tmp_path / "c"), path=str(tmp_path / "o")).awaitTermination()
    got = {(r["k"], r["n"], r["first_ts"].timestamp(), r["last_ts"].timestamp()) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {("a", 4, 0.0, 22.0), ("b", 1, 1.0, 1.0)}


def test_empty_first_batches(spark, tmp_path):
    for i, batch in enumerate((
        keyed_state.bounded(f"{tmp_path}/s0", f"{tmp_path}/o0", "seq", key="k", n=2, timeout="1 hour", ts="ts"),
        keyed_state.renewed(f"{tmp_path}/s1", f"{tmp_path}/o1", ["k"], "seq", "ts", "1 hour"),
        keyed_state.throttled(f"{tmp_path}/s2", f"{tmp_path}/o2", "1 hour", "ts", "seq", "v", key="k"),
        keyed_state.leased(f"{tmp_path}/s3", "ts", "1 hour"),
        keyed_state.ticked(f"{tmp_path}/s4", f"{tmp_path}/o4", "1 hour", "ts"),
    )):
        batch(frame(spark, []), 0)
        batch(frame(spark, [(1, 0, None, None)]), 1)
        assert isinstance(live.snapshot(spark, f"{tmp_path}/s{i}").schema, StructType) and live.snapshot(spark, f"{tmp_path}/s{i}").count() == 1
