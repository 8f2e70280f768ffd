"""Live collections on Structured Streaming: state per key, change feeds, snapshots, bag algebra.

State lives in the state store (RocksDB, `use_rocksdb`) or in a table that foreachBatch maintains, never on the driver.
"""

from __future__ import annotations

import bisect
import heapq
import pickle
import sys
import tempfile
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import direction
from ..operators.bags import from_weighted, majority
from ..operators.feeds import _micros
from .keyed_state import leased, newest_labels
from .tables import Buckets

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# processors are unpickled on the driver's side too, by a process that addPyFile doesn't reach
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _place(row: tuple) -> tuple:
    """Orders (step, value) rows; nulls first."""
    return row[0] is not None, row[0], row[1] is not None, row[1]


def sorted_rows(rows: Iterator[tuple], most: int = 50_000, chunk: int = 200) -> Iterator[tuple]:
    """Rows by their first column (nulls first, ties as they came); beyond `most` of them in sorted runs on disk."""

    def step(row: tuple) -> tuple:
        return row[0] is not None, row[0]

    held: list[tuple] = []
    runs: list[list[int]] = []
    with tempfile.TemporaryFile() as f:

        def read(places: list[int]) -> Iterator[tuple]:
            for at in places:
                f.seek(at)
                yield from pickle.load(f)

        for row in rows:
            held.append(row)
            if len(held) >= most:
                held.sort(key=step)
                places = []
                f.seek(0, 2)
                for a in range(0, len(held), chunk):
                    places.append(f.tell())
                    pickle.dump(held[a : a + chunk], f)
                runs.append(places)
                held = []
        held.sort(key=step)
        yield from heapq.merge(*map(read, runs), held, key=step) if runs else held


class LastN(StatefulProcessor):
    """Keeps the last n rows of a key by step and reports what came in and what went out, each with the step of the arrival
    that caused it. A batch's rows of a key arrive by step, beyond a fixed number sorted on disk; n of them are held. A row
    older than all n held ones comes in and goes out again."""

    def __init__(self, n: int, order: str, value: str, kind: str):
        self.n, self.order, self.value, self.kind = n, order, value, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", f"step long, value {self.kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        held = [(r[0], r[1]) for r in self.held.get()] if self.held.exists() else []
        heap = [(_place(x), x) for x in held]
        heapq.heapify(heap)
        for x in sorted_rows((r[self.order], r[self.value]) for r in rows):
            yield Row(key=key[0], op="add", step=x[0], value=x[1], at=x[0])
            heapq.heappush(heap, (_place(x), x))
            if len(heap) > self.n:
                step, value = heapq.heappop(heap)[1]
                yield Row(key=key[0], op="remove", step=step, value=value, at=x[0])
        self.held.put([x for _, x in sorted(heap)])

    def close(self) -> None:
        pass


class Buffer(StatefulProcessor):
    """A buffer of n elements of a key over a feed of additions and removals, in the order they come in a batch sorted by step.

    An addition to a full buffer evicts the oldest element; a removal takes out the oldest equal one, if there is one.
    Holds n elements and one batch's rows of a key, beyond a fixed number in sorted runs on disk.
    """

    def __init__(self, n: int, value: str):
        self.n, self.value = n, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", f"value {self.value}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        for at, op, value, ts in sorted_rows((r["at"], r["op"], r["value"], r["ts"]) for r in rows):
            if op == "add":
                yield Row(key=key[0], op="add", value=value, at=at, ts=ts)
                held.append(value)
                if len(held) > self.n:
                    yield Row(key=key[0], op="remove", value=held.pop(0), at=at, ts=ts)
            elif value in held:
                held.remove(value)
                yield Row(key=key[0], op="remove", value=value, at=at, ts=ts)
        if held:
            self.held.put([(v,) for v in held])
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def stream_buffer(changes: DataFrame, n: int, key: str, order: str, op: str, value: str, ts: str) -> DataFrame:
    """The change feed (key, op, value, at, ts) of a buffer of n per key on another feed, whose op is 'add' or 'remove'."""
    k, v = changes.schema[key].dataType.simpleString(), changes.schema[value].dataType.simpleString()
    rows = changes.select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), F.col(op).alias("op"), F.col(value).alias("value"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.groupBy("key").transformWithState(Buffer(n, v), f"key {k}, op string, value {v}, at long, ts timestamp", "append", "None")


def stream_sessions(df: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of every key (first_ts, last_ts, n), given once the watermark, `late` behind the newest time, has passed
    their gap. A late row that stands between two sessions joins them."""
    rows = df.select(key, F.col(ts).cast("timestamp").alias("__ts")).withWatermark("__ts", late)
    out = rows.groupBy(key, F.session_window("__ts", gap).alias("__w")).agg(F.count("*").alias("n"), F.min("__ts").alias("first_ts"), F.max("__ts").alias("last_ts"))
    return out.select(key, "n", "first_ts", "last_ts")


def stream_diff(df: DataFrame, n: int, key: str, order: str, value: str) -> DataFrame:
    """The change feed of a buffer of n rows per key: (key, op, step, value, at) for rows that came in or went out at a step."""
    k, v = df.schema[key].dataType.simpleString(), df.schema[value].dataType.simpleString()
    rows = df.select(key, F.col(order).cast("long").alias(order), value)
    return rows.groupBy(key).transformWithState(LastN(n, order, value, v), f"key {k}, op string, step long, value {v}, at long", "append", "None")


def last_n_of(changes: DataFrame) -> DataFrame:
    """The collection that a change feed leads to: what was added and not removed."""
    sign = F.when(F.col("op") == "add", 1).otherwise(-1)
    return from_weighted(changes.groupBy("key", "step", "value").agg(F.sum(sign).cast("long").alias("multiplicity")))


def delayed(changes: DataFrame) -> DataFrame:
    """The part of a change feed before each key's last arrival: `last_n_of` it is the collection one step earlier."""
    last = changes.groupBy("key").agg(F.max("at").alias("__last"))
    return changes.join(last, "key").filter(F.col("at") < F.col("__last")).drop("__last")


class Position(StatefulProcessor):
    """The last position of a key; reports it beside every arrival. Arrivals of a batch beyond a fixed number are sorted on disk."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "lat double, lon double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        at = tuple(self.held.get()) if self.held.exists() else None
        for step, lat, lon in sorted_rows((r["step"], r["lat"], r["lon"]) for r in rows):
            prev = at or (None, None)
            yield Row(key=key[0], step=step, lat=lat, lon=lon, prev_lat=prev[0], prev_lon=prev[1])
            at = (lat, lon)
        self.held.update(at)

    def close(self) -> None:
        pass


def stream_position_state(df: DataFrame, key: str, order: str, lat: str, lon: str) -> DataFrame:
    """For every arrival its position, the one before it, and the direction between; labels are computed outside the state."""
    k = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(order).cast("long").alias("step"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    out = rows.groupBy("key").transformWithState(Position(), f"key {k}, step long, lat double, lon double, prev_lat double, prev_lon double", "append", "None")
    label = F.when(F.col("prev_lat").isNotNull(), direction(F.col("lat"), F.col("lon"), F.col("prev_lat"), F.col("prev_lon")))
    return out.select("key", "step", "lat", "lon", label.alias("current_direction"))


def stream_majority(df: DataFrame, state_path: str, label: str = "current_direction") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest label of each key in a state table; see `snapshot`."""
    return newest_labels(state_path, "key", "step", label)


def _version(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """The state table after an epoch; None before the first one. A version that should be there but isn't is an error."""
    return None if epoch < 0 else Buckets(spark, path).snapshot(epoch)


def snapshot(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    """The state table after an epoch (the newest by default); the one before it is the delayed state."""
    return Buckets(spark, path).snapshot(epoch)


def majority_of(state: DataFrame, label: str = "current_direction") -> DataFrame:
    """The most frequent label over all keys that have one."""
    return majority(state.filter(F.col(label).isNotNull()), label)


def stream_lease(state_path: str, ts: str, timeout: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for an exact global lease: each version of the table holds the rows alive after its batch."""
    return leased(state_path, ts, timeout)


class Leased(StatefulProcessor):
    """Counts a key's rows by event time (in ms) and gives them back when the watermark has passed their lease.

    Times and their counts are held in parts of at most `most`, each a value of the state, and `parts` lists the first time
    of each; one timer a key runs to the first of all. A batch reads and writes the newest part and those in which something
    expires, not single times. Holds a batch's rows of a key, beyond a fixed number in sorted runs on disk.
    """

    def __init__(self, ts: str, wait_ms: int, most: int = 1000):
        self.ts, self.wait, self.most = ts, wait_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "part long", "at array<long>, n array<long>")
        self.parts = handle.getValueState("parts", "part array<long>, first array<long>")

    def _first_of_parts(self) -> dict[int, int]:
        found = self.parts.get() if self.parts.exists() else None
        return dict(zip(*found)) if found else {}

    def _keep(self, first: dict[int, int], timer: int | None) -> None:
        """Write the list of parts (oldest number first) and let the timer run to the first time, if it ran to another."""
        if first:
            self.parts.update((list(first), list(first.values())))
        else:
            self.parts.clear()
        now = min(first.values(), default=None)
        if now != timer:
            if timer is not None:
                self.handle.deleteTimer(timer + self.wait)
            if now is not None:
                self.handle.registerTimer(now + self.wait)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        first = self._first_of_parts()
        timer = min(first.values(), default=None)
        part = max(first, default=0)
        counts = dict(zip(*self.held.getValue((part,)))) if first else {}

        def write() -> None:
            times = sorted(counts)
            self.held.updateValue((part,), (times, [counts[at] for at in times]))
            first[part] = times[0]

        for (at,) in sorted_rows((r["__ms"],) for r in rows):
            if len(counts) >= self.most and at not in counts:
                write()
                part, counts = part + 1, {}
            counts[at] = counts.get(at, 0) + 1
            yield Row(key=key[0], op="add", at_ms=at, n=1)
        write()
        self._keep(first, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        first = self._first_of_parts()
        gone = timerValues.getCurrentWatermarkInMs() - self.wait
        due: list[tuple[int, int]] = []

        def expired(before: int | None = None) -> Iterator[Row]:
            # a time may be in several parts
            while due and (before is None or due[0][0] < before):
                at, n = heapq.heappop(due)
                while due and due[0][0] == at:
                    n += heapq.heappop(due)[1]
                yield Row(key=key[0], op="remove", at_ms=at, n=n)

        for part in sorted((p for p, at in first.items() if at <= gone), key=first.get):
            yield from expired(first[part])
            times, counts = self.held.getValue((part,))
            k = bisect.bisect_right(times, gone)
            for x in zip(times[:k], counts[:k]):
                heapq.heappush(due, x)
            if k < len(times):
                self.held.updateValue((part,), (times[k:], counts[k:]))
                first[part] = times[k]
            else:
                self.held.removeKey((part,))
                del first[part]
        yield from expired()
        # the timer that ran out is taken away by Spark
        self._keep(first, None)

    def close(self) -> None:
        pass


def stream_lease_timers(df: DataFrame, key: str, ts: str, timeout: str, late: str) -> DataFrame:
    """The change feed (key, op, at_ms, n) of a lease per key by event-time timers: the watermark, `late` behind the newest
    time of all keys, is the clock. Rows behind it are dropped; `dropped_late` counts them."""
    wait = _micros(timeout) // 1000
    k = df.schema[key].dataType.simpleString()
    at = F.col(ts).cast("timestamp")
    rows = df.select(F.col(key).alias("key"), at.alias("__at"), F.floor(F.unix_micros(at) / 1000).alias("__ms")).withWatermark("__at", late)
    return rows.groupBy("key").transformWithState(Leased(ts, wait), f"key {k}, op string, at_ms long, n long", "append", "EventTime")


def leased_of(changes: DataFrame) -> DataFrame:
    """What a lease's change feed leaves alive: (key, at_ms, multiplicity)."""
    sign = F.when(F.col("op") == "add", F.col("n")).otherwise(-F.col("n"))
    return changes.groupBy("key", "at_ms").agg(F.sum(sign).alias("multiplicity")).filter("multiplicity > 0")


def dropped_late(query: StreamingQuery) -> int:
    """How many rows a query has dropped behind its watermark so far, by its progress reports."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def stream_bag_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Running counts of every element on both sides of two streams, as one stateful aggregation (update mode)."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = left.select("*", one.alias("l"), none.alias("r")).unionByName(right.select("*", none.alias("l"), one.alias("r")))
    return rows.groupBy(*left.columns).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def bag_op(counts: DataFrame, kind: str) -> DataFrame:
    """The weighted union, subtraction or intersection from both sides' counts; works on streams and tables."""
    rule = {"union": F.greatest("l", "r"), "subtract": F.col("l") - F.col("r"), "intersection": F.least("l", "r")}[kind]
    return counts.withColumn("multiplicity", rule).drop("l", "r").filter("multiplicity > 0")


def tick_windows(df: DataFrame, ts: str, tick: str, late: str, *by: str) -> DataFrame:
    """Arrivals of each tick (and of the columns `by`), final once the watermark has passed it."""
    rows = df.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return rows.groupBy(F.window("__ts", tick), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("tick_start"), *by, "n")


def do_apply(fn: Callable[..., None], state_path: str, *inputs: DataFrame, parts: int = 16) -> tuple[DataFrame, Callable[[DataFrame, int], None]]:
    """One stream of several inputs (of equal columns), and a foreachBatch function that calls fn with the current value
    of every input (all its rows so far) whenever any of them changed.

    A batch adds its rows to the state table as a part of its own, and a batch that is repeated replaces its part. Whenever
    there are `parts` parts of one level they become one of the next, so that a value is read from few folders, and a row
    is written again a few times only, however many batches there are.
    """
    tagged = None
    for i, df in enumerate(inputs):
        one = df.withColumn("__input", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        if rows.isEmpty():
            return
        table = Buckets(spark, state_path)
        before = table.newest(epoch)
        entries = table.version(before)["entries"]
        level, merged = 0, []
        while len(own := [b for b, e in entries.items() if e["mark"] == level]) + 1 >= parts:
            merged += own
            level += 1
        part = rows.unionByName(table.read(before, rows.schema, merged)) if merged else rows
        table.write(epoch, part, [*merged, str(epoch)], bucket=F.lit(epoch), mark=F.max(F.lit(level)), before=before)
        now = table.read(epoch, rows.schema)
        fn(*[now.filter(F.col("__input") == i).drop("__input") for i in range(len(inputs))])

    return tagged, batch


def start(df: DataFrame, checkpoint: str, *, path: str | None = None, batch: Callable[[DataFrame, int], None] | None = None, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run a stream into Parquet files or a foreachBatch function: paced by `every`, or over what is there, then end."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if batch is not None:
        return writer.foreachBatch(batch).start()
    return writer.format("parquet").option("path", path).start()
