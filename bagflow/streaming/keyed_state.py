"""Live operators whose state is a table of buckets: foreachBatch functions that do all work in Spark, batch by batch.

Each takes the path of its state (see `tables`) and, if it has results, the path that they are written to, a part for each
batch; `tables.results` reads them. Arrival order is the order of the step column across batches, and times never
decrease along it. No row goes through Python, and keys with very many rows in a batch are divided as in batch jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import feeds, keyed, pacing
from ..operators.feeds import _micros, _us
from .tables import Buckets, results, stateful

Batch = Callable[[DataFrame, int], None]


def _marked(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))


def then(first: Batch, out: str, second: Batch) -> Batch:
    """A batch function that runs two, the second on the first one's results of the batch."""

    def batch(rows: DataFrame, epoch: int) -> None:
        first(rows, epoch)
        second(results(rows.sparkSession, out, epoch), epoch)

    return batch


# --- per-key state ----------------------------------------------------------------------------------------------------------


def user_states(state_path: str, out: str, key: str, order: str, lat: str, lon: str, *, date: str | None = None, ttl: str | None = None, buckets: int = 64) -> Batch:
    """At every arrival its position (and date), the current direction and the one before that, over all batches.

    The state is the last two positions of a key. With a ttl, positions older than that at the newest date of a batch
    are forgotten by the keys' buckets that it touches, so the key's next arrival is its first.
    """
    columns = [key, order, lat, lon, *([date] if date else [])]

    def step(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = new.select(*columns)
        if ttl:
            since = new.agg(F.max(_us(date)) - _micros(ttl)).first()[0]
            old = old.filter(_us(date) >= since)
        both = _marked(old, new)
        moved = keyed.user_state(both, key, order, lat, lon)
        return feeds.last_n(both.drop("__new"), 2, order, key), moved.filter("__new").drop("__new")

    return stateful(state_path, [key], step, lambda rows: rows.select(*columns).schema, out=out, buckets=buckets)


def label_counts(counts_path: str, key: str, order: str, before: str, after: str, *, buckets: int = 8) -> Batch:
    """Counts of all keys' labels, kept by retraction: of each key of a batch its old label is taken off and its new one
    added. Rows carry the label before and after them; a null label isn't counted.

    A batch costs what it brings, and writes as many rows as there are labels, however many keys there are.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        table = Buckets(rows.sparkSession, counts_path, ["label"], buckets)
        ends = rows.groupBy(key).agg(F.min_by(before, order).alias("b"), F.max_by(after, order).alias("a"))
        moves = ends.filter(~F.col("a").eqNullSafe(F.col("b")))
        each = moves.select(F.explode(F.array(F.struct(F.col("b").alias("label"), F.lit(-1).alias("n")), F.struct(F.col("a").alias("label"), F.lit(1).alias("n")))).alias("e")).select("e.*")
        deltas = each.filter("label is not null").groupBy("label").agg(F.sum("n").alias("n")).persist()
        try:
            touched = table.touched(deltas)
            old = table.read(epoch - 1, deltas.schema, touched)
            now = old.unionByName(deltas).groupBy("label").agg(F.sum("n").alias("n")).filter("n > 0")
            table.write(epoch, now, touched)
        finally:
            deltas.unpersist()

    return batch


def folded(state_path: str, out: str, order: str, name: str, agg: Column, *, key: str | None = None, rows: int | None = None, span: str | None = None, ts: str | None = None, merge: str | tuple | None = None, columns: list[str] | None = None, buckets: int = 64, hot_rows: int = 5_000_000) -> Batch:
    """The fold of the last `rows` rows, of those within `span`, or within both, after each arrival (of its key).

    Any aggregate will do, without an inverse. The state is the rows that later arrivals may still fold; see
    `pacing.running` for keys with very many rows. `columns` are those that the fold and the results need.
    """
    if rows is None and span is None:
        raise ValueError("a live fold needs a bound: rows, span or both")
    by = key or "__all"

    def held(df: DataFrame) -> DataFrame:
        df = df if key else df.withColumn(by, F.lit(0))
        return df.select(*dict.fromkeys([by, order, *([ts] if ts else []), *(columns or [c for c in df.columns if c != by])]))

    def step(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = held(new)
        both = _marked(old, new)
        out_rows = pacing.running(both, by, order, name, agg, rows=rows, span=span, ts=ts, merge=merge, hot_rows=hot_rows).filter("__new").drop("__new", "__all")
        both = both.drop("__new")
        if span is not None:
            both = both.filter(_us(ts) >= new.agg(F.max(_us(ts)) - _micros(span)).scalar())
        return (feeds.last_n(both, rows, order, by) if rows is not None else both), out_rows

    def batch(rows_: DataFrame, epoch: int) -> None:
        rows_ = rows_ if key else rows_.withColumn(by, F.lit(0))
        stateful(state_path, [by], step, lambda r: held(r).schema, out=out, buckets=buckets)(rows_, epoch)

    return batch


def zipped(left: DataFrame, right: DataFrame, key: str, order: str, state_path: str, out: str, *, buckets: int = 64, hot_rows: int = 5_000_000) -> tuple[DataFrame, Batch]:
    """One stream of both, and a batch function that gives, whenever a key of either side gets a row, the latest rows of
    both sides. A side's row is held until its next one, so arrivals may come in any order; a key needs both.

    The sides share the key and the step (unique over both), and no other column.
    """
    mine, theirs = ([c for c in df.columns if c not in (key, order)] for df in (left, right))
    if set(mine) & set(theirs):
        raise ValueError(f"both sides have {sorted(set(mine) & set(theirs))}")
    kinds = [df.select(F.struct(*cols).alias("s")).schema["s"].dataType for df, cols in ((left, mine), (right, theirs))]
    one = left.select(key, order, F.struct(*mine).alias("l"), F.lit(None).cast(kinds[1]).alias("r"))
    other = right.select(key, order, F.lit(None).cast(kinds[0]).alias("l"), F.struct(*theirs).alias("r"))
    tagged = one.unionByName(other)

    def step(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = _marked(old, new)
        now = both
        for side in ("l", "r"):
            latest = F.max(F.when(F.col(side).isNotNull(), F.struct(F.col(order).alias("o"), F.col(side).alias("v"))))
            now = pacing.running(now, key, order, f"__{side}", latest, merge="max", hot_rows=hot_rows)
        pairs = now.filter("__new and __l is not null and __r is not null")
        pairs = pairs.select(key, order, *[F.col(f"__l.v.{c}").alias(c) for c in mine], *[F.col(f"__r.v.{c}").alias(c) for c in theirs])
        newest = both.groupBy(key, F.col("l").isNotNull().alias("__side")).agg(F.max_by(F.struct(order, "l", "r"), order).alias("s"))
        return newest.select(key, "s.*"), pairs

    return tagged, stateful(state_path, [key], step, lambda rows: rows.schema, out=out, buckets=buckets)


# --- bounded collections ------------------------------------------------------------------------------------------------------


def _expiring(table: Buckets, epoch: int, newest: int | None, wait: int) -> list[str]:
    """Buckets with a row whose lease has run out at the newest time, by their marks (the smallest time)."""
    entries = table.version(epoch)["entries"]
    return [] if newest is None else [b for b, e in entries.items() if e["mark"] is not None and e["mark"] + wait < newest]


def bounded(state_path: str, out: str, order: str, *, key: str | None = None, n: int | None = None, timeout: str | None = None, ts: str | None = None, buckets: int = 64) -> Batch:
    """The change feed of a buffer, a lease, or a buffer on a lease: rows with `op` (add or remove) and `at`, the step at
    which it happened, and `at_ts` if there are times.

    The lease's clock is the whole log: an arrival expires rows of any key. What has expired leaves the buffer, and what
    was evicted doesn't come back. A buffer of m on a source of n rows is one of min(m, n). The state is the live rows;
    a batch rewrites the buckets of its own keys and those in which a lease has run out.
    """
    by = key or "__all"

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        table = Buckets(spark, state_path, [by], buckets)
        new = (rows if key else rows.withColumn(by, F.lit(0))).persist()
        both = None
        try:
            touched = set(table.touched(new))
            if timeout:
                touched |= set(_expiring(table, epoch - 1, new.agg(F.max(_us(ts))).first()[0], _micros(timeout)))
            both = _marked(table.read(epoch - 1, new.schema, touched), new)
            ends = []
            if n is not None:
                both = feeds.beside(both, by, order, n, __evict=order)
                ends.append("__evict")
            if timeout is not None:
                gone = feeds.expiries(new.select(order, ts), timeout, ts, order, of=both.select(order, ts)).withColumnRenamed("expire_at", "__expire")
                both = both.join(gone, order)
                ends.append("__expire")
            both = both.withColumn("at", (F.least(*ends) if len(ends) > 1 else F.col(ends[0]) if ends else F.lit(None)).cast("long")).drop(*ends).persist()
            added = both.filter("__new").withColumn("op", F.lit("add")).withColumn("at", F.col(order).cast("long"))
            removed = both.filter("at is not null").withColumn("op", F.lit("remove"))
            if ts:
                added = added.withColumn("at_ts", F.col(ts))
                removed = removed.join(new.select(F.col(order).cast("long").alias("at"), F.col(ts).alias("at_ts")), "at")
            added.unionByName(removed).drop("__new", "__all").write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            table.write(epoch, both.filter("at is null").select(*new.columns), touched, mark=F.min(_us(ts)) if timeout else None)
        finally:
            new.unpersist()
            if both is not None:
                both.unpersist()

    return batch


def renewed(state_path: str, out: str, element: list[str], order: str, ts: str, timeout: str, *, buckets: int = 64) -> Batch:
    """The change feed of a lease that an element's every arrival renews: (element, op, at, n), where a removal takes out
    all n copies of it at the first step of the whole log after the lease.

    The state is one row an element: its copies, and its last step and time.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        table = Buckets(spark, state_path, element, buckets)
        new = rows.select(*element, order, ts).withColumn("n", F.lit(1).cast("long")).persist()
        runs = None
        try:
            touched = set(table.touched(new)) | set(_expiring(table, epoch - 1, new.agg(F.max(_us(ts))).first()[0], _micros(timeout)))
            old = table.read(epoch - 1, new.schema, touched)
            runs = pacing.renewals(old.unionByName(new), element, order, ts, timeout, clock=new, copies="n").persist()
            added = new.select(*element, F.lit("add").alias("op"), F.col(order).cast("long").alias("at"), "n")
            removed = runs.filter("expire_at is not null").select(*element, F.lit("remove").alias("op"), F.col("expire_at").cast("long").alias("at"), "n")
            added.unionByName(removed).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            alive = runs.filter("expire_at is null").select(*element, F.col("last_step").alias(order), F.col("last_ts").alias(ts), "n")
            table.write(epoch, alive, touched, mark=F.min(_us(ts)))
        finally:
            new.unpersist()
            if runs is not None:
                runs.unpersist()

    return batch


def leased(state_path: str, ts: str, timeout: str) -> Batch:
    """An exact lease of the whole log: `snapshot` gives the rows alive after a batch.

    Every batch is a part of its own, so it writes its own rows and no others; parts whose newest row has expired leave
    the table, and what has expired in the others is filtered where they are read.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        table = Buckets(rows.sparkSession, state_path)
        entries = table.version(epoch - 1)["entries"]
        newest = max([e["mark"] for e in entries.values() if e["mark"] is not None] + [t for t in [rows.agg(F.max(_us(ts))).first()[0]] if t is not None], default=None)
        since = None if newest is None else newest - _micros(timeout)
        stale = [b for b, e in entries.items() if since is not None and e["mark"] is not None and e["mark"] < since]
        where = {} if since is None else {"where": f"unix_micros(cast(`{ts}` as timestamp)) >= {since}"}
        table.write(epoch, rows, [*stale, str(epoch)], bucket=F.lit(epoch), mark=F.max(_us(ts)), notes=where)

    return batch


def bag_counts(left: DataFrame, right: DataFrame, state_path: str, *, buckets: int = 64) -> tuple[DataFrame, Batch]:
    """One stream of two bags (of equal columns), and a batch function that keeps how often every element occurs on both
    sides (columns l and r; see `live.bag_op`). A batch adds its counts to the buckets of its own elements."""
    element = left.columns
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tagged = left.select("*", one.alias("l"), none.alias("r")).unionByName(right.select("*", none.alias("l"), one.alias("r")))

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy(*element).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))

    return tagged, stateful(state_path, element, lambda old, new: (counted(old.unionByName(new)), None), lambda rows: rows.schema, buckets=buckets)


def newest_labels(state_path: str, key: str, order: str, label: str, *, buckets: int = 64) -> Batch:
    """The newest label of every key; `snapshot` gives it as (key, order, label)."""

    def step(old: DataFrame, new: DataFrame) -> tuple[DataFrame, None]:
        return keyed.latest(old.unionByName(new.select(key, order, label)), key, order), None

    return stateful(state_path, [key], step, lambda rows: rows.select(key, order, label).schema, buckets=buckets)


# --- ticks ----------------------------------------------------------------------------------------------------------------------


def throttled(state_path: str, out: str, every: str, ts: str, order: str, *columns: str, key: str | None = None, buckets: int = 64) -> Batch:
    """At every tick since its first value, the latest value (of each key), changed or not: (key, tick, columns).

    A tick is given once the log has a later one, for all keys at once, also those that have been silent for long. Between
    ticks a batch touches its own keys' buckets alone.
    """
    by, width = key or "__all", _micros(every)

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        table = Buckets(spark, state_path, [by], buckets)
        new = (rows if key else rows.withColumn(by, F.lit(0))).withColumn("tick", F.floor(_us(ts) / width))
        # one row a tick and key
        new = new.groupBy(by, "tick").agg(F.max_by(F.struct(order, *[c for c in columns if c != order]), order).alias("s")).select(by, "tick", "s.*").persist()
        try:
            touched = table.touched(new)
            found = table.version(epoch - 1)
            before, now = found["notes"].get("tick"), new.agg(F.min("tick"), F.max("tick")).first()
            first = before if before is not None else now[0]
            last = max([t for t in (before, now[1]) if t is not None], default=None)
            closed = last is not None and last > first
            old = table.read(epoch - 1, new.schema, None if closed else touched)
            both = old.unionByName(new)
            ahead = feeds.beside(both, by, "tick", 1, __next="tick")
            until = F.least(F.coalesce(F.col("__next"), F.lit(last)), F.lit(last)) - 1
            spine = ahead.withColumn("__from", F.greatest("tick", F.lit(first))).withColumn("__to", until).filter("__from <= __to") if closed else ahead.limit(0).withColumn("__from", F.col("tick")).withColumn("__to", F.col("tick"))
            out_rows = spine.select(*([key] if key else []), F.explode(F.sequence("__from", "__to")).alias("tick"), *columns)
            out_rows.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            state = both.filter(table.bucket().cast("string").isin(touched)).groupBy(by).agg(F.max_by(F.struct(*[c for c in new.columns if c != by]), "tick").alias("s")).select(by, "s.*").select(*new.columns)
            table.write(epoch, state, touched, notes={} if last is None else {"tick": last})
        finally:
            new.unpersist()

    return batch


def ticked(state_path: str, out: str, tick: str, ts: str) -> Batch:
    """Rows (such as a change feed's) by the tick of a time, each tick whole: given once the log has a later tick.

    So what came in and went out within one tick is in both of its lists. The state is the rows of the open tick.
    """
    width = _micros(tick)

    def batch(rows: DataFrame, epoch: int) -> None:
        table = Buckets(rows.sparkSession, state_path)
        new = rows.withColumn("tick", F.floor(_us(ts) / width)).persist()
        try:
            newest = new.agg(F.max("tick")).first()[0]
            last = max([t for t in (table.version(epoch - 1)["notes"].get("tick"), newest) if t is not None], default=None)
            both = table.read(epoch - 1, new.schema).unionByName(new)
            both.filter(F.col("tick") < F.lit(last)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            table.write(epoch, both.filter(F.col("tick") >= F.lit(last)), ["0"], bucket=F.lit(0), notes={} if last is None else {"tick": last})
        finally:
            new.unpersist()

    return batch
