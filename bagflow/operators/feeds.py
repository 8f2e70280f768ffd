"""Bounded collections and their change feeds.

A log is ordered by a unique, increasing step (`order`) whose event times (`ts`) never decrease. `validity` gives every
row the steps [valid_from, valid_to) at which it is in the collection, bounded by a buffer (the last n rows, of each
key if keyed) and a lease (rows expire once the whole log has a row later than their time plus the timeout). State,
delay and differences at any step are filters on that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(interval: str) -> int:
    """Microseconds of an interval such as '6 hours'."""
    n, unit = interval.split()
    size = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
    return int(n) * size[unit.rstrip("s")]


def _us(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def last_n(df: DataFrame, n: int, order: str, key: str | None = None) -> DataFrame:
    """The last n rows, of every key if one is given. Each task keeps n rows (of a key) before anything is shuffled."""
    if key is None:
        return df.orderBy(F.col(order).desc()).limit(n)
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def lease(df: DataFrame, timeout: str, ts: str, *, renew: bool = False, element: list[str] | None = None) -> DataFrame:
    """Rows no older than timeout at the log's latest time.

    With renew, the lease of an element (its columns) runs from its latest row, and all its rows live or go together.
    """
    newest = df.agg((F.max(_us(ts)) - _micros(timeout)).alias("__since"))
    since = newest.scalar()
    if not renew:
        return df.filter(_us(ts) >= since)
    live = df.groupBy(*element).agg(F.max(_us(ts)).alias("__last")).filter(F.col("__last") >= since).select(*element)
    return df.join(live, element, "left_semi")


def bounded(df: DataFrame, n: int, timeout: str, order: str, ts: str, key: str | None = None) -> DataFrame:
    """Both bounds: of the unexpired rows, the last n (of every key)."""
    return last_n(lease(df, timeout, ts), n, order, key)


def range_of(df: DataFrame, column: Column, rows_per_bucket: int, most_cuts: int = 1000, *, few: int = 64) -> Callable[[Column], Column]:
    """A function that gives any integer the number of the range it lies in: ranges follow each other in the order of df's
    `column` and hold about rows_per_bucket of its rows each. Numbers beyond both ends belong to the first and last range.

    Percentiles cut the column into at most `most_cuts` parts of like numbers of rows, so that a burst, or one time far
    from all others, doesn't put most rows into one range; each part is divided evenly. Rows of one value stay together.
    Up to `few` parts are told apart by comparisons, which stay in generated code, more of them by a binary search.
    """
    zero = F.lit(0).cast("long")

    def one(x: Column) -> Column:
        return zero

    n = df.count()
    if n <= rows_per_bucket:
        return one
    cuts = min(most_cuts, -(-n // rows_per_bucket))
    found = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.percentile_approx(column, [k / cuts for k in range(1, cuts)] or [0.5], max(100, 10 * cuts)).alias("cuts")).first()
    if found["low"] is None:
        return one
    edges = sorted({found["low"], *(found["cuts"] if cuts > 1 else [])})
    parts = max(1, -(-n // (cuts * rows_per_bucket)))
    widths = [max(1, -(-(b - a) // parts)) for a, b in zip(edges, [*edges[1:], found["high"] + 1])]

    def inside(x: Column, at: Column, low: Column, width: Column) -> Column:
        return at * parts + F.greatest(F.least(F.floor((x - low) / width), F.lit(parts - 1)), F.lit(0)) if parts > 1 else at

    def compared(x: Column) -> Column:
        first, *rest = [inside(x, *(F.lit(v).cast("long") for v in v3)) for v3 in zip(range(len(edges)), edges, widths)]
        for edge, number in zip(edges[1:], rest):
            first = F.when(x >= edge, number).otherwise(first)
        return first.cast("long")

    def searched(x: Column) -> Column:
        low, width = (F.array(*[F.lit(v).cast("long") for v in vs]) for vs in (edges, widths))
        # a binary search for the last edge that isn't above the value
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
        last = F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k < len(edges)) & (F.get(low, at + k) <= x), at + k).otherwise(at))
        return F.get(F.transform(F.array(last), lambda at: inside(x, at, F.get(low, at), F.get(width, at))), F.lit(0)).cast("long")

    return compared if len(edges) <= few else searched


def ranges(df: DataFrame, column: Column, rows_per_bucket: int, most_cuts: int = 1000) -> Column:
    """A number for each row by the range that an integer column lies in; see range_of."""
    return range_of(df, column, rows_per_bucket, most_cuts)(column)


def dense_steps(df: DataFrame, order: str, name: str = "step", rows_per_bucket: int = 50_000, *, key: str | None = None) -> DataFrame:
    """Numbers 1, 2, ... along `order` (integers), of every key if one is given, without a sort of them all in one task:
    counts of ranges give each its offset."""
    by = [key] if key else []
    bucketed = df.withColumn("__bucket", ranges(df, F.col(order), rows_per_bucket))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*by, "__bucket", "__offset")
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(order))
    return bucketed.withColumn("__inside", inside).join(offsets, [*by, "__bucket"]).select(*df.columns, (F.col("__offset") + F.col("__inside")).cast("long").alias(name))


def hot_keys(df: DataFrame, key: str, hot_rows: int = 5_000_000) -> DataFrame | None:
    """The keys of more than hot_rows rows, if any: fewer than rows / hot_rows. They are counted in tasks first, and not at
    all if df has no more rows than that (for a table of files that is in their footers)."""
    if df.count() <= hot_rows:
        return None
    hot = df.groupBy(key).count().filter((F.col("count") > hot_rows) & F.col(key).isNotNull()).select(key)
    names = hot.collect()
    return F.broadcast(df.sparkSession.createDataFrame(names, hot.schema)) if names else None


def beside(df: DataFrame, key: str, order: str, k: int, *, hot_rows: int = 5_000_000, hot: DataFrame | bool | None = False, **columns: str) -> DataFrame:
    """df with columns of the row that is k places later (earlier: k below 0) in its key, null if there is none.

    A window serves keys of at most `hot_rows` rows. Rows of larger keys are numbered by ranges of `order` and joined
    with the numbers shifted by k, so that no task has a whole key. (That takes an integer order; a null key has a window.)
    `hot` are the keys if they are known (see hot_keys).
    """
    w = Window.partitionBy(key).orderBy(order)
    shift = F.lead if k > 0 else F.lag
    windowed = {n: shift(c, abs(k)).over(w) for n, c in columns.items()}
    if hot is False:
        hot = hot_keys(df, key, hot_rows)
    if hot is None or df.schema[order].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return df.select("*", *[c.alias(n) for n, c in windowed.items()])
    few = df.join(hot, key, "left_anti").select(*df.columns, *[c.alias(n) for n, c in windowed.items()])
    many = dense_steps(df.join(hot, key, "left_semi"), order, "__dense", min(50_000, hot_rows), key=key)
    other = many.select(key, (F.col("__dense") - k).alias("__dense"), *[F.col(c).alias(n) for n, c in columns.items()])
    return few.unionByName(many.join(other, [key, "__dense"], "left").select(*df.columns, *columns))


def expiries(log: DataFrame, timeout: str, ts: str, step: str, rows_per_bucket: int = 50_000, *, of: DataFrame | None = None) -> DataFrame:
    """For every step of the log (or of the rows `of`), `expire_at`: the first step of the whole log later than its time
    plus the timeout.

    A forward as-of join by time ranges: rows and their probes meet in a range's window; a probe that finds nothing there
    takes the first step of the next range that has rows, from a table of one row a range.
    """
    wait = _micros(timeout)
    rows = log.select(_us(ts).alias("t"), F.lit(0).alias("probe"), F.col(step).alias("s"))
    asked = rows if of is None else of.select(_us(ts).alias("t"), F.col(step).alias("s"))
    probes = asked.select((F.col("t") + wait).alias("t"), F.lit(1).alias("probe"), "s")
    both = rows.unionByName(probes)
    number = range_of(both, F.col("t"), 2 * rows_per_bucket)
    both = both.withColumn("bucket", number(F.col("t")))
    # at equal times rows stand before probes: expiry is strict
    # (read backwards: a frame that only grows is one pass over the range)
    later = Window.partitionBy("bucket").orderBy(F.desc("t"), F.desc("probe"), F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("next", F.last(F.when(F.col("probe") == 0, F.col("s")), ignorenulls=True).over(later)).filter("probe = 1")
    if number.__name__ == "one":  # a single range: no other could answer
        return found.select(F.col("s").alias(step), F.col("next").alias("expire_at"))
    firsts = both.groupBy("bucket").agg(F.min_by(F.when(F.col("probe") == 0, F.col("s")), F.when(F.col("probe") == 0, F.struct("t", "s"))).alias("first"))
    beyond = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("bucket", F.last("first", ignorenulls=True).over(beyond).alias("beyond"))
    return found.join(firsts, "bucket").select(F.col("s").alias(step), F.coalesce("next", "beyond").alias("expire_at"))


def validity(df: DataFrame, order: str, *, key: str | None = None, n: int | None = None, timeout: str | None = None, ts: str | None = None, tick: str | None = None) -> DataFrame:
    """df with valid_from and valid_to (null: still live) under a buffer of n, a lease, or both.

    With tick, steps are numbers of equal time slices instead of single rows. A row evicted in the step it came in has
    valid_to equal to valid_from.
    """
    step = F.floor(_us(ts) / _micros(tick)) if tick else F.col(order)
    out = df.withColumn("valid_from", step.cast("long"))
    ends = []
    if n is not None:
        if key is not None:
            out = beside(out, key, order, n, __evict="valid_from")
        else:
            numbered = dense_steps(out, order, "__dense")
            ahead = numbered.select((F.col("__dense") - n).alias("__dense"), F.col("valid_from").alias("__evict"))
            out = numbered.join(ahead, "__dense", "left").drop("__dense")
        ends.append("__evict")
    if timeout is not None:
        clock = out.select(order, ts, "valid_from")
        if tick:
            at = expiries(clock, timeout, ts, order).withColumnRenamed("expire_at", "__row")
            steps = clock.select(F.col(order).alias("__row"), F.col("valid_from").alias("__expire"))
            at = at.join(steps, "__row", "left").select(order, "__expire")
        else:
            at = expiries(clock, timeout, ts, order).withColumnRenamed("expire_at", "__expire")
        out = out.join(at, order)
        ends.append("__expire")
    end = F.least(*ends) if len(ends) > 1 else F.col(ends[0]) if ends else F.lit(None).cast("long")
    return out.select(*df.columns, "valid_from", end.alias("valid_to"))


def state_at(intervals: DataFrame, step: int) -> DataFrame:
    """The collection after a step."""
    live = (F.col("valid_from") <= step) & (F.col("valid_to").isNull() | (F.col("valid_to") > step))
    return intervals.filter(live)


def delay(intervals: DataFrame, step: int) -> DataFrame:
    """The collection before a step: empty at the first."""
    return state_at(intervals, step - 1)


def diff_add(intervals: DataFrame, step: int | None = None) -> DataFrame:
    """Rows that came in at a step; all with their step if none is given."""
    return intervals.withColumn("step", F.col("valid_from")).filter(F.lit(True) if step is None else F.col("step") == step)


def diff_remove(intervals: DataFrame, step: int | None = None) -> DataFrame:
    """Rows that were evicted or expired at a step; all with their step if none is given."""
    out = intervals.withColumn("step", F.col("valid_to")).filter("step is not null")
    return out if step is None else out.filter(F.col("step") == step)


def states(intervals: DataFrame, first: int, last: int, *, most_steps: int = 10_000) -> DataFrame:
    """The collection after each step of a bounded range, as rows with their step."""
    if last - first + 1 > most_steps:
        raise ValueError(f"{last - first + 1} steps; at most {most_steps}")
    start = F.greatest(F.col("valid_from"), F.lit(first))
    stop = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last))
    return intervals.withColumn("__a", start).withColumn("__b", stop).filter("__a <= __b").withColumn("step", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")
