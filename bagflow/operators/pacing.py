"""Throttled snapshots, running folds, renewed leases and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feeds import _micros, _us, beside, dense_steps, expiries, hot_keys, range_of, ranges


def throttle(df: DataFrame, every: str, ts: str, order: str, *columns: str, key: str | None = None, most_ticks: int = 1_000_000) -> DataFrame:
    """At every tick since the first value (of each key), the latest value, changed or not.

    The per-tick table is small: one row a tick (and key) that had arrivals; the ticks between are filled from it.
    """
    width = _micros(every)
    tick = F.floor(_us(ts) / width)
    by = [key] if key else []
    last = df.groupBy(*by, tick.alias("tick")).agg(F.max_by(F.struct(*columns), F.col(order)).alias("__last"))
    ends = last.agg(F.min("tick").alias("first"), F.max("tick").alias("last")).first()
    if ends["last"] is not None and ends["last"] - ends["first"] + 1 > most_ticks:
        raise ValueError(f"{ends['last'] - ends['first'] + 1} ticks; at most {most_ticks}")
    end = F.lit(ends["last"]).cast("long")
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("tick")
    spine = last.withColumn("__to", F.coalesce(F.lead("tick").over(w) - 1, end))
    return spine.select(*by, F.explode(F.sequence("tick", "__to")).alias("tick"), *[F.col(f"__last.{c}").alias(c) for c in columns])


#: Aggregates whose partial results merge: by an aggregate over many, by an expression over two.
MERGES = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def _both(a: Column, b: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Two partial results as one; null where there were no values."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))


def _framed(agg: Column, by: list[str], order: str, rows: int | None, span: str | None, ts: str | None) -> Column:
    """A fold over the frame that ends with a row, in windows on `by`.

    Both frames of a row end with it, so the later of their starts is that of the shorter frame.
    """
    w = Window.partitionBy(*by)
    if span is None:
        return agg.over(w.orderBy(order).rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0))
    timed = w.orderBy(_us(ts))
    recent = timed.rangeBetween(-_micros(span), 0)
    if rows is None:
        return agg.over(recent)
    ordered = w.orderBy(_us(ts), order)
    # rows of its time that come after it count in the time frame, not in the number of rows that decides
    later = F.count("*").over(timed.rangeBetween(Window.unboundedPreceding, 0)) - F.row_number().over(ordered)
    return F.when(F.count("*").over(recent) - later <= rows, agg.over(recent)).otherwise(agg.over(ordered.rowsBetween(1 - rows, 0)))


def running(df: DataFrame, key: str, order: str, name: str, agg: Column, *, rows: int | None = None, span: str | None = None, ts: str | None = None, merge: str | tuple | None = None, hot_rows: int = 5_000_000) -> DataFrame:
    """df with the fold of its key's rows so far: of all, of the last `rows`, of those within `span` of its time, or of
    those within both bounds. (Rows of one key and time are in each other's span.)

    Frames of many rows that merge are folded in blocks, others frame by frame. A window serves keys of at most
    `hot_rows` rows. Rows of larger keys are divided into ranges, so that no task has a
    whole key: with `rows`, a range also gets the last rows before it; otherwise partial folds of ranges are scanned, for
    which `merge` says how they merge ('sum' for sums and counts, 'min', 'max', or an aggregate and a function of two
    columns). Without `merge` a key that needs it is folded in one task. Ranges take an integer order.
    """
    divisible = rows is not None or merge is not None
    hot = hot_keys(df, key, hot_rows) if divisible and df.schema[order].dataType.typeName() in ("byte", "short", "integer", "long") else None
    few = df if hot is None else df.join(hot, key, "left_anti").select(*df.columns)
    if rows is not None and rows > 32 and span is None and merge is not None:
        few = _in_blocks(few, [key], order, name, agg, rows, (MERGES[merge] if isinstance(merge, str) else merge)[1])
    else:
        few = few.withColumn(name, _framed(agg, [key], order, rows, span, ts))
    if hot is None:
        return few
    many, size = df.join(hot, key, "left_semi").select(*df.columns), min(50_000, hot_rows)
    if rows is not None:
        many = _with_rows_before(many, key, order, name, agg, rows, span, ts, size)
    else:
        merges = MERGES[merge] if isinstance(merge, str) else merge
        many = _scanned(many, key, order, name, agg, merges, size) if span is None else _with_times_before(many, key, order, name, agg, span, ts, merges, size)
    return few.unionByName(many.select(*few.columns))


def _in_blocks(df: DataFrame, by: list[str], order: str, name: str, agg: Column, rows: int, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Folds of the last `rows` rows, without an inverse, in a fixed number of steps a row however many rows that is.

    With blocks of `rows` rows, the frame that ends with a row is the end of the block before, from the row that is
    rows - 1 places back, and its own block so far: two folds that grow by a row at a time.
    """
    number = Window.partitionBy(*by).orderBy(order)
    dealt = df.withColumn("__n", F.row_number().over(number) - 1).withColumn("__block", F.floor(F.col("__n") / rows))
    block = Window.partitionBy(*by, "__block")
    grown = Window.unboundedPreceding, 0
    dealt = dealt.withColumn("__end", agg.over(block.orderBy(F.desc(order)).rowsBetween(*grown))).withColumn("__begin", agg.over(block.orderBy(order).rowsBetween(*grown)))
    before = F.when((F.col("__n") + 1) % rows != 0, F.lag("__end", rows - 1).over(number))
    # a key's first rows have no row that far back: their own block so far is all
    return dealt.withColumn(name, _both(before, F.col("__begin"), combine)).drop("__n", "__block", "__end", "__begin")


def _with_rows_before(df: DataFrame, key: str, order: str, name: str, agg: Column, rows: int, span: str | None, ts: str | None, size: int) -> DataFrame:
    """Folds over at most `rows` rows: ranges of a key's rows by number, each with the rows - 1 before it."""
    size = max(size, rows)
    numbered = dense_steps(df, order, "__n", size, key=key)
    own = F.floor((F.col("__n") - 1) / size)
    tail = (F.col("__n") - 1) % size > size - rows
    dealt = numbered.withColumn("__own", own).withColumn("__range", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    return dealt.withColumn(name, _framed(agg, [key, "__range"], order, rows, span, ts)).filter("__range = __own").drop("__n", "__own", "__range")


def _scanned(df: DataFrame, key: str, order: str, name: str, agg: Column, merges: tuple, size: int) -> DataFrame:
    """Folds over all rows so far: ranges are folded, their folds scanned, and each range goes on from what came before."""
    merge, combine = merges
    dealt = df.withColumn("__range", ranges(df, F.col(order), size))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = dealt.groupBy(key, "__range").agg(agg.alias("__part")).select(key, "__range", merge("__part").over(before).alias("__carry"))
    inside = dealt.withColumn("__inside", _framed(agg, [key, "__range"], order, None, None, None))
    return inside.join(carry, [key, "__range"]).withColumn(name, _both(F.col("__carry"), F.col("__inside"), combine)).drop("__range", "__inside", "__carry")


def _with_times_before(df: DataFrame, key: str, order: str, name: str, agg: Column, span: str, ts: str, merges: tuple, size: int) -> DataFrame:
    """Folds over a span of time, in ranges of time no longer than the span, in a fixed number of steps a row.

    A row takes part in its own range, where it serves all later rows; in the range that its time plus the span lies in
    (as a guest), where it serves rows up to that time; and in all ranges between, each of whose rows it serves: there only
    folds of such rows are needed. So a row's fold is that of its range so far, that of the guests from some time on, and
    the range's carry: two folds that grow by a row at a time, and one number.
    """
    merge, combine = merges
    wait, at = _micros(span), _us(ts)
    width, number = max(wait, 1), range_of(df, at, size)

    def place(x: Column) -> Column:
        # both parts never fall in the order of time, so their sum tells apart what either does; rows without time are apart
        return F.coalesce(number(x) + ((x - F.pmod(x, F.lit(width))) / width).cast("long"), F.lit(-(2**62)))

    dealt = df.withColumn("__own", place(at)).withColumn("__last", place(at + wait))
    parts = dealt.filter("__last > __own + 1").groupBy(key, "__own", "__last").agg(agg.alias("__part"))
    between = parts.select(key, F.explode(F.sequence(F.col("__own") + 1, F.col("__last") - 1)).alias("__range"), "__part")
    carry = between.groupBy(key, "__range").agg(merge("__part").alias("__carry"))
    spread = dealt.withColumn("__range", F.explode(F.array_distinct(F.array("__own", "__last")))).drop("__last").withColumn("__guest", F.col("__range") != F.col("__own"))
    spread = spread.withColumn("__at", F.when(F.col("__guest"), at + wait).otherwise(at)).repartition(key, "__range")
    grown = Window.unboundedPreceding, 0
    side = Window.partitionBy(key, "__range", "__guest").orderBy(F.when(F.col("__guest"), -F.col("__at")).otherwise(F.col("__at")))
    spread = spread.withColumn("__fold", agg.over(side.rangeBetween(*grown)))
    # read backwards, the last guest seen is the first one whose time plus the span isn't before a row
    back = Window.partitionBy(key, "__range").orderBy(F.desc("__at"), F.desc("__guest")).rowsBetween(*grown)
    guests = F.last(F.when(F.col("__guest"), F.struct("__fold")), ignorenulls=True).over(back)["__fold"]
    inside = spread.withColumn("__inside", _both(guests, F.col("__fold"), combine)).filter("not __guest")
    return inside.join(carry, [key, "__range"], "left").withColumn(name, _both(F.col("__carry"), F.col("__inside"), combine)).select(*df.columns, name)


def running_sum(df: DataFrame, order: str, value: str, name: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """df with the sum of `value` so far over the whole log: ranges of `order` are summed, then scanned each by itself."""
    bucketed = df.withColumn("__bucket", ranges(df, F.col(order), rows_per_bucket))
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("__bucket").agg(F.sum(value).alias("__sum")).select("__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = F.sum(value).over(Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return bucketed.withColumn("__inside", inside).join(totals, "__bucket").select(*df.columns, (F.col("__offset") + F.col("__inside")).alias(name))


def renewals(df: DataFrame, element: list[str], order: str, ts: str, timeout: str, *, clock: DataFrame | None = None, copies: str | None = None, hot_rows: int = 5_000_000) -> DataFrame:
    """The lives of elements under a lease that every arrival of an equal element renews: (element columns, first_step,
    last_step, last_ts, n, expire_at), n being the copies that go together at expire_at (null: still live).

    An element expires at the first step of the whole log (or of `clock`, if df has other rows too) later than its last
    arrival's time plus the timeout, unless it arrives at or before that step. `copies` is a column of how many a row stands for.
    """
    name = "__element"
    rows = df.select(F.struct(*element).alias(name), F.col(order), F.col(ts), (F.col(copies) if copies else F.lit(1)).cast("long").alias("__copies"))
    gone = expiries((df if clock is None else clock).select(order, ts), timeout, ts, order, of=rows.select(order, ts))
    rows = rows.join(gone, order)
    hot = hot_keys(rows, name, hot_rows)
    rows = beside(rows, name, order, 1, hot=hot, __next=order)
    ended = F.col("expire_at").isNotNull() & (F.col("__next").isNull() | (F.col("expire_at") < F.col("__next")))
    rows = rows.withColumn("__ended", ended.cast("int"))
    # a life ends with the row that isn't renewed in time; the lives before a row number it
    rows = running(rows, name, order, "__life", F.sum("__ended"), merge="sum", hot_rows=hot_rows)
    life = F.col("__life") - F.col("__ended")
    out = rows.groupBy(name, life.alias("__life")).agg(F.min(order).alias("first_step"), F.max(order).alias("last_step"), F.max(ts).alias("last_ts"), F.sum("__copies").alias("n"), F.max(F.when(F.col("__ended") == 1, F.col("expire_at"))).alias("expire_at"))
    return out.select(f"{name}.*", "first_step", "last_step", "last_ts", "n", "expire_at")


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions of every key that close after a gap: their first and last time and number of rows."""
    at = F.col(ts).cast("timestamp")
    out = df.select(key, at.alias("__ts")).groupBy(key, F.session_window("__ts", gap).alias("__w"))
    return out.agg(F.count("*").alias("n"), F.min("__ts").alias("first_ts"), F.max("__ts").alias("last_ts")).drop("__w")
