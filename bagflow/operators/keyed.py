"""Keyed bags: rows of key and value columns; a key exists as long as it has a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import direction
from .feeds import beside, hot_keys


def keyed(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Split the key off a message: the key, and a struct of the other columns."""
    return df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(value))


def map_by_key(df: DataFrame, key: str, **exprs: Column) -> DataFrame:
    """Images of the values; the key stays and nothing moves."""
    return df.select(key, *[e.alias(n) for n, e in exprs.items()])


def filter_by_key(df: DataFrame, predicate: Column) -> DataFrame:
    """Values that satisfy the predicate; a key without any vanishes."""
    return df.filter(predicate)


def filter_keys(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows whose key (or key and value) satisfies the predicate."""
    return df.filter(predicate)


def filter_key_size(df: DataFrame, key: str, n: int) -> DataFrame:
    """All values of the keys that hold n values or more. Counts are shuffled, then their keys; values of one key never meet."""
    large = df.groupBy(key).count().filter(F.col("count") >= n).select(key)
    return df.join(large, key, "left_semi")


def to_pairs(df: DataFrame, key: str, value: str, name: str = "pair") -> DataFrame:
    """A bag of (key, value) pairs."""
    return df.select(F.struct(F.col(key).alias("key"), F.col(value).alias("value")).alias(name))


def reduce_by_key(df: DataFrame, key: str, name: str, agg: Column, *, init: object = None, combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The fold of every key's values; `init` is folded in once a key."""
    out = df.groupBy(key).agg(agg.alias(name))
    return out if init is None else out.select(key, combine(F.lit(init), F.col(name)).alias(name))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of every key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__new")).select(key, *[F.col(f"__new.{c}").alias(c) for c in rest])


def pairwise_latest(df: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """For keys with two rows or more, the last two in `order` as structs `newer` and `older` by `time`.

    Of equal times the one that arrived first is the newer, as the fold's first argument is.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = df.withColumn("__rank", F.row_number().over(w)).filter("__rank <= 2")
    row = F.struct(*df.columns)
    place = F.struct(F.col(time), -F.col(order))
    both = last.groupBy(key).agg(F.count("*").alias("__n"), F.max_by(row, place).alias("newer"), F.min_by(row, place).alias("older"))
    return both.filter("__n = 2").select(key, "newer", "older")


def gap_filter(df: DataFrame, key: str, ts: str, max_gap: str, order: str) -> DataFrame:
    """Rows that follow the previous row of their key within max_gap (an interval such as '6 hours')."""
    out = beside(df, key, order, -1, __prev=ts)
    return out.filter(F.col(ts) <= F.col("__prev") + F.expr(f"interval {max_gap}")).drop("__prev")


def zip_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Values of both sides for every key that both have (meant for one value a key; see `latest`)."""
    return left.join(right, key)


def zip_delay(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Every row of a key but its first, with the columns of the row before as prev_*."""
    out = beside(df, key, order, -1, __before=order, **{f"prev_{c}": c for c in columns})
    return out.filter(F.col("__before").isNotNull()).drop("__before")


def dict_lookup(df: DataFrame, dim: DataFrame, on: str, *, broadcast_rows: int = 1_000_000, broadcast_mb: int = 64) -> DataFrame:
    """Join a dictionary; it is broadcast if it has at most that many rows and megabytes, else both sides are shuffled."""
    rows, size = dim.limit(broadcast_rows + 1).agg(F.count("*"), F.sum(_bytes(dim))).first()
    small = rows <= broadcast_rows and (size or 0) <= broadcast_mb << 20
    return df.join(F.broadcast(dim) if small else dim, on)


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: text and binary columns by their length, nested ones by their JSON text."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("array", "map", "struct"):
            c = F.to_json(F.struct(c))
        size = size + 8 + (F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("array", "map", "struct", "string", "binary", "varchar", "char") else F.lit(0))
    return size


def changed_state(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The state of the keys that a batch has rows for."""
    return state.join(batch.select(key).distinct(), key, "left_semi")


def user_state(df: DataFrame, key: str, order: str, lat: str, lon: str) -> DataFrame:
    """At every arrival: the current direction (from the previous position) and the direction before that."""
    hot = hot_keys(df, key)
    moved = beside(df, key, order, -1, hot=hot, __lat=lat, __lon=lon)
    label = F.when(F.col("__lat").isNotNull(), direction(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon")))
    moved = moved.withColumn("current_direction", label).drop("__lat", "__lon")
    return beside(moved, key, order, -1, hot=hot, last_direction="current_direction")
