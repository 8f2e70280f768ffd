"""The direction most users are moving in, from a log of their positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import direction
from ..operators import bags, keyed


def directions(log: DataFrame, key: str, order: str, time: str, lat: str = "lat", lon: str = "lon", *, fix_east: bool = False) -> DataFrame:
    """(key, direction) of every key with two positions or more, from its last two by arrival.

    One shuffle by key, of two rows a key and task; grouping by key reuses its partitioning.
    """
    both = keyed.pairwise_latest(log, key, order, time)
    label = direction(F.col(f"newer.{lat}"), F.col(f"newer.{lon}"), F.col(f"older.{lat}"), F.col(f"older.{lon}"), fix_east=fix_east)
    return both.select(key, label.alias("direction"))


def counts(log: DataFrame, key: str, order: str, time: str, **options) -> DataFrame:
    return bags.multiplicities(directions(log, key, order, time, **options).select("direction"), "direction")


def majority(log: DataFrame, key: str, order: str, time: str, **options) -> DataFrame:
    return bags.majority(directions(log, key, order, time, **options).select("direction"), "direction")
