"""Jobs of a few steps: keyed increment with two sinks, bag algebra over two views, word count, run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parts
from ..operators import bags, keyed
from ..sources import sinks


def keyed_increment(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Every value plus one, as one document and as one message per occurrence."""
    out = keyed.map_by_key(df, key, **{value: F.col(value) + 1})
    return sinks.whole(out), sinks.flat(out)


def bag_algebra(df: DataFrame, value: str, left: int, right: int) -> DataFrame:
    """Union, intersection, both subtractions and the distinct union of the multiples of two numbers, read and shuffled once.

    Both views are tagged in one pass; every result is a rule on the two counts of an element.
    """
    one = F.when
    sides = df.groupBy(value).agg(F.sum(one(F.pmod(value, F.lit(left)) == 0, 1).otherwise(0)).alias("l"), F.sum(one(F.pmod(value, F.lit(right)) == 0, 1).otherwise(0)).alias("r"))
    rules = {
        "union": F.greatest("l", "r"),
        "intersection": F.least("l", "r"),
        "left_only": F.greatest(F.col("l") - F.col("r"), F.lit(0)),
        "right_only": F.greatest(F.col("r") - F.col("l"), F.lit(0)),
        "distinct": F.least(F.greatest("l", "r"), F.lit(1)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("op"), r.cast("long").alias("n")) for k, r in rules.items()]))
    return sides.select(value, each.alias("e")).select("e.op", value, "e.n").filter("n > 0")


def word_count(df: DataFrame, text: str) -> DataFrame:
    """How often each word occurs; hot words are summed in tasks first."""
    return bags.multiplicities(bags.flat_map(df, parts(F.col(text)), "word").filter("word <> ''"), "word")


def run_report(df: DataFrame, test: str, ms: str) -> DataFrame:
    """Runs, mean and sample standard deviation per test."""
    return df.groupBy(test).agg(F.count("*").alias("runs"), F.avg(ms).alias("mean"), F.stddev_samp(ms).alias("std_dev"))
