"""Connected components of link tables too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(links: DataFrame, *, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """`node` and `root` (the smallest node it reaches) for every node of the links that isn't its own root.

    Alternates large-star and small-star steps, each of which re-links neighbours to the smallest one, until nothing
    changes; every round is written, so lineage stays short. Links of a node to itself, null ends and repeated links
    don't matter. An empty table gives an empty result.
    """
    a, b = F.col(left), F.col(right)
    links = links.filter(a.isNotNull() & b.isNotNull() & (a != b))
    links = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(links)
    for _ in range(rounds):
        if not before[0]:
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        links = written(small.filter("u <> v").distinct(), "small-star")
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
