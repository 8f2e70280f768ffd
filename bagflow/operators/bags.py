"""Algebra on bags. In row form each row is one occurrence; in weighted form `multiplicity` counts equal rows.

Weighted results come from one shuffle on the element with partial sums in every task, so elements of high
multiplicity are no skew. Rows are expanded only where row form is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULTIPLICITY = "multiplicity"


def to_weighted(df: DataFrame) -> DataFrame:
    """One row per distinct element with its multiplicity."""
    return df.groupBy(*df.columns).agg(F.count("*").alias(MULTIPLICITY))


def from_weighted(df: DataFrame) -> DataFrame:
    """One row per occurrence."""
    columns = [c for c in df.columns if c != MULTIPLICITY]
    return df.filter(F.col(MULTIPLICITY) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(MULTIPLICITY))).alias("__copy")).select(*columns)


def bag_map(df: DataFrame, *, weighted: bool = False, **exprs: Column) -> DataFrame:
    """The image of every occurrence. Weighted: images that collide add their multiplicities."""
    named = [e.alias(n) for n, e in exprs.items()]
    if not weighted:
        return df.select(*named)
    return df.select(*named, MULTIPLICITY).groupBy(*exprs).agg(F.sum(MULTIPLICITY).alias(MULTIPLICITY))


def bag_filter(df: DataFrame, predicate: Column) -> DataFrame:
    """The occurrences that satisfy the predicate (null counts as not)."""
    return df.filter(predicate)


def flat_map(df: DataFrame, expr: Column, name: str = "value", *keep: str) -> DataFrame:
    """One row for each element of an array expression."""
    return df.select(*keep, F.explode(expr).alias(name))


def bag_reduce(df: DataFrame, name: str, agg: Column, *, init: object = None, combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The fold of a whole bag: no row for an empty bag without `init`; with it, `init` is folded in exactly once."""
    out = df.agg(agg.alias("__fold"), F.count("*").alias("__rows"))
    if init is None:
        return out.filter("__rows > 0").select(F.col("__fold").alias(name))
    start = F.lit(init)
    return out.select(F.when(F.col("__rows") > 0, combine(start, F.col("__fold"))).otherwise(start).alias(name))


def multiplicities(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Each distinct element with how often it occurs."""
    return df.groupBy(*(columns or df.columns)).agg(F.count("*").alias(name))


def majority(df: DataFrame, column: str, *, name: str = "n", init: bool = False) -> DataFrame:
    """The most frequent value and its count; ties go to the smallest value. With init an empty bag gives (null, -1)."""
    counts = multiplicities(df, column, name=name)
    if init:
        counts = counts.unionByName(df.sparkSession.range(1).select(F.lit(None).cast(df.schema[column].dataType).alias(column), F.lit(-1).cast("long").alias(name)))
    return counts.orderBy(F.col(name).desc(), F.col(column).asc_nulls_last()).limit(1)


def _both(left: DataFrame, right: DataFrame, weighted: bool) -> tuple[DataFrame, list[str]]:
    columns = [c for c in left.columns if c != MULTIPLICITY]
    m = F.col(MULTIPLICITY) if weighted else F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    rows = left.select(*columns, m.alias("__l"), none.alias("__r")).unionByName(right.select(*columns, none.alias("__l"), m.alias("__r")))
    return rows.groupBy(*columns).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r")), columns


def _merged(left: DataFrame, right: DataFrame, weighted: bool, rule: Column) -> DataFrame:
    both, columns = _both(left, right, weighted)
    out = both.select(*columns, rule.alias(MULTIPLICITY)).filter(F.col(MULTIPLICITY) > 0)
    return out if weighted else from_weighted(out)


def bag_union(left: DataFrame, right: DataFrame, *, weighted: bool = False) -> DataFrame:
    """Every element as often as in the side that has it more often (the maximum, not the sum)."""
    return _merged(left, right, weighted, F.greatest("__l", "__r"))


def bag_subtract(left: DataFrame, right: DataFrame, *, weighted: bool = False) -> DataFrame:
    """Every element as often as the left side has it more often than the right one."""
    if not weighted:
        return left.exceptAll(right.select(*left.columns))
    return _merged(left, right, True, F.col("__l") - F.col("__r"))


def bag_intersection(left: DataFrame, right: DataFrame, *, weighted: bool = False) -> DataFrame:
    """Every element as often as both sides have it."""
    if not weighted:
        return left.intersectAll(right.select(*left.columns))
    return _merged(left, right, True, F.least("__l", "__r"))


def bag_distinct(df: DataFrame, *, weighted: bool = False) -> DataFrame:
    """Every element once."""
    return df.withColumn(MULTIPLICITY, F.lit(1).cast("long")) if weighted else df.distinct()


def key_by(df: DataFrame, **key: Column) -> DataFrame:
    """A bag as a keyed bag: key expressions beside the row's columns."""
    return df.select(*[e.alias(n) for n, e in key.items()], *[c for c in df.columns if c not in key])


def unkey(df: DataFrame, **exprs: Column) -> DataFrame:
    """A keyed bag as a bag of expressions over key and value."""
    return df.select(*[e.alias(n) for n, e in exprs.items()])
