"""Maps and filters by Python functions, for what column expressions can't say.

A function takes pandas Series, one for each column it is given, and returns one of equal length, so Python is called
once for an Arrow batch and not for every row. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _called(fn: Callable[..., pd.Series], columns: tuple[str, ...], returns: str) -> Column:
    def batch(*series: pd.Series) -> pd.Series:
        return fn(*series)

    # the annotations of `batch` tell Spark what kind of function it is, whatever fn's are
    return F.pandas_udf(batch, returns)(*columns)


def map_with(df: DataFrame, fn: Callable[..., pd.Series], *columns: str, returns: str, name: str = "value") -> DataFrame:
    """The bag of the function's values, one for each occurrence."""
    return df.select(_called(fn, columns, returns).alias(name))


def filter_with(df: DataFrame, fn: Callable[..., pd.Series], *columns: str) -> DataFrame:
    """The occurrences for which the function gives true (null counts as not)."""
    return df.filter(_called(fn, columns, "boolean"))


def map_by_key_with(df: DataFrame, key: str, fn: Callable[..., pd.Series], *columns: str, returns: str, name: str = "value") -> DataFrame:
    """The function's values under the keys of their rows."""
    return df.select(key, _called(fn, columns, returns).alias(name))


def filter_by_key_with(df: DataFrame, fn: Callable[..., pd.Series], *columns: str) -> DataFrame:
    """Values for which the function gives true; a key without any vanishes."""
    return filter_with(df, fn, *columns)
