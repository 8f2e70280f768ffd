"""Sinks: print a bag, write it as one document, or one row per occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def print_bag(df: DataFrame, label: str = "bag", *, most_rows: int = 10_000) -> None:
    """Print a whole bag under its label, a row a line, as it arrives at the driver; a larger one is an error before any output."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"{label} has more than {most_rows} rows")
    print(label)
    for row in df.toLocalIterator(prefetchPartitions=True):
        print(row)


def whole(df: DataFrame, *, most_rows: int = 10_000, name: str = "document") -> DataFrame:
    """The whole collection as one JSON array, in the order of its rows' JSON texts; for small results only.

    At most most_rows + 1 rows reach the one task that builds it; more than most_rows are an error.
    """
    texts = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(most_rows + 1)
    out = texts.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("j")).alias("all"))
    checked = F.when(F.col("n") > most_rows, F.raise_error(F.lit(f"more than {most_rows} rows"))).otherwise(F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")))
    return out.select(checked.alias(name))


def flat(df: DataFrame, name: str = "message") -> DataFrame:
    """One JSON text per occurrence."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_whole(df: DataFrame, path: str, *, most_rows: int = 10_000, mode: str = "overwrite") -> None:
    whole(df, most_rows=most_rows).coalesce(1).write.mode(mode).text(path)


def write_flat(df: DataFrame, path: str, fmt: str = "json", *, mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)
