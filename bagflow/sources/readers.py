"""Sources: bags and keyed bags from files or streams, and parsing of text messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_bag(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet", *, streaming: bool = False, **options: str) -> DataFrame:
    """A bag from files; with streaming, every file that arrives adds its rows. Text formats need a schema."""
    if schema is None and (streaming or fmt != "parquet"):
        raise ValueError("a schema is needed for streams and text formats")
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def parse_delimited(df: DataFrame, schema: dict[str, str], sep: str = ";", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Rows of delimited lines with typed columns, and the lines that aren't such rows (wrong count or type)."""
    parts = F.split(F.col(line), f"\\Q{sep}\\E", -1)
    typed = df.select(
        F.col(line).alias("__line"),
        (F.size(parts) == len(schema)).alias("__fits"),
        *[F.get(parts, F.lit(i)).alias(f"__raw_{i}") for i in range(len(schema))],
        *[F.expr(f"try_cast(get(split(`{line}`, '\\\\Q{sep}\\\\E', -1), {i}) as {kind})").alias(name) for i, (name, kind) in enumerate(schema.items())],
    )
    good: Column = F.col("__fits")
    for i, name in enumerate(schema):
        good = good & (F.col(name).isNotNull())
    good = F.coalesce(good, F.lit(False))
    return typed.filter(good).select(*schema), typed.filter(~good).select(F.col("__line").alias(line))


def parse_messages(df: DataFrame, schema: StructType | str, message: str = "value", *keep: str) -> DataFrame:
    """JSON messages as columns; parsing stays on the executors. Text that isn't such a message gives nulls."""
    return df.select(*keep, F.from_json(F.col(message), schema).alias("__m")).select(*keep, "__m.*")
