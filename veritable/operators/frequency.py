"""The shared value-frequency table: one row per (column, distinct value).

Duplicates, categories, spelling groups and distinct counts all start from it.
Columns are grouped per storage family so that numbers and dates are shuffled
as fixed-width keys and only become text once grouped.  The aggregate combines
on the map side, so a value holding a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.columns import col, flat_columns

FREQUENCY = "column string, value string, n bigint"
#: Bytes of a text that is counted before it is looked at.
SHORT = 64


def _storage(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, T.DoubleType):
        return "double"
    if isinstance(dtype, T.StringType):
        return "string"
    return dtype.simpleString()


def _canonical(c: Column, storage: str) -> Column:
    c = c.cast(storage)
    # -0.0 and 0.0 are one value but print differently.
    return F.when(c == 0, F.lit(0.0)).otherwise(c) if storage in ("double", "float") else c


def text_of(c: Column, storage: str) -> Column:
    return F.base64(c) if storage == "binary" else c.cast("string")


def value_counts(
    df: DataFrame, cols: Sequence[str] | None = None, keep_nulls: bool = False
) -> DataFrame:
    """``(column, value, n)`` over every flat column (or ``cols``)."""
    names = flat_columns(df, cols)
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(_storage(df.schema[name].dataType), []).append(name)
    if not groups:
        return df.sparkSession.createDataFrame([], FREQUENCY)
    parts = []
    for storage, members in groups.items():
        cells = [
            F.struct(F.lit(i).alias("c"), _canonical(col(m), storage).alias("v"))
            for i, m in enumerate(members)
        ]
        cells = df.select(F.inline(F.array(*cells)))
        if not keep_nulls:
            cells = cells.filter(F.col("v").isNotNull())
        labels = F.array(*[F.lit(m) for m in members])
        parts.append(
            cells.groupBy("c", "v")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(
                F.get(labels, F.col("c")).alias("column"),
                text_of(F.col("v"), storage).alias("value"),
                "n",
            )
        )
    return reduce(DataFrame.unionAll, parts)


def text_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of text columns: short values counted, long ones as they come, so that they need no shuffle."""
    short = df.select(*[F.when(F.octet_length(col(c)) <= SHORT, col(c)).alias(c) for c in names])
    cells = [F.struct(F.lit(c).alias("column"), F.when(F.octet_length(col(c)) > SHORT, col(c)).alias("value")) for c in names]
    long = df.select(F.inline(F.array(*cells))).filter("value is not null")
    return value_counts(short, names).unionAll(long.select("column", "value", F.lit(1).cast("bigint").alias("n")))


def column_totals(freq: DataFrame) -> DataFrame:
    """Per column: distinct values, non-null rows, redundant rows."""
    known = freq.filter(F.col("value").isNotNull())
    return known.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum("n").alias("non_null"),
        F.sum(F.col("n") - 1).alias("redundant"),
    )


def top_per_column(df: DataFrame, k: int, *order: Column, by: Sequence[str] = ("column",)):
    """First ``k`` rows per group; Spark keeps only ``k`` per group and task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
