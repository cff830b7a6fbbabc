"""Small shared parts: the held-out remainder, columns by name, block sizes, tables in the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.session import scratch_path


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; NULL for a NULL id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(by))


def field(df: DataFrame, name: str) -> Column:
    """A top-level column, whatever characters its name holds; NULL text if the table lacks it."""
    if name in df.columns:
        return df["`" + name.replace("`", "``") + "`"]
    return F.lit(None).cast("string")


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, ``doc_id`` as bigint and the others as they are."""
    return df.select(
        *(field(df, c).cast("bigint").alias(c) if c == "doc_id" else field(df, c).alias(c) for c in columns)
    )


def shards(df: DataFrame) -> int:
    """How many tasks a shuffle of this session has; it is set with the size of the input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def blocks(df: DataFrame, text_bytes: int, block_bytes: int) -> int:
    """Blocks of at most about ``block_bytes``, and no fewer than the session's shuffle tasks."""
    return max(shards(df), math.ceil(text_bytes / block_bytes))


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: what several jobs read stays the
    same in all of them, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ...: tables with any names, dots and clashes too, can then
    go through Python functions and get columns added."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))
