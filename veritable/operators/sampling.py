"""Repeatable sampling.

Rows are ordered by a hash of their key and a seed, so the same data and seed give
the same sample whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.columns import col
from veritable.operators.fingerprint import lane, row_digest
from veritable.operators.quantiles import order_statistics, value_spans

METHODS = ("none", "random", "reservoir", "time_based", "stratified", "rare_oversampling")


def draw_order(df: DataFrame, keys: Sequence[str] | None, seed: int) -> Column:
    return row_digest(df, keys or df.columns, seed)


def reservoir_sample(
    df: DataFrame, n: int, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """``n`` rows, each subset equally likely, repeatable."""
    return _threshold_sample(df, n, draw_order(df, keys, seed))


def _threshold_sample(df: DataFrame, n: int, order: Column) -> DataFrame:
    """Keep rows up to the ``n``-th smallest hash, found by counting: no sort, no gather."""
    # 52 bits, so that the value is exact as a double.
    drawn = df.withColumn("__draw", order).withColumn(
        "__bits", F.shiftright(lane(F.col("__draw"), 1), 8).cast("double")
    )
    bits = {"bits": F.col("__bits")}
    low, high, rows = value_spans(drawn, bits)["bits"]
    if rows <= n:
        return df
    cut = order_statistics(drawn, bits, {"bits": (low, high)}, {"bits": [n - 1]})[("bits", n - 1)]
    below = drawn.filter(F.col("__bits") < cut)
    # Rows sharing the threshold's 52 bits: a handful at most, unless rows are exact copies.
    ties = drawn.filter(F.col("__bits") == cut).orderBy("__draw").limit(n - below.count())
    return below.unionAll(ties).drop("__draw", "__bits")


def head_sample(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows as stored, left where they are: rows are counted per partition, and
    the partition where the ``n``-th lies keeps its first ones."""
    part, place = "__part", "__place"
    placed = df.withColumn(part, F.spark_partition_id()).withColumn(
        place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One number per partition.
    counts = sorted((r[part], r["count"]) for r in placed.groupBy(part).count().collect())
    before = 0
    for i, rows in counts:
        if before + rows >= n:
            keep = (F.col(part) < i) | ((F.col(part) == i) & (F.col(place) < n - before))
            return placed.filter(keep).drop(part, place)
        before += rows
    return df


def time_sample(
    df: DataFrame,
    n: int,
    time_column: str | None,
    keys: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """The earliest ``n`` rows; without a time column, a reservoir sample.

    The moment of the ``n``-th row is found by counting; of the rows at that moment, or of those
    without a time when there are too few with one, a reservoir fills up the rest.
    """
    if time_column is None or time_column not in df.columns:
        return reservoir_sample(df, n, keys, seed)
    # Days or microseconds since the epoch: exact as a double.
    kind, moment = df.schema[time_column].dataType, col(time_column)
    if isinstance(kind, T.DateType):
        moment = F.unix_date(moment)
    elif not isinstance(kind, T.NumericType):
        moment = F.unix_micros(moment.cast("timestamp"))
    timed = df.withColumn("__at", moment.cast("double"))
    known, unknown = timed.filter(F.col("__at").isNotNull()), timed.filter(F.col("__at").isNull())
    at = {"at": F.col("__at")}
    low, high, rows = value_spans(known, at)["at"]
    if rows <= n:
        rest = reservoir_sample(unknown.drop("__at"), n - rows, keys, seed) if rows < n else unknown.drop("__at").limit(0)
        return known.drop("__at").unionAll(rest)
    cut = order_statistics(known, at, {"at": (low, high)}, {"at": [n - 1]})[("at", n - 1)]
    before = known.filter(F.col("__at") < cut).drop("__at")
    same = known.filter(F.col("__at") == cut).drop("__at")
    return before.unionAll(reservoir_sample(same, n - before.count(), keys, seed))


def stratified_sample(
    df: DataFrame,
    strata: Sequence[str],
    per_stratum: int,
    keys: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Up to ``per_stratum`` rows of every stratum.

    Spark keeps only ``per_stratum`` rows per stratum and task before shuffling, so
    a stratum holding most of the table does not overload one task.
    """
    w = Window.partitionBy(*[col(s) for s in strata]).orderBy("__draw")
    return (
        df.withColumn("__draw", draw_order(df, keys, seed))
        .withColumn("__rank", F.row_number().over(w))
        .filter(F.col("__rank") <= per_stratum)
        .drop("__draw", "__rank")
    )


def sample(
    df: DataFrame,
    method: str,
    n: int,
    *,
    time_column: str | None = None,
    strata: Sequence[str] | None = None,
    keys: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Dispatch by method name; stratified methods share ``n`` evenly among the strata."""
    if method not in METHODS:
        raise ValueError(f"unknown sampling method: {method}")
    if method == "none":
        return head_sample(df, n)
    if method == "time_based":
        return time_sample(df, n, time_column, keys, seed)
    if method in ("stratified", "rare_oversampling") and strata:
        groups = df.select(*[col(s) for s in strata]).distinct().count()
        return stratified_sample(df, strata, max(1, n // max(1, groups)), keys, seed)
    return reservoir_sample(df, n, keys, seed)
