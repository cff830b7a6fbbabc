"""Dataset profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.columns import col, flat_columns, numeric_columns
from veritable.operators.categorical import approx_totals
from veritable.operators.checks import ROWS, one_row
from veritable.operators.frequency import column_totals, top_per_column, value_counts
from veritable.operators.quantiles import exact_quantiles
from veritable.session import spread

# ---- fixed values: thresholds ----------------------------------------------
TOP_CATEGORIES, CATEGORY_MAX = 10, 1000
EXAMPLES, EXAMPLE_SAMPLE = 3, 5
SORT_KEYS = ("name", "null", "unique", "distinct", "mean", "median", "std")
# ---- end of fixed values ----------------------------------------------------

PROFILE = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("physical_type", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("null_ratio", T.DoubleType()),
        T.StructField("unique_ratio", T.DoubleType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("min", T.StringType()),
        T.StructField("max", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("mean", "std", "q25", "median", "q75")],
    ]
)


def _moments(df: DataFrame, names: Sequence[str], numeric: set[str]) -> DataFrame:
    """One row: everything a single pass without a shuffle of values can tell."""
    aggs = [F.count(F.lit(1)).alias(ROWS)]
    for i, name in enumerate(names):
        c = col(name)
        ordered = not isinstance(df.schema[name].dataType, T.BinaryType)
        aggs += [
            F.count(c).alias(f"n{i}"),
            (F.min(c) if ordered else F.lit(None)).alias(f"min{i}"),
            (F.max(c) if ordered else F.lit(None)).alias(f"max{i}"),
        ]
        if name in numeric:
            aggs += [F.avg(c).alias(f"avg{i}"), F.stddev_samp(c).alias(f"std{i}")]
    return df.agg(*aggs)


def _text(value) -> str | None:
    return None if value is None else str(value)


def profile(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    *,
    approx: bool = False,
    freq: DataFrame | None = None,
    quantiles: dict | None = None,
) -> DataFrame:
    """One row per column.

    ``approx`` replaces the exact distinct counts and quantiles by sketches, which
    avoids shuffling values.  ``freq`` / ``quantiles`` reuse what a scan computed.
    """
    names = flat_columns(df, cols)
    ready, held = spread(df.select(*[col(c) for c in names]))
    try:
        return _profile(ready, df.columns, names, approx, freq, quantiles)
    finally:
        if held:
            ready.unpersist()


def _profile(df, order, names, approx, freq, quantiles) -> DataFrame:
    spark = df.sparkSession
    numeric = set(numeric_columns(df, names))
    row = one_row(_moments(df, names, numeric))
    rows = row[ROWS]
    if quantiles is None:
        values = {c: col(c) for c in names if c in numeric}
        found = exact_quantiles(df, values, [0.25, 0.5, 0.75], approx=approx)
    else:
        found = {c: [q[0.25], q[0.5], q[0.75]] for c, q in quantiles.items()}
    local = []
    for i, c in enumerate(names):
        q = found.get(c) or [None] * 3
        avg, std = row.get(f"avg{i}"), row.get(f"std{i}")
        local.append(
            (
                c,
                order.index(c),
                df.schema[c].dataType.simpleString(),
                rows,
                row[f"n{i}"],
                _text(row[f"min{i}"]),
                _text(row[f"max{i}"]),
                None if avg is None else float(avg),
                None if std is None else float(std),
                *q,
            )
        )
    known = spark.createDataFrame(
        local,
        "column_name string, ordinal int, physical_type string, row_count bigint, non_null bigint, "
        "min string, max string, mean double, std double, q25 double, median double, q75 double",
    )
    if freq is None and approx:
        totals = approx_totals(df, names)
    else:
        totals = column_totals(freq if freq is not None else value_counts(df, names))
    # One row per column, read here so that the passes above are over when this returns.
    counted = totals.select("column", "distinct").collect()
    distinct = spark.createDataFrame(counted, "column_name string, distinct bigint")
    # One row per column on both sides.
    out = known.join(F.broadcast(distinct), "column_name", "left")
    d = F.coalesce("distinct", F.lit(0))

    def ratio(a, b):
        return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))

    values = {
        "null_ratio": ratio(F.col("row_count") - F.col("non_null"), F.col("row_count")),
        "unique_ratio": ratio(d, F.col("non_null")),
        "distinct_count": d,
    }
    return out.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PROFILE.fields]
    )


def top_categories(
    df: DataFrame, cols: Sequence[str] | None = None, freq: DataFrame | None = None
) -> DataFrame:
    """The ten most frequent values, NULL included, of columns with few distinct ones."""
    freq = freq if freq is not None else value_counts(df, cols, keep_nulls=True)
    totals = column_totals(freq).filter(
        (F.col("distinct") > 1) & (F.col("distinct") <= CATEGORY_MAX)
    )
    # ``totals`` has one row per column.
    wanted = freq.join(F.broadcast(totals.select("column")), "column", "left_semi")
    top = top_per_column(wanted, TOP_CATEGORIES, F.desc("n"), F.asc_nulls_first("value"))
    return top.select(F.col("column").alias("column_name"), "rank", "value", "n")


def nested_categories(top: DataFrame) -> DataFrame:
    """``top_categories array<struct<value, count>>`` per column, for a stored profile."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "value", "n")))
    return top.groupBy("column_name").agg(
        F.transform(
            ranked, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))
        ).alias("top_categories")
    )


def reusable_columns(df: DataFrame, previous: DataFrame) -> list[str]:
    """Columns of the same name and type in ``previous``; none when the whole column
    set is unchanged, since then only the data can have changed."""
    now = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    before = {
        r["column_name"]: r["physical_type"]
        for r in previous.select("column_name", "physical_type").collect()
    }
    known = {c: t for c, t in now.items() if c in flat_columns(df)}
    if known == before:
        return []
    return [c for c, t in known.items() if before.get(c) == t]


def profile_incremental(df: DataFrame, previous: DataFrame, **how) -> DataFrame:
    """Profile new and changed columns, carry the others over."""
    keep = reusable_columns(df, previous)
    todo = [c for c in flat_columns(df) if c not in keep]
    if not keep:
        return profile(df, **how)
    position = F.lit(None).cast("int")
    for i, c in enumerate(df.columns):
        position = F.when(F.col("column_name") == c, F.lit(i)).otherwise(position)
    carried = previous.filter(F.col("column_name").isin(keep)).withColumn("ordinal", position)
    carried = carried.withColumn("row_count", F.lit(df.count()))
    carried = carried.select(*[f.name for f in PROFILE.fields])
    return carried.unionByName(profile(df, todo, **how)) if todo else carried


def rank_profile(profiles: DataFrame, key: str = "null", reverse: bool = True) -> DataFrame:
    """Order the columns of a profile; names compare without regard to case."""
    if key not in SORT_KEYS:
        raise ValueError(f"unsupported sort key: {key}")
    by = {
        "name": F.lower("column_name"),
        "null": F.col("null_ratio"),
        "unique": F.col("unique_ratio"),
        "distinct": F.col("distinct_count"),
    }.get(key, F.col(key))
    return profiles.orderBy(by.desc_nulls_last() if reverse else by.asc_nulls_last(), "ordinal")


def mask_categories(top: DataFrame) -> DataFrame:
    """Personal data inside category values is masked before anyone reads them."""
    from veritable.operators.privacy import mask_text

    return top.withColumn("value", mask_text(F.col("value")))


def column_examples(
    df: DataFrame, keys: Sequence[str], seed: int = 42, sample: int = EXAMPLE_SAMPLE
) -> DataFrame:
    """Up to three distinct texts per column from a small repeatable sample."""
    from veritable.operators.sampling import reservoir_sample

    drawn = reservoir_sample(df, sample, keys, seed)
    cells = [
        F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value"))
        for c in flat_columns(df)
    ]
    # ``drawn`` has ``sample`` rows, so every group below is that small.
    return (
        drawn.select(F.inline(F.array(*cells)))
        .filter("value is not null")
        .groupBy("column_name")
        .agg(F.slice(F.sort_array(F.collect_set("value")), 1, EXAMPLES).alias("examples"))
    )
