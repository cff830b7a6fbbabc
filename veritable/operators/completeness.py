"""Missing-value detectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions import predicates as P
from veritable.functions.columns import (
    TIME_TEXT_HINTS,
    col,
    flat_columns,
    hinted,
    string_columns,
    temporal_columns,
)
from veritable.operators.checks import (
    Check,
    Target,
    candidate,
    empty,
    evidence_json,
    null_counts,
    one_row,
    run_checks,
    target,
)

# ---- fixed values: thresholds ----------------------------------------------
NULL_RATE, NULL_RATE_MEDIUM, NULL_RATE_HIGH = 0.05, 0.1, 0.3
TOKEN_RATE = 0.005
SPARSE_RATE = 0.02
GROUP_MAX_DISTINCT = 50
TARGET_RATE = 0.01
BUCKETS_WANTED, BUCKET_ROWS = 5, 10
MIN_RATIO, MIN_GAP = 0.2, 0.2
CASCADE_NULLS, CASCADE_COVERAGE = 10, 0.8
TOGETHER_NULLS, TOGETHER_COVERAGE = 5, 0.5
# ---- end of fixed values ----------------------------------------------------

#: So few pairs are counted beside other checks; more in one product of NULL masks.
COUNTED_PAIRS = 100
#: Columns in a word of a mask, masks multiplied at once, and columns counted against each other in one read.
MASK_BITS, MASK_ROWS, PAIR_BLOCK = 62, 4096, 2048

# Slots that values hash into.  Each occupied slot has a value of its own, so more than
# GROUP_MAX_DISTINCT occupied ones prove a column to be beyond that limit.
_SLOTS = 64


def null_rate_checks(df: DataFrame, cols: Sequence[str] | None = None, max_ratio=NULL_RATE):
    """Share of NULLs above ``max_ratio``."""
    names = [c for c in df.columns if cols is None or c in cols]
    return [
        Check(
            "excessive_null_rate",
            (c,),
            col(c).isNull(),
            confidence=0.95,
            severity="low",
            ladder=((NULL_RATE_MEDIUM, "medium"), (NULL_RATE_HIGH, "high")),
            over=max_ratio,
            score_ratio=True,
            evidence_type="statistical_measure",
        )
        for c in names
    ]


def missing_token_checks(df: DataFrame, cols: Sequence[str] | None = None, min_ratio=TOKEN_RATE):
    """Texts that stand for "no value"."""
    return [
        Check(
            "suspicious_missing_token",
            (c,),
            P.is_missing_token(col(c)),
            confidence=0.9,
            severity="low",
            over=min_ratio,
        )
        for c in string_columns(df, cols)
    ]


def sparse_columns(nulls: dict[str, int], rows: int) -> list[str]:
    """All sparse columns, most sparse first."""
    sparse = [c for c, n in nulls.items() if rows and n / rows >= SPARSE_RATE]
    return sorted(sparse, key=lambda c: -nulls[c])


def sparse_pairs(nulls: dict[str, int], rows: int) -> list[tuple[str, str]]:
    """Ordered pairs of all sparse columns, most sparse first."""
    sparse = sparse_columns(nulls, rows)
    return [(a, b) for i, a in enumerate(sparse) for b in sparse[i + 1 :]]


def null_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a, b, n``: in how many rows the columns at places ``a`` < ``b`` of ``cols`` are both NULL, where in any.

    Rows become masks of their NULLs, and equal masks one row with a count before anything else happens.  The masks of
    a task are a matrix of bits; its product with itself, weighted by the counts, has all pair counts at once.  So the
    table is read once for every pair of blocks of ``PAIR_BLOCK`` columns, which is once for nearly all tables.
    """
    blocks = [range(at, min(at + PAIR_BLOCK, len(cols))) for at in range(0, len(cols), PAIR_BLOCK)]
    parts = [
        _block_pairs(df, cols, [*left, *(() if left is right else right)])
        for i, left in enumerate(blocks)
        for right in blocks[i:]
    ]
    # A pair within one block is counted again by every other block; the counts are equal.
    return reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.max("n").alias("n"))


def _block_pairs(df: DataFrame, cols: Sequence[str], places: list[int]) -> DataFrame:
    words = []
    for at in range(0, len(places), MASK_BITS):
        bits = [F.when(col(cols[p]).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(places[at : at + MASK_BITS])]
        words.append(reduce(lambda x, y: x.bitwiseOR(y), [b.cast("bigint") for b in bits]).alias(f"m{len(words)}"))
    names = [f"m{i}" for i in range(len(words))]
    set_bits = reduce(lambda x, y: x + y, [F.bit_count(n) for n in names])
    masks = df.select(*words).filter(set_bits >= 2).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    number = np.array(places)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(number), len(number)))
        for batch in batches:
            for at in range(0, batch.num_rows, MASK_ROWS):
                part = batch.slice(at, MASK_ROWS)
                wide = np.stack([part.column(n).to_numpy() for n in names], axis=1).astype("<i8")
                bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").reshape(len(wide), len(names), 64)
                bits = bits[:, :, :MASK_BITS].reshape(len(wide), -1)[:, : len(number)].astype(np.float64)
                total += (bits * part.column("n").to_numpy()[:, None]).T @ bits
        a, b = np.nonzero(np.triu(total, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(number[a], pa.int32()), pa.array(number[b], pa.int32()), pa.array(total[a, b].astype(np.int64))], ["a", "b", "n"]
        )

    return masks.mapInArrow(product, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _pair_candidates(at: Target, detector_id: str, counted: DataFrame, known, base, evidence, severity: str, coverage: float) -> DataFrame:
    """Candidates of pairs that are NULL together often enough, compared with ``base`` of them."""
    rows, nulls = known
    sparse = sparse_columns(nulls, rows)
    names, counts = F.array(*map(F.lit, sparse)), F.array(*(F.lit(nulls[c]).cast("bigint") for c in sparse))
    told = counted.select(
        F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"),
        F.get(counts, F.col("a")).alias("na"), F.get(counts, F.col("b")).alias("nb"), "n",
    )
    told = told.withColumn("base", base).withColumn("ratio", F.col("n") / F.col("base"))
    return told.filter(F.col("ratio") >= coverage).select(
        *candidate(
            at,
            issue_type=detector_id,
            detector_id=detector_id,
            columns=F.array("a", "b"),
            affected=F.col("n"),
            raw=F.col("ratio"),
            confidence=0.85,
            fpr=0.15,
            severity=severity,
            evidence=evidence_json("statistical_measure", evidence | {"count": F.col("n"), "ratio": F.round("ratio", 6)}),
        )
    )


def _both(a: str, b: str) -> Column:
    return col(a).isNull() & col(b).isNull()


def conditional_checks(nulls: dict[str, int], rows: int) -> list[Check]:
    """Wherever ``a`` is missing, ``b`` nearly always is too."""
    return [
        Check(
            "conditional_missingness",
            (a, b),
            _both(a, b),
            confidence=0.85,
            fpr=0.15,
            severity="medium",
            base=nulls[a],
            at_least=CASCADE_COVERAGE,
            score_ratio=True,
            evidence={"condition_column": a, "target_column": b, "condition_null": nulls[a]},
            evidence_type="statistical_measure",
        )
        for a, b in sparse_pairs(nulls, rows)
        if nulls[a] >= CASCADE_NULLS
    ]


def correlated_checks(nulls: dict[str, int], rows: int) -> list[Check]:
    """Two columns missing in the same rows."""
    return [
        Check(
            "correlated_missingness",
            (a, b),
            _both(a, b),
            confidence=0.85,
            fpr=0.15,
            severity="low",
            base=min(nulls[a], nulls[b]),
            min_count=TOGETHER_NULLS,
            at_least=TOGETHER_COVERAGE,
            score_ratio=True,
            evidence={"column_a": a, "column_b": b, "a_null": nulls[a], "b_null": nulls[b]},
            evidence_type="statistical_measure",
        )
        for a, b in sparse_pairs(nulls, rows)
    ]


def excessive_null_rate(df: DataFrame | Target, cols=None, max_ratio=NULL_RATE) -> DataFrame:
    at = target(df)
    return run_checks(at, null_rate_checks(at.df, cols, max_ratio))


def suspicious_missing_token(df: DataFrame | Target, cols=None, min_ratio=TOKEN_RATE) -> DataFrame:
    at = target(df)
    return run_checks(at, missing_token_checks(at.df, cols, min_ratio))


def conditional_missingness(df: DataFrame | Target, nulls=None, both: DataFrame | None = None) -> DataFrame:
    """D05; ``both`` are the pair counts of ``null_pairs`` where they are there already."""
    at = target(df)
    rows, nulls = nulls or null_counts(at.df, at.df.columns)
    if both is None and len(sparse_pairs(nulls, rows)) <= COUNTED_PAIRS:
        return run_checks(at, conditional_checks(nulls, rows))
    both = null_pairs(at.df, sparse_columns(nulls, rows)) if both is None else both
    evidence = {"condition_column": F.col("a"), "target_column": F.col("b"), "condition_null": F.col("na")}
    base = F.when(F.col("na") >= CASCADE_NULLS, F.col("na"))
    return _pair_candidates(at, "conditional_missingness", both, (rows, nulls), base, evidence, "medium", CASCADE_COVERAGE)


def correlated_missingness(df: DataFrame | Target, nulls=None, both: DataFrame | None = None) -> DataFrame:
    """D06; ``both`` as for ``conditional_missingness``."""
    at = target(df)
    rows, nulls = nulls or null_counts(at.df, at.df.columns)
    if both is None and len(sparse_pairs(nulls, rows)) <= COUNTED_PAIRS:
        return run_checks(at, correlated_checks(nulls, rows))
    both = (null_pairs(at.df, sparse_columns(nulls, rows)) if both is None else both).filter(F.col("n") >= TOGETHER_NULLS)
    evidence = {"column_a": F.col("a"), "column_b": F.col("b"), "a_null": F.col("na"), "b_null": F.col("nb")}
    base = F.least("na", "nb")
    return _pair_candidates(at, "correlated_missingness", both, (rows, nulls), base, evidence, "low", TOGETHER_COVERAGE)


def _null_tallies(targets: Sequence[str], source: str | None = None) -> list[Column]:
    if source is None:
        return [F.count_if(col(t).isNull()).alias(f"t{i}") for i, t in enumerate(targets)]
    return [F.sum(f"t{i}").alias(f"t{i}") for i in range(len(targets))]


def _by_target(df: DataFrame, targets: Sequence[str], overall: Sequence[float], *keep: str):
    """One row per (group, target) from the per-target NULL tallies, outliers only."""
    per_target = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("target_no"),
                    F.lit(t).alias("target"),
                    F.col(f"t{i}").alias("nulls"),
                    F.lit(float(overall[i])).alias("overall"),
                )
                for i, t in enumerate(targets)
            ]
        )
    )
    ratio = F.col("nulls") / F.col("n")
    return (
        df.select(*keep, "n", per_target)
        .withColumn("ratio", ratio)
        .filter(F.col("n") >= BUCKET_ROWS)
        .filter(F.col("ratio") >= F.greatest(F.lit(MIN_RATIO), F.col("overall") + MIN_GAP))
    )


def _time_cells(df: DataFrame, time_cols: Sequence[str]) -> list[Column]:
    strings = set(string_columns(df))
    cells = []
    for i, name in enumerate(time_cols):
        c = F.try_to_timestamp(F.trim(col(name))) if name in strings else col(name)
        cells.append(F.struct(F.lit(i).alias("time_no"), c.cast("date").alias("day")))
    return cells


def sudden_missingness(df: DataFrame | Target, nulls=None) -> DataFrame:
    """Time buckets in which a column is missing far more often than overall.

    One aggregate counts every target per (time column, day); months and years are
    rolled up from those few rows when a column spans too few days.
    """
    at = target(df)
    rows, nulls = nulls or null_counts(at.df, at.df.columns)
    targets = [c for c, n in nulls.items() if rows and n / rows >= TARGET_RATE]
    times = temporal_columns(at.df) + hinted(string_columns(at.df), TIME_TEXT_HINTS)
    if not targets or not times:
        return empty(at.spark)
    tallies = [col(t).isNull().alias(f"is{i}") for i, t in enumerate(targets)]
    days = (
        at.df.select(*tallies, F.inline(F.array(*_time_cells(at.df, times))))
        .filter(F.col("day").isNotNull())
        .groupBy("time_no", "day")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(f"is{i}").alias(f"t{i}") for i in range(len(targets))],
        )
    )
    month, year = F.date_format("day", "yyyy-MM"), F.date_format("day", "yyyy")
    spans = days.groupBy("time_no").agg(
        F.count_distinct("day").alias("days"), F.count_distinct(month).alias("months")
    )
    granularity = (
        F.when(F.col("days") >= BUCKETS_WANTED, "day")
        .when(F.col("months") >= BUCKETS_WANTED, "month")
        .otherwise("year")
    )
    # ``spans`` has one row per time column, so broadcasting it is bounded by the schema.
    sized = days.join(F.broadcast(spans.select("time_no", granularity.alias("granularity"))), "time_no")
    bucket = (
        F.when(F.col("granularity") == "day", F.date_format("day", "yyyy-MM-dd"))
        .when(F.col("granularity") == "month", month)
        .otherwise(year)
    )
    buckets = sized.groupBy("time_no", "granularity", bucket.alias("bucket")).agg(
        F.sum("n").alias("n"), *_null_tallies(targets, "days")
    )
    overall = [nulls[t] / rows for t in targets]
    hits = _by_target(buckets, targets, overall, "time_no", "granularity", "bucket")
    time_name = F.get(F.array(*[F.lit(t) for t in times]), F.col("time_no"))
    return hits.select(
        *candidate(
            at,
            issue_type="sudden_missingness",
            detector_id="sudden_missingness",
            columns=F.array("target"),
            affected=F.col("nulls"),
            raw=F.col("ratio"),
            confidence=0.9,
            fpr=0.15,
            severity="medium",
            evidence=evidence_json(
                "statistical_measure",
                {
                    "time_column": time_name,
                    "bucket": F.col("bucket"),
                    "granularity": F.col("granularity"),
                    "target_column": F.col("target"),
                    "nulls": F.col("nulls"),
                    "bucket_size": F.col("n"),
                    "null_ratio": F.round("ratio", 6),
                    "overall_ratio": F.round("overall", 6),
                },
            ),
        )
    )


def occupied_slots(c: Column) -> Column:
    """How many of ``_SLOTS`` slots the values of a column hash into: at most their distinct number."""
    slot = F.pmod(F.xxhash64(c), F.lit(_SLOTS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot)
    return F.bit_count(F.coalesce(F.bit_or(F.when(c.isNotNull(), bit)), F.lit(0).cast("bigint")))


def group_missingness(df: DataFrame | Target, nulls=None, slots=None):
    """Categories in which a column is missing far more often than overall.

    All text columns without NULLs are tried against all columns with some.  Columns
    proven to hold more than ``GROUP_MAX_DISTINCT`` values are left out before grouping;
    the exact limit is applied to the grouped rows.
    """
    at = target(df)
    rows, nulls = nulls or null_counts(at.df, at.df.columns)
    targets = [c for c, n in nulls.items() if n > 0]
    names = [c for c in string_columns(at.df) if c not in targets]
    if not targets or not names:
        return empty(at.spark)
    if slots is None:
        row = one_row(at.df.agg(*[occupied_slots(col(c)).alias(f"d{i}") for i, c in enumerate(names)]))
        slots = {c: row[f"d{i}"] for i, c in enumerate(names)}
    names = [c for c in names if slots[c] <= GROUP_MAX_DISTINCT]
    if not names:
        return empty(at.spark)
    cells = [F.struct(F.lit(i).alias("group_no"), col(c).alias("value")) for i, c in enumerate(names)]
    flags = [col(t).isNull().alias(f"is{i}") for i, t in enumerate(targets)]
    groups = (
        at.df.select(*flags, F.inline(F.array(*cells)))
        .groupBy("group_no", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(f"is{i}").alias(f"t{i}") for i in range(len(targets))],
        )
        .withColumn("distinct", F.count(F.lit(1)).over(Window.partitionBy("group_no")))
        .filter(F.col("distinct").between(2, GROUP_MAX_DISTINCT))
    )
    hits = _by_target(groups, targets, [nulls[t] / rows for t in targets], "group_no", "value")
    group_name = F.get(F.array(*[F.lit(c) for c in names]), F.col("group_no"))
    return hits.select(
        *candidate(
            at,
            issue_type="group_missingness",
            detector_id="group_missingness",
            columns=F.array("target"),
            affected=F.col("nulls"),
            raw=F.col("ratio"),
            confidence=0.85,
            fpr=0.15,
            severity="medium",
            evidence=evidence_json(
                "statistical_measure",
                {
                    "group_column": group_name,
                    "group_value": F.col("value"),
                    "target_column": F.col("target"),
                    "nulls": F.col("nulls"),
                    "group_size": F.col("n"),
                    "null_ratio": F.round("ratio", 6),
                    "overall_ratio": F.round("overall", 6),
                },
            ),
        )
    )


DETECTORS = {
    "excessive_null_rate": excessive_null_rate,
    "suspicious_missing_token": suspicious_missing_token,
    "sudden_missingness": sudden_missingness,
    "group_missingness": group_missingness,
    "conditional_missingness": conditional_missingness,
    "correlated_missingness": correlated_missingness,
}
