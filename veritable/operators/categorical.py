"""Category detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.functions import predicates as P
from veritable.functions.columns import (
    IDENTIFIER_HINTS,
    col,
    flat_columns,
    string_columns,
    unhinted,
)
from veritable.operators.checks import Check, Target, candidate, evidence_json, run_checks, target
from veritable.operators.frequency import column_totals, top_per_column, value_counts

# ---- fixed values: thresholds ----------------------------------------------
RARE_COUNT, RARE_PER_ROWS = 5, 1000
CATEGORY_MIN, CATEGORY_MAX, NEAR_UNIQUE = 2, 1000, 0.9
EXAMPLES = 20
# ---- end of fixed values ----------------------------------------------------

# Sketches of 2^14 buckets: an error below one percent.
_SKETCH_LOG_SIZE = 14


def placeholder_checks(df: DataFrame, cols=None) -> list[Check]:
    """Values such as 'test' or 'foo'."""
    return [
        Check(
            "suspicious_placeholder",
            (c,),
            P.is_placeholder(col(c)),
            confidence=0.95,
            severity="low",
        )
        for c in string_columns(df, cols)
    ]


def suspicious_placeholder(df: DataFrame | Target, cols=None) -> DataFrame:
    at = target(df)
    return run_checks(at, placeholder_checks(at.df, cols))


def rare_category(df: DataFrame | Target, cols=None, freq=None, rows: int | None = None):
    """Values seen fewer than 5 times, and less than once per 1000 rows, in a
    column that otherwise looks categorical."""
    at = target(df)
    freq = freq if freq is not None else value_counts(at.df, cols)
    rows = at.df.count() if rows is None else rows
    categorical = column_totals(freq).filter(
        F.col("distinct").between(CATEGORY_MIN, CATEGORY_MAX)
        & (F.col("distinct") / F.col("non_null") <= NEAR_UNIQUE)
    )
    rare = freq.filter(
        F.col("value").isNotNull()
        & (F.col("n") < RARE_COUNT)
        & (F.col("n") * RARE_PER_ROWS < rows)
    )
    # ``categorical`` has one row per column.
    rare = rare.join(F.broadcast(categorical.select("column")), "column", "left_semi")
    top = top_per_column(rare, EXAMPLES, F.asc("n"), F.asc("value"))
    shown = top.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("categories"),
    )
    totals = rare.groupBy("column").agg(F.sum("n").alias("affected"), F.count(F.lit(1)).alias("values"))
    # One row per column on both sides.
    return totals.join(F.broadcast(shown), "column").select(
        *candidate(
            at,
            issue_type="rare_category",
            detector_id="rare_category",
            columns=F.array("column"),
            affected=F.col("affected"),
            raw=F.col("values"),
            confidence=0.85,
            fpr=0.1,
            severity="low",
            evidence=evidence_json(
                "statistical_measure",
                {"total_rare_rows": F.col("affected"), "categories": F.col("categories")},
            ),
        )
    )


def category_explosion(df: DataFrame | Target, cols=None, freq=None, approx=False) -> DataFrame:
    """Nearly every value differs although the name does not suggest an identifier."""
    at = target(df)
    names = unhinted(flat_columns(at.df, cols), IDENTIFIER_HINTS)
    if freq is None and approx:
        totals = approx_totals(at.df, names)
    else:
        freq = freq if freq is not None else value_counts(at.df, names)
        totals = column_totals(freq.filter(F.col("column").isin(names)))
    ratio = F.col("distinct") / F.col("non_null")
    return totals.filter(ratio > NEAR_UNIQUE).select(
        *candidate(
            at,
            issue_type="category_explosion",
            detector_id="category_explosion",
            columns=F.array("column"),
            affected=F.col("distinct"),
            raw=ratio,
            confidence=0.8,
            fpr=0.1,
            severity="low",
            evidence=evidence_json(
                "statistical_measure",
                {"unique_ratio": F.round(ratio, 6), "distinct": F.col("distinct")},
            ),
        )
    )


def approx_totals(df: DataFrame, names: list[str]) -> DataFrame:
    """``column_totals`` from one sketch pass, without a shuffle of the values."""

    def sketch(c):
        hashed = F.when(c.isNotNull(), F.xxhash64(c))
        return F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(_SKETCH_LOG_SIZE)))

    sketches = df.agg(
        *[sketch(col(c)).alias(f"d{i}") for i, c in enumerate(names)],
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
    )
    return sketches.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.least(F.col(f"d{i}"), F.col(f"n{i}")).alias("distinct"),
                        F.col(f"n{i}").alias("non_null"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        )
    ).filter("non_null > 0")


def inconsistent_case(df: DataFrame | Target, cols=None, freq=None) -> DataFrame:
    """One value written in several letter cases."""
    at = target(df)
    names = string_columns(at.df, cols)
    freq = freq if freq is not None else value_counts(at.df, names)
    forms = (
        freq.filter(F.col("column").isin(names))
        .groupBy("column", F.trim("value").alias("form"))
        .agg(F.sum("n").alias("n"))
    )
    groups = (
        forms.groupBy("column", P.case_key(F.col("form")).alias("key"))
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("forms"))
        .filter("forms >= 2 and rows >= 2")
    )
    top = top_per_column(groups, EXAMPLES, F.desc("rows"), F.asc("key"))
    shown = top.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "key", "rows", "forms"))).alias("detail")
    )
    totals = groups.groupBy("column").agg(F.sum("rows").alias("affected"), F.count(F.lit(1)).alias("groups"))
    # One row per column on both sides.
    return (
        totals.join(F.broadcast(shown), "column")
        .select(
            *candidate(
                at,
                issue_type="inconsistent_case",
                detector_id="inconsistent_case",
                columns=F.array("column"),
                affected=F.col("affected"),
                raw=F.col("groups"),
                confidence=0.9,
                fpr=0.1,
                severity="low",
                evidence=evidence_json("statistical_measure", {"groups": F.col("detail")}),
            )
        )
    )


DETECTORS = {
    "suspicious_placeholder": suspicious_placeholder,
    "rare_category": rare_category,
    "category_explosion": category_explosion,
    "inconsistent_case": inconsistent_case,
}
