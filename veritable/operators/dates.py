"""Date and time detectors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions import predicates as P
from veritable.functions.columns import (
    DATE_HINTS,
    STALE_EXEMPT_HINTS,
    col,
    hinted,
    string_columns,
    temporal_columns,
    unhinted,
)
from veritable.operators.checks import Check, Target, candidate, evidence_json, run_checks, target
from veritable.operators.frequency import column_totals, value_counts

# ---- fixed values: thresholds ----------------------------------------------
FUTURE_DAYS, STALE_DAYS = 1, 365
MIXED_DISTINCT, MIXED_SHARE = 10, 0.02
DATE_CLASSES = ("iso", "slash", "dot", "compact")
REPEATS = 2
# ---- end of fixed values ----------------------------------------------------

Day = dt.date | str | None


def _today(as_of: Day) -> Column:
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def _date_texts(df: DataFrame, cols=None) -> list[str]:
    return hinted(string_columns(df, cols), DATE_HINTS)


def invalid_date_checks(df: DataFrame, cols=None) -> list[Check]:
    return [
        Check("invalid_date", (c,), P.is_not_iso_date(col(c)), confidence=0.9, severity="medium")
        for c in _date_texts(df, cols)
    ]


def impossible_date_checks(df: DataFrame, cols=None) -> list[Check]:
    return [
        Check(
            "impossible_date",
            (c,),
            P.is_impossible_date(col(c)),
            confidence=0.95,
            severity="high",
            evidence_type="constraint_violation",
        )
        for c in _date_texts(df, cols)
    ]


def future_checks(df: DataFrame, cols=None, as_of: Day = None, days=FUTURE_DAYS) -> list[Check]:
    limit = F.date_add(_today(as_of), days)
    return [
        Check(
            "future_date",
            (c,),
            col(c) > limit,
            confidence=0.9,
            severity="low",
            evidence_type="constraint_violation",
        )
        for c in temporal_columns(df, cols)
    ]


def stale_checks(df: DataFrame, cols=None, as_of: Day = None, days=STALE_DAYS) -> list[Check]:
    limit = F.date_sub(_today(as_of), days)
    return [
        Check(
            "stale_date",
            (c,),
            col(c) < limit,
            confidence=0.85,
            severity="low",
            evidence={"max_age_days": days},
            evidence_type="constraint_violation",
        )
        for c in unhinted(temporal_columns(df, cols), STALE_EXEMPT_HINTS)
    ]


def invalid_date(df: DataFrame | Target, cols=None) -> DataFrame:
    """Date texts that are not yyyy-mm-dd."""
    at = target(df)
    return run_checks(at, invalid_date_checks(at.df, cols))


def impossible_date(df: DataFrame | Target, cols=None) -> DataFrame:
    """Yyyy-mm-dd texts that name no calendar day."""
    at = target(df)
    return run_checks(at, impossible_date_checks(at.df, cols))


def future_date(df: DataFrame | Target, cols=None, as_of: Day = None) -> DataFrame:
    """Later than the day after ``as_of`` (today by default)."""
    at = target(df)
    return run_checks(at, future_checks(at.df, cols, as_of))


def stale_date(df: DataFrame | Target, cols=None, as_of: Day = None) -> DataFrame:
    """More than 365 days before ``as_of``."""
    at = target(df)
    return run_checks(at, stale_checks(at.df, cols, as_of))


def mixed_date_format(df: DataFrame | Target, cols=None, freq=None) -> DataFrame:
    """Several date notations in one column, judged on all of its values."""
    at = target(df)
    names = _date_texts(at.df, cols)
    freq = freq if freq is not None else value_counts(at.df, names)
    known = freq.filter(F.col("column").isin(names) & F.col("value").isNotNull())
    kind = P.date_class(F.col("value"))
    per_column = known.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum("n").alias("total"),
        *[F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0)).alias(k) for k in DATE_CLASSES],
    )
    total = F.col("total")
    major = F.aggregate(
        F.array(*[(F.col(k) / total > MIXED_SHARE).cast("int") for k in DATE_CLASSES]),
        F.lit(0),
        lambda a, b: a + b,
    )
    parsed = F.aggregate(F.array(*map(F.col, DATE_CLASSES)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    # The main notation is the most frequent one.
    affected = parsed - F.greatest(*DATE_CLASSES)
    shares = {k: F.round(F.col(k) / total, 4) for k in DATE_CLASSES}
    return (
        per_column.withColumn("major", major)
        .filter((F.col("distinct") >= MIXED_DISTINCT) & (F.col("major") >= 2))
        .select(
            *candidate(
                at,
                issue_type="mixed_date_format",
                detector_id="mixed_date_format",
                columns=F.array("column"),
                affected=affected,
                raw=F.col("major"),
                confidence=0.85,
                fpr=0.1,
                severity="low",
                evidence=evidence_json("statistical_measure", shares),
            )
        )
    )


def duplicate_timestamp(df: DataFrame | Target, cols=None, freq=None) -> DataFrame:
    """The same moment more than twice."""
    at = target(df)
    names = temporal_columns(at.df, cols)
    freq = freq if freq is not None else value_counts(at.df, names)
    repeated = freq.filter(F.col("column").isin(names) & (F.col("n") > REPEATS))
    totals = column_totals(repeated).select(
        "column", F.col("redundant").alias("affected"), F.col("distinct").alias("groups")
    )
    return totals.select(
        *candidate(
            at,
            issue_type="duplicate_timestamp",
            detector_id="duplicate_timestamp",
            columns=F.array("column"),
            affected=F.col("affected"),
            raw=F.col("groups"),
            confidence=0.9,
            fpr=0.1,
            severity="medium",
            evidence=evidence_json(
                "duplicate_match",
                {"groups": F.col("groups"), "total_duplicates": F.col("affected")},
            ),
        )
    )


DETECTORS = {
    "invalid_date": invalid_date,
    "impossible_date": impossible_date,
    "future_date": future_date,
    "stale_date": stale_date,
    "mixed_date_format": mixed_date_format,
    "duplicate_timestamp": duplicate_timestamp,
}
