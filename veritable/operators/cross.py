"""Cross-column and cross-table detectors."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions.columns import col, family_of
from veritable.operators.checks import (
    Check,
    Target,
    candidate,
    empty,
    evidence_json,
    run_checks,
    target,
)

# ---- fixed values: column name pairs ----------------------------------------
RANGE_PREFIXES = (
    (("start", "begin", "from"), ("end", "finish", "to")),
    (("min", "lower"), ("max", "upper")),
)
# ---- end of fixed values ----------------------------------------------------

_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def range_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """Column pairs such as (min_qty, max_qty) whose types can be compared."""
    types = {f.name: f.dataType for f in df.schema.fields}
    plain = [n for n in types if _PLAIN_NAME.fullmatch(n)]
    pairs = []
    for lefts, rights in RANGE_PREFIXES:
        for left in plain:
            head, _, rest = left.partition("_")
            if head not in lefts or not rest:
                continue
            for right in (f"{r}_{rest}" for r in rights):
                if right not in plain:
                    continue
                a, b = types[left], types[right]
                if a == b or (family_of(a) == family_of(b) != "other"):
                    pairs.append((left, right))
    return pairs


def range_checks(df: DataFrame) -> list[Check]:
    """The lower end lies above the upper one; NULL on either side does not count."""
    return [
        Check(
            "cross_field_rule",
            (a, b),
            col(a) > col(b),
            confidence=0.95,
            severity="medium",
            issue_type="cross_field_violation",
            evidence={"expression": f"{a} <= {b}"},
            evidence_type="constraint_violation",
        )
        for a, b in range_pairs(df)
    ]


def cross_field_rule(df: DataFrame | Target) -> DataFrame:
    at = target(df)
    return run_checks(at, range_checks(at.df))


def cross_field_rows(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """The offending rows of all pairs from one read; with ``limit``, the first of each pair by key."""
    found = [
        F.when(
            col(a) > col(b),
            F.struct(
                F.lit(f"{a} <= {b}").alias("expression"),
                col(a).cast("string").alias("left_value"),
                col(b).cast("string").alias("right_value"),
            ),
        )
        for a, b in range_pairs(df)
    ]
    if not found:
        raise ValueError("no comparable range columns")
    rows = df.select(*[col(k) for k in keys], F.inline(F.array_compact(F.array(*found))))
    if limit is not None:
        first = F.row_number().over(Window.partitionBy("expression").orderBy(*[col(k) for k in keys]))
        rows = rows.withColumn("__k", first).filter(F.col("__k") <= limit)
    return rows.select("expression", *[col(k) for k in keys], "left_value", "right_value")


@dataclass(frozen=True)
class Reference:
    """A referenced table: which of our columns point at which of its columns."""

    name: str
    df: DataFrame
    columns: Mapping[str, str]


def orphan_counts(main: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """One row: non-null rows of ``column`` and those without a match.

    Rows are first counted per key, so a hot key reaches the join as one row; the
    key distribution of that count also serves the join.
    """
    keys = (
        main.filter(col(column).isNotNull())
        .groupBy(col(column).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = ref.select(col(ref_column).alias("ref_key")).filter("ref_key is not null").distinct()
    matched = keys.join(known, keys["key"] == known["ref_key"], "left_outer")
    return matched.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("ref_key").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
        F.count_if(F.col("ref_key").isNull()).alias("orphan_keys"),
    )


def foreign_key_violation(df: DataFrame | Target, references: Sequence[Reference]) -> DataFrame:
    """Non-null values absent from the referenced column, per declared pair."""
    at = target(df)
    parts = []
    for ref in references:
        for column, ref_column in ref.columns.items():
            if column not in at.df.columns or ref_column not in ref.df.columns:
                continue
            ratio = F.col("orphans") / F.col("total")
            found = orphan_counts(at.df, column, ref.df, ref_column).filter("orphans > 0")
            parts.append(
                found.select(
                    *candidate(
                        at,
                        issue_type="foreign_key_violation",
                        detector_id="foreign_key_violation",
                        columns=F.array(F.lit(column)),
                        affected=F.col("orphans"),
                        raw=F.least(ratio * 100, F.lit(100.0)),
                        confidence=0.95,
                        fpr=0.05,
                        severity="high",
                        evidence=evidence_json(
                            "constraint_violation",
                            {
                                "reference": ref.name,
                                "reference_column": ref_column,
                                "orphan_count": F.col("orphans"),
                                "orphan_ratio": ratio,
                                "main_total_non_null": F.col("total"),
                            },
                        ),
                    )
                )
            )
    return reduce(DataFrame.unionByName, parts) if parts else empty(at.spark)


DETECTORS = {
    "cross_field_rule": cross_field_rule,
    "foreign_key_violation": foreign_key_violation,
}
