"""Counted checks: many row predicates answered by one aggregate.

A check is a row predicate plus what to report when enough rows satisfy it.
``measure`` turns any number of checks into one aggregate over the table and
``report`` turns that one-row result into candidate rows.  Both are plain
DataFrames, so a check costs one ``count_if`` in a shared scan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.schema import CANDIDATE

VERSION = "1.0.0"
ROWS = "rows"
# Aggregates per job: keeps generated methods small enough to be compiled.
MAX_EXPRESSIONS = 400


@dataclass(frozen=True)
class Target:
    """The table being examined and the names stamped on its candidates."""

    df: DataFrame
    dataset_id: str = "dataset"
    table_name: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession


def target(df: DataFrame | Target) -> Target:
    return df if isinstance(df, Target) else Target(df)


@dataclass(frozen=True)
class Check:
    """One counted predicate and what makes its count worth reporting.

    The ratio is taken over ``base`` rows (all rows when None).  A check is kept when
    its count reaches ``min_count``, and its ratio exceeds ``over`` and reaches
    ``at_least``.  ``ladder`` raises the severity above further ratios.
    """

    detector_id: str
    columns: tuple[str, ...]
    hit: Column
    confidence: float
    severity: str
    fpr: float = 0.1
    min_count: int = 1
    over: float = -1.0
    at_least: float = 0.0
    base: int | None = None
    score_ratio: bool = False
    ladder: tuple[tuple[float, str], ...] = ()
    evidence: Mapping[str, object] = field(default_factory=dict)
    evidence_type: str = "pattern_match"
    issue_type: str | None = None
    version: str = VERSION


_CHECK_ROW = (
    "pos int, issue_type string, detector_id string, version string, columns array<string>, "
    "confidence double, fpr double, min_count bigint, over double, at_least double, base double, "
    "score_ratio boolean, severity string, ladder array<struct<over:double,severity:string>>, "
    "evidence string"
)


def _check_row(pos: int, c: Check) -> tuple:
    """A check's constants as a row; its evidence as JSON up to the closing brace."""
    told = json.dumps({"type": c.evidence_type, **c.evidence}, ensure_ascii=False)[:-1]
    return (
        pos,
        c.issue_type or c.detector_id,
        c.detector_id,
        c.version,
        list(c.columns),
        c.confidence,
        c.fpr,
        c.min_count,
        c.over,
        c.at_least,
        None if c.base is None else float(c.base),
        c.score_ratio,
        c.severity,
        sorted(c.ladder),
        told,
    )


def count_exprs(checks: Sequence[Check], prefix: str = "hit") -> list[Column]:
    return [F.count_if(c.hit).alias(f"{prefix}{i}") for i, c in enumerate(checks)]


def measure(df: DataFrame, checks: Sequence[Check], extra: Sequence[Column] = ()) -> DataFrame:
    """One row: the row count, ``extra`` aggregates, and one count per check."""
    return df.agg(F.count(F.lit(1)).alias(ROWS), *extra, *count_exprs(checks))


def evidence_json(kind: str, values: Mapping[str, object]) -> Column:
    """Evidence as JSON text, since its shape differs from detector to detector."""
    fields = [F.lit(kind).alias("type")]
    for name, value in values.items():
        fields.append((value if isinstance(value, Column) else F.lit(value)).alias(name))
    return F.to_json(F.struct(*fields))


def candidate(
    at: Target,
    *,
    issue_type: Column | str,
    detector_id: Column | str,
    columns: Column,
    affected: Column,
    raw: Column,
    confidence: Column | float,
    fpr: Column | float,
    severity: Column | str,
    evidence: Column,
    affected_rows: Column | None = None,
    version: Column | str = VERSION,
) -> list[Column]:
    """The canonical candidate columns, cast to the published schema."""

    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    rows = affected_rows if affected_rows is not None else F.lit(None)
    values = {
        "issue_type": lit(issue_type),
        "detector_id": lit(detector_id),
        "detector_version": lit(version),
        "dataset_id": F.lit(at.dataset_id),
        "table_name": F.lit(at.table_name),
        "columns": columns,
        "affected_count": affected,
        "affected_rows": rows,
        "raw_score": raw,
        "confidence": lit(confidence),
        "fpr": lit(fpr),
        "severity": lit(severity),
        "evidence": evidence,
    }
    return [values[f.name].cast(f.dataType).alias(f.name) for f in CANDIDATE.fields]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANDIDATE)


def report(at: Target, measures: DataFrame, checks: Sequence[Check], keys: Sequence[str] = ()) -> DataFrame:
    """Candidates for the checks whose counts pass their own limits.

    The counts become rows and meet the checks' constants in a join of that many
    rows, so the plan stays the same size however many checks there are.  ``measures`` may have several rows, told
    apart by ``keys``, which the candidates then carry.
    """
    if not checks:
        return empty(at.spark)
    told = at.spark.createDataFrame([_check_row(i, c) for i, c in enumerate(checks)], _CHECK_ROW)
    hits = F.array(*[F.col(f"hit{i}") for i in range(len(checks))])
    counted = measures.select(*dict.fromkeys([*keys, ROWS]), F.posexplode(hits).alias("pos", "n"))
    ratio = F.when(F.col("base") > 0, F.col("n") / F.col("base"))
    passed = F.filter("ladder", lambda step: F.col("ratio") > step["over"])
    json_end = F.concat(
        "evidence",
        F.lit(', "count": '),
        F.col("n").cast("string"),
        F.lit(', "ratio": '),
        F.round("ratio", 6).cast("string"),
        F.lit("}"),
    )
    return (
        counted.join(F.broadcast(told), "pos")
        .withColumn("base", F.coalesce("base", ROWS))
        .withColumn("ratio", ratio)
        .filter(
            (F.col(ROWS) > 0)
            & (F.col("n") >= F.col("min_count"))
            & (F.col("ratio") > F.col("over"))
            & (F.col("ratio") >= F.col("at_least"))
        )
        .select(
            *keys,
            *candidate(
                at,
                issue_type=F.col("issue_type"),
                detector_id=F.col("detector_id"),
                columns=F.col("columns"),
                affected=F.col("n"),
                raw=F.when(F.col("score_ratio"), F.col("ratio")).otherwise(F.col("n")),
                confidence=F.col("confidence"),
                fpr=F.col("fpr"),
                severity=F.coalesce(F.try_element_at(passed, F.lit(-1))["severity"], "severity"),
                evidence=json_end,
                version=F.col("version"),
            )
        )
    )


def chunked(checks: Sequence[Check], size: int = MAX_EXPRESSIONS) -> list[list[Check]]:
    """Split by column so that each aggregate reads few columns."""
    ordered = sorted(checks, key=lambda c: c.columns)
    return [ordered[i : i + size] for i in range(0, len(ordered), size)]


def run_checks(df: DataFrame | Target, checks: Sequence[Check]) -> DataFrame:
    """Lazy candidates for ``checks``: one aggregate per ``MAX_EXPRESSIONS`` of them."""
    at = target(df)
    if not checks:
        return empty(at.spark)
    parts = [report(at, measure(at.df, group), group) for group in chunked(checks)]
    return reduce(DataFrame.unionByName, parts)


def one_row(df: DataFrame) -> dict:
    """The single row of a global aggregate (its size depends on the schema only)."""
    return df.first().asDict()


def null_counts(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Row count and NULLs per column."""
    from veritable.functions.columns import col

    row = one_row(
        df.agg(
            F.count(F.lit(1)).alias(ROWS),
            *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
        )
    )
    return row[ROWS], {c: row[f"n{i}"] for i, c in enumerate(cols)}
