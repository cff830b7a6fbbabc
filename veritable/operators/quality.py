"""Quality score, gates and issue lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.operators.fusion import lookup, severity_rank, severity_weight
from veritable.schema import DIMENSION_FOLD, DIMENSION_WEIGHT, SEVERITIES

# ---- fixed values -----------------------------------------------------------
WORST_IMPACT = 1.6
TOP_FINDINGS = 5
GATE_FAIL_ON, GATE_RATIO = ("critical",), 0.01
SORT_KEYS = ("priority", "severity", "affected", "title")
# ---- end of fixed values ----------------------------------------------------


def canonical_dimension(dimension: Column) -> Column:
    return lookup(dimension, DIMENSION_FOLD, dimension)


def quality(
    issues: DataFrame,
    ran: Sequence[str] | None = None,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per dimension, with its score (NULL if nothing examined it), its
    weight among the scored ones, the number of issues, and the overall score.

    ``ran`` names the dimensions some detector examined; NULL means all of them.
    """
    weights = dict(weights or DIMENSION_WEIGHT)
    if any(w < 0 for w in weights.values()):
        raise ValueError("dimension weights must not be negative")
    ran = {DIMENSION_FOLD.get(d, d) for d in ran} if ran is not None else set(weights)
    total = sum(w for d, w in weights.items() if d in ran)
    rows = [
        (i, d, float(w), d in ran, float(w) / total if d in ran and total else None)
        for i, (d, w) in enumerate(weights.items())
    ]
    dims = issues.sparkSession.createDataFrame(
        rows, "ordinal int, dimension string, configured double, ran boolean, weight double"
    )
    impact = F.col("confidence") * severity_weight(F.col("severity")) * F.col("affected_ratio")
    hits = (
        issues.select(
            "issue_id",
            impact.alias("impact"),
            F.explode(
                F.array_distinct(F.transform("quality_dimensions", canonical_dimension))
            ).alias("dimension"),
        )
        .groupBy("dimension")
        .agg(
            F.count(F.lit(1)).alias("issues"),
            F.sum("impact").alias("impact"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("issue_id", "impact")))).alias(
                "contributions"
            ),
        )
    )
    raw = 100 * (1 - F.col("impact") / (F.col("issues") * WORST_IMPACT))
    bounded = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)
    scored = dims.join(hits, "dimension", "left").withColumn(
        "score", F.when(F.col("ran"), F.coalesce(bounded, F.lit(100.0)))
    )
    # One row per configured dimension, so this window is six rows.
    everything = Window.partitionBy()
    overall = F.round(F.sum(F.col("weight") * F.col("score")).over(everything), 1)
    return scored.select(
        "dimension",
        "score",
        F.round("weight", 6).alias("weight"),
        F.coalesce("issues", F.lit(0)).alias("issues"),
        F.coalesce("impact", F.lit(0.0)).alias("impact"),
        "contributions",
        overall.alias("overall"),
        "ordinal",
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per severity, zeros included."""
    levels = issues.sparkSession.createDataFrame(
        [(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int"
    )
    counts = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))
    return levels.join(F.broadcast(counts), "severity", "left").select(
        "severity", "rank", F.coalesce("issues", F.lit(0)).alias("issues")
    )


def gate(
    issues: DataFrame,
    fail_on: Sequence[str] = GATE_FAIL_ON,
    max_ratio: float = GATE_RATIO,
    max_issues: Mapping[str, int] | None = None,
    require_repair: bool = False,
    repaired: bool = False,
) -> DataFrame:
    """One row: ``passed``, the ids of the failing issues and the reasons.

    Issues at a ``fail_on`` severity fail when the worst of them touches more than
    ``max_ratio`` of the rows; ``max_issues`` limits the number per severity.
    ``require_repair`` lets a failing gate pass only with evidence of a repair.
    """
    severe = F.col("severity").isin(*fail_on) if fail_on else F.lit(False)
    limits = dict(max_issues or {})
    worst = F.max(F.when(severe, F.col("affected_ratio")))
    aggs = [
        worst.alias("worst"),
        F.count_if(severe).alias("severe"),
        F.sort_array(F.collect_list(F.when(severe, F.col("issue_id")))).alias("severe_ids"),
    ]
    for i, s in enumerate(limits):
        hit = F.col("severity") == s
        aggs.append(F.count_if(hit).alias(f"n{i}"))
        aggs.append(F.sort_array(F.collect_list(F.when(hit, F.col("issue_id")))).alias(f"ids{i}"))
    tripped = F.coalesce(F.col("worst") > max_ratio, F.lit(False))
    none = F.array().cast("array<string>")
    ids = [F.when(tripped, F.col("severe_ids")).otherwise(none)]
    reasons = [
        F.when(
            tripped,
            F.concat(
                F.col("severe").cast("string"),
                F.lit(f" issues at {', '.join(fail_on)} severity exceed row ratio {max_ratio}"),
            ),
        )
    ]
    for i, (s, limit) in enumerate(limits.items()):
        over = F.col(f"n{i}") > limit
        ids.append(F.when(over, F.col(f"ids{i}")).otherwise(none))
        text = F.concat(F.col(f"n{i}").cast("string"), F.lit(f" {s} issues exceed the limit {limit}"))
        reasons.append(F.when(over, text))
    failed = F.array_distinct(F.concat(*ids))
    failing = F.size("failed_issues") > 0
    if require_repair:
        note = "overridden by repair evidence" if repaired else "no applied repair found"
        reasons.append(F.when(F.size(failed) > 0, F.lit(note)))
    return (
        issues.agg(*aggs)
        .select(failed.alias("failed_issues"), F.array_compact(F.array(*reasons)).alias("reasons"))
        .select(
            (~failing | F.lit(require_repair and repaired)).alias("passed"),
            F.size("failed_issues").alias("failed_count"),
            "failed_issues",
            "reasons",
        )
    )


def score_gate(scan_runs: DataFrame, minimum: float) -> DataFrame:
    """A run passes when its overall score reaches ``minimum``."""
    return scan_runs.withColumn("quality_min", F.lit(float(minimum))).withColumn(
        "passed", F.coalesce(F.col("overall") >= minimum, F.lit(False))
    )


def top_findings(issues: DataFrame, k: int = TOP_FINDINGS) -> DataFrame:
    """The most severe issues, then by priority."""
    return issues.orderBy(
        severity_rank(F.col("severity")).desc(), F.desc("priority_score"), "issue_id"
    ).limit(k)


def sort_issues(issues: DataFrame, key: str = "priority", reverse: bool = True) -> DataFrame:
    """Order by priority, severity, affected rows or title."""
    if key not in SORT_KEYS:
        raise ValueError(f"unsupported sort key: {key}")
    by = {
        "priority": F.col("priority_score"),
        # Ranked with the most severe first, as in ``top_findings``.
        "severity": -severity_rank(F.col("severity")),
        "affected": F.col("affected_count"),
        "title": F.col("title"),
    }[key]
    return issues.orderBy(by.desc() if reverse else by.asc(), "issue_id")


def filter_issues(
    issues: DataFrame,
    severity: str | None = None,
    dimension: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """exact severity, contained dimension, text in title, columns or detectors."""
    keep = F.lit(True)
    if severity:
        keep &= F.col("severity") == severity
    if dimension:
        keep &= F.array_contains("quality_dimensions", dimension)
    needle = (search or "").strip().lower()
    if needle:
        text = F.concat_ws(" ", "title", "columns", "detector_ids")
        keep &= F.lower(text).contains(needle)
    return issues.filter(keep)


def severity_floor(issues: DataFrame, floor: str) -> DataFrame:
    """issues at least as severe as ``floor``."""
    return issues.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(floor))


def quality_summary(scored: DataFrame) -> DataFrame:
    """The overall score with the dimension scores as a map, for the run record."""
    return scored.agg(
        F.max("overall").alias("overall"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "score")))).alias(
            "dimensions"
        ),
    )

