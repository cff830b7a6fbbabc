"""Fusing candidates into issues and scoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.schema import (
    CRITICALITY_WEIGHT,
    FAMILY_DIMENSION,
    FAMILY_OF,
    FAMILY_TITLE,
    PRIORITY_WEIGHT,
    SEVERITIES,
    SEVERITY_WEIGHT,
)

# ---- fixed values: thresholds ----------------------------------------------
SCOPE_FULL, AGREEMENT_FULL = 0.05, 3
CRITICALITY_BASE = 0.6
RISK_MEDIUM, RISK_HIGH = 0.3, 0.6
# ---- end of fixed values ----------------------------------------------------


def lookup(key: Column, table: dict, default: Column) -> Column:
    """A small fixed mapping applied as an expression, with no join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def family_table(spark: SparkSession) -> DataFrame:
    """The issue type, family and quality dimension of every detector."""
    rows = [(t, f, FAMILY_DIMENSION[f]) for t, f in FAMILY_OF.items()]
    return spark.createDataFrame(rows, "issue_type string, family string, dimension string")


def with_family(candidates: DataFrame) -> DataFrame:
    """Unknown types are their own family and count towards validity."""
    family = lookup(F.col("issue_type"), FAMILY_OF, F.col("issue_type"))
    return candidates.withColumn("family", family).withColumn(
        "dimension", lookup(F.col("family"), FAMILY_DIMENSION, F.lit("validity"))
    )


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}, F.lit(-1))


def severity_weight(severity: Column) -> Column:
    return lookup(severity, SEVERITY_WEIGHT, F.lit(0.0))


def noisy_or(confidences: Column) -> Column:
    """1 - product(1 - c) over an array; a certain signal (c = 1) makes the result certain."""
    rest = F.aggregate(confidences, F.lit(1.0), lambda acc, c: acc * (1 - c))
    return F.round(1 - rest, 6)


def fuse(candidates: DataFrame, scan_run_id: str, rows: int | None) -> DataFrame:
    """Candidates on the same columns and of the same family become one issue.

    The groups are small: one candidate per detector, plus one per reported time
    bucket or category for the two bucketed missingness detectors.  A candidate's share
    is taken over its own ``rows_examined`` where it has one, else over ``rows``.
    """
    whole = F.lit(float(rows) if rows else 0.0)
    own = F.col("rows_examined").cast("double") if "rows_examined" in candidates.columns else F.lit(None)
    examined = F.coalesce(own, whole)
    order = lookup(F.col("issue_type"), {t: i for i, t in enumerate(FAMILY_OF)}, F.lit(len(FAMILY_OF)))
    members = F.array_sort(
        F.collect_list(
            F.struct(
                order.alias("order"),
                "detector_id",
                "issue_type",
                "affected_count",
                "confidence",
                "detector_version",
                "evidence",
            )
        )
    )
    grouped = (
        with_family(candidates)
        .withColumn("columns", F.array_sort("columns"))
        .groupBy("dataset_id", "table_name", "columns", "family", "dimension")
        .agg(
            members.alias("members"),
            F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
            F.max("affected_count").alias("most"),
            F.max(F.when(examined > 0, F.col("affected_count") / examined)).alias("share"),
            F.max(examined).alias("examined"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("affected_rows")))).alias("ids"),
            F.max("fpr").alias("fpr"),
        )
    )
    has_ids = F.size("ids") > 0
    affected = F.when(has_ids, F.size("ids").cast("bigint")).otherwise(F.col("most"))
    share = F.when(has_ids, F.try_divide(F.col("affected_count").cast("double"), F.col("examined"))).otherwise(F.col("share"))
    ratio = F.round(F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))), 6)
    shown = F.concat_ws(", ", F.slice("columns", 1, 3))
    more = F.when(F.size("columns") > 3, "...").otherwise("")
    title = lookup(F.col("family"), FAMILY_TITLE, F.col("family"))
    part = lambda m: F.concat(
        F.lit("["),
        m["detector_id"],
        F.lit(" v"),
        m["detector_version"],
        F.lit("] "),
        m["issue_type"],
        F.lit(": "),
        m["affected_count"].cast("string"),
    )
    key = F.concat_ws("|", F.lit(scan_run_id), "dataset_id", "table_name", "family", F.to_json("columns"))
    return grouped.withColumn("affected_count", affected).select(
        F.concat(F.lit("iss_"), F.substring(F.sha2(key, 256), 1, 12)).alias("issue_id"),
        F.lit(scan_run_id).alias("scan_run_id"),
        F.col("family").alias("issue_type"),
        F.concat(title, F.lit(" in "), shown, more).alias("title"),
        F.concat_ws(" | ", F.transform("members", part)).alias("description"),
        "dataset_id",
        "table_name",
        "columns",
        F.array("dimension").alias("quality_dimensions"),
        "severity",
        noisy_or(F.col("members.confidence")).alias("confidence"),
        F.when(F.col("fpr") < RISK_MEDIUM, "low")
        .when(F.col("fpr") < RISK_HIGH, "medium")
        .otherwise("high")
        .alias("false_positive_risk"),
        "affected_count",
        ratio.alias("affected_ratio"),
        F.when(has_ids, F.col("ids")).alias("affected_row_ids"),
        F.col("members.detector_id").alias("detector_ids"),
        F.col("members.evidence").alias("evidence"),
    )


def score(
    issues: DataFrame,
    criticality: str | Column = "normal",
    reproducibility: float = 1.0,
    novelty: float = 1.0,
    repairability: float = 0.5,
) -> DataFrame:
    """Priority 0-100 and the parts it is made of."""
    level = F.lit(criticality) if isinstance(criticality, str) else criticality
    weight = lookup(level, CRITICALITY_WEIGHT, F.lit(1.0))
    part = {
        "severity": severity_weight(F.col("severity")),
        "confidence": F.col("confidence"),
        "affected_scope": F.least(F.lit(1.0), F.col("affected_ratio") / SCOPE_FULL),
        "criticality": F.round(weight - CRITICALITY_BASE, 6),
        "reproducibility": F.lit(float(reproducibility)),
        "agreement": F.least(F.lit(1.0), F.size("detector_ids") / AGREEMENT_FULL),
        "novelty": F.lit(float(novelty)),
        "repairability": F.lit(float(repairability)),
    }
    scaled = {k: v * PRIORITY_WEIGHT[k] for k, v in part.items()}
    total = sum(list(scaled.values())[1:], next(iter(scaled.values())))
    bounded = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2)
    return issues.withColumn("priority_score", bounded).withColumn(
        "score_breakdown", F.struct(*[v.alias(k) for k, v in scaled.items()])
    )
