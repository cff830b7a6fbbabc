"""Sinks for tables and scan results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The whole table in its source format, never over existing data."""
    writer = df.write.mode("errorifexists")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "jsonl":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def report_document(result) -> DataFrame:
    """Scan, detector runs, issues and quality as one JSON document in one row.

    A report lists issues, which are few per column whatever the size of the table.
    """

    def listed(df: DataFrame, name: str, *order: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct(*order, F.struct("*").alias("row"))))
        return df.agg(F.transform(rows, lambda r: r["row"]).alias(name))

    parts = result.scan_run.select(F.struct("*").alias("scan"), F.lit(1).alias("k"))
    quality = result.quality.drop("contributions")
    for part in (
        listed(result.detector_runs, "detector_runs", "detector_id"),
        listed(result.issues, "issues", "issue_id"),
        listed(quality, "quality", "ordinal"),
    ):
        parts = parts.join(F.broadcast(part.withColumn("k", F.lit(1))), "k")
    header = F.struct(F.lit("veritable").alias("generator"), F.lit("1").alias("version"))
    return parts.select(
        F.to_json(
            F.struct(header.alias("header"), "scan", "detector_runs", "issues", "quality")
        ).alias("report")
    )


def write_result(result, path: str, fmt: str = "parquet") -> None:
    """The result tables side by side under ``path``."""
    base = path.rstrip("/")
    for name in ("scan_run", "detector_runs", "issues", "quality"):
        writer = getattr(result, name).write.mode("errorifexists")
        target = f"{base}/{name}"
        writer.parquet(target) if fmt == "parquet" else writer.json(target)
