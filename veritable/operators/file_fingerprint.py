"""Content fingerprints kept per file, so that an unchanged file is not read again.

The content fingerprint of a table is made of sums over its rows, so it is also the sum of the sums of its files.  Each file
is a leaf: where it lies, its size and time of change, and its own sums.  A leaf whose file still has that size and time is
taken over; all other files are read, in one job grouped by file, with the unchanged ones pruned from the scan by their path.

What grows with the table on the driver is a path for each file that changed since the last leaves, beside Spark's own index
of all files.  The first time nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.operators.checks import one_row
from veritable.operators.fingerprint import fingerprint_of, row_lanes, schema_hash
from veritable.sources.readers import expand_paths, read_table, resolve_uri

FILE = "file_path"
LEAVES = (
    f"{FILE} string, size bigint, modified timestamp, taken timestamp, signature string, "
    "rows bigint, lane_a decimal(38,0), lane_b decimal(38,0), reused boolean"
)
#: A file changed this shortly before its leaf was taken may change again within the same tick of the clock.
SETTLE_SECONDS = 2.0


def file_states(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file_path, size, modified, taken)`` of all files, from their listing; no content is read."""
    listed = spark.read.format("binaryFile").load([resolve_uri(p) for p in expand_paths(paths)])
    meta = listed.metadataColumn("_metadata")
    return listed.select(
        meta["file_path"].alias(FILE),
        meta["file_size"].alias("size"),
        meta["file_modification_time"].alias("modified"),
        F.current_timestamp().alias("taken"),
    )


def file_leaves(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str | None = None,
    previous: DataFrame | None = None,
    settle_seconds: float = SETTLE_SECONDS,
    **options,
) -> DataFrame:
    """One leaf per file (``LEAVES``); those of ``previous`` whose file is unchanged are taken over (``reused``).

    A leaf is taken over when path, size, time of change and the table's schema are the same, and its file had
    been left alone for ``settle_seconds`` when the leaf was taken.  A file without rows has a leaf of zeros; an empty
    folder has no leaves.  ``options`` go to the reader.
    """
    states = file_states(spark, paths)
    df = read_table(spark, expand_paths(paths), fmt, **options)
    signature = schema_hash(df)
    known = None
    if previous is not None:
        settled = F.col("modified").cast("double") + F.lit(float(settle_seconds)) <= F.col("taken").cast("double")
        known = previous.filter((F.col("signature") == signature) & settled)
        fresh = states.join(known.select(FILE, "size", "modified"), [FILE, "size", "modified"], "left_anti")
        changed = [r[FILE] for r in fresh.select(FILE).collect()]
        kept = known.drop("taken", "reused").join(states, [FILE, "size", "modified"]).withColumn("reused", F.lit(True))
        kept = kept.select(*_names())
        if not changed:
            return kept
        df = df.filter(df.metadataColumn("_metadata")[FILE].isin(changed))
        # The same list as above, so that a file listed later is neither a leaf without rows nor read for nothing.
        states = states.filter(F.col(FILE).isin(changed))
    rows = df.select(df.metadataColumn("_metadata")[FILE].alias("__file"), *row_lanes(df))
    sums = rows.groupBy("__file").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("lane_a", "lane_b")]
    )
    none = F.lit(0).cast("decimal(38,0)")
    read = states.join(sums, F.col(FILE) == F.col("__file"), "left").select(
        FILE,
        "size",
        "modified",
        "taken",
        F.lit(signature).alias("signature"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("lane_a", none).cast("decimal(38,0)").alias("lane_a"),
        F.coalesce("lane_b", none).cast("decimal(38,0)").alias("lane_b"),
        F.lit(False).alias("reused"),
    )
    return read if known is None else read.unionByName(kept)


def _names() -> list[str]:
    return [part.split()[0] for part in LEAVES.split(", ")]


def folded(df: DataFrame, leaves: DataFrame) -> tuple[int, str]:
    """Row count and content fingerprint of the table ``df`` from its leaves: the fingerprint that reading all of it gives."""
    sums = leaves.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").cast("string").alias(c) for c in ("lane_a", "lane_b")],
    )
    row = one_row(sums)
    return row["rows"], fingerprint_of(df, row)


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each file: added, removed, changed, touched (a new time, the same rows) or same."""
    sides = [
        leaves.select(FILE, *[F.col(c).alias(f"{side}_{c}") for c in ("modified", "rows", "lane_a", "lane_b", "signature")])
        for leaves, side in ((before, "old"), (after, "new"))
    ]
    both = sides[0].join(sides[1], FILE, "full_outer")
    equal = reduce(
        lambda a, b: a & b, [F.col(f"old_{c}") == F.col(f"new_{c}") for c in ("rows", "lane_a", "lane_b", "signature")]
    )
    change = (
        F.when(F.col("old_rows").isNull(), "added")
        .when(F.col("new_rows").isNull(), "removed")
        .when(~equal, "changed")
        .when(F.col("old_modified") != F.col("new_modified"), "touched")
        .otherwise("same")
    )
    return both.select(FILE, change.alias("change"), F.col("old_rows").alias("rows_before"), F.col("new_rows").alias("rows_after"))
