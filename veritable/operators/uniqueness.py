"""Duplicate detectors (D07, D08), on the shared frequency table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions import predicates as P
from veritable.functions.columns import string_columns
from veritable.operators.checks import Target, candidate, empty, evidence_json, target
from veritable.operators.frequency import column_totals, text_values, top_per_column, value_counts

# ---- fixed values: thresholds ----------------------------------------------
EXAMPLES = 10
FUZZY_MIN_LENGTH, FUZZY_SAMPLES = 2, 3
# ---- end of fixed values ----------------------------------------------------

#: Bytes of a key that order the examples.
KEY_START = 64


def uniqueness_violation(df: DataFrame | Target, cols=None, freq=None) -> DataFrame:
    """Rows that repeat a value of their column; the evidence shows the most repeated values."""
    at = target(df)
    freq = freq if freq is not None else value_counts(at.df, cols)
    repeated = freq.filter("n > 1 and value is not null")
    top = top_per_column(repeated, EXAMPLES, F.desc("n"), F.asc("value"))
    examples = top.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("examples")
    )
    totals = column_totals(repeated).select(
        "column", F.col("redundant").alias("affected"), F.col("distinct").alias("values")
    )
    # One row per column on both sides.
    return totals.join(F.broadcast(examples), "column").select(
        *candidate(
            at,
            issue_type="uniqueness_violation",
            detector_id="uniqueness_violation",
            columns=F.array("column"),
            affected=F.col("affected"),
            raw=F.col("affected"),
            confidence=0.98,
            fpr=0.1,
            severity="medium",
            evidence=evidence_json(
                "duplicate_match",
                {
                    "values": F.col("values"),
                    "total_duplicates": F.col("affected"),
                    "examples": F.col("examples"),
                },
            ),
        )
    )


def _keyed(values: DataFrame, kept: bool = False) -> DataFrame:
    """128 bits of the key of each value and of the value itself, and where its key begins; ``kept``: the value, too.

    Values whose key is too short are left out.  The key is that of ``predicates.fuzzy_key``, which in the JVM takes
    several times as long for long texts.
    """
    schema = f"column string, {'value binary' if kept else 'n bigint'}, key binary, spelling binary, start binary"
    carried = "value" if kept else "n"

    def keyed(batches):
        import hashlib
        import re

        import pyarrow as pa

        low = bytes(range(256)).lower()
        drop = bytes(b for b in range(128) if not chr(b).isalnum())
        # Letters, digits, and the UTF-8 of U+4E00 to U+9FFF.
        runs = re.compile(rb"[0-9A-Za-z]+|(?:\xe4[\xb8-\xbf][\x80-\xbf]|[\xe5-\xe9][\x80-\xbf]{2})+").findall

        def digest(b: bytes) -> bytes:
            return hashlib.blake2b(b, digest_size=16).digest()

        for batch in batches:
            found = []
            at = []
            for i, v in enumerate(batch.column("value").to_pylist()):
                key = v.translate(low, drop) if v.isascii() else b"".join(runs(v)).lower()
                # A single letter of the others has three bytes.
                if len(key) >= (FUZZY_MIN_LENGTH if key[:1].isascii() else 4):
                    found.append((digest(key), digest(v), key[:KEY_START]))
                    at.append(i)
            told = batch.take(pa.array(at, pa.int64()))
            parts = [pa.array([f[k] for f in found], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([told.column("column"), told.column(carried), *parts], ["column", carried, "key", "spelling", "start"])

    return values.select("column", F.col("value").cast("binary").alias("value"), "n").mapInArrow(keyed, schema)


def fuzzy_duplicate(df: DataFrame | Target, cols=None, freq=None) -> DataFrame:
    """Values equal once case, blanks and punctuation are ignored.

    Keys and values are compared by 128 bits of each; texts are read again only for the examples, and shuffled only if
    they are some.
    """
    at = target(df)
    names = string_columns(at.df, cols)
    if not names:
        return empty(at.spark)
    known = freq.filter(F.col("column").isin(names) & F.col("value").isNotNull()) if freq is not None else text_values(at.df, names)
    spellings = _keyed(known).groupBy("column", "key", "spelling", "start").agg(F.sum("n").alias("n"))
    groups = spellings.groupBy("column", "key", "start").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("spellings"))
    groups = groups.filter("rows >= 2 and spellings >= 2")
    totals = groups.groupBy("column").agg(
        F.sum(F.col("rows") - 1).alias("affected"), F.count(F.lit(1)).alias("groups")
    )
    # EXAMPLES groups per column, and those that tie with the last of them in their rows and the first letters of their keys.
    ranked = Window.partitionBy("column").orderBy(F.desc("rows"), F.asc("start"))
    first = groups.withColumn("rank", F.rank().over(ranked)).filter(F.col("rank") <= EXAMPLES)
    first = first.select("column", F.col("key").alias("digest"), "rows", "spellings")
    written = _keyed(known, kept=True).select("column", F.col("key").alias("digest"), "value")
    texts = written.join(F.broadcast(first), ["column", "digest"]).withColumn("value", F.col("value").cast("string"))
    samples = top_per_column(texts.distinct(), FUZZY_SAMPLES, F.asc("value"), by=("column", "digest"))
    detail = samples.groupBy("column", "digest", "rows", "spellings").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    detail = detail.withColumn("key", P.fuzzy_key(F.get("samples", F.lit(0))))
    detail = top_per_column(detail, EXAMPLES, F.desc("rows"), F.asc("key"))
    shown = detail.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "key", "rows", "spellings", "samples"))).alias("examples")
    )
    # One row per column on both sides.
    return (
        totals.join(F.broadcast(shown), "column")
        .select(
            *candidate(
                at,
                issue_type="fuzzy_duplicate",
                detector_id="fuzzy_duplicate",
                columns=F.array("column"),
                affected=F.col("affected"),
                raw=F.col("affected"),
                confidence=0.9,
                fpr=0.15,
                severity="medium",
                evidence=evidence_json(
                    "duplicate_match",
                    {"group_count": F.col("groups"), "groups": F.col("examples")},
                ),
            )
        )
    )


DETECTORS = {
    "uniqueness_violation": uniqueness_violation,
    "fuzzy_duplicate": fuzzy_duplicate,
}
