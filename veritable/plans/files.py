"""Many files of one shape, each judged by itself, from one read.

All files are read as one table.  The counted checks and rules become one grouped aggregate, keyed by the file a row
comes from, so the number of jobs does not grow with the number of files, and a file that holds a third of all rows is as
little trouble as any other: its counts combine in its own tasks.  If the read fails, each half of the files is read by
itself, down to the files that cannot be read; those are reported and all others stand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.operators.checks import ROWS, Check, Target, chunked, count_exprs, report
from veritable.operators.quality import GATE_FAIL_ON, GATE_RATIO
from veritable.operators.rules import Rule, rule_checks
from veritable.plans.scan import COUNTED, ScanConfig
from veritable.sources.readers import expand_paths, list_files, read_table

FILE = "file_path"


@dataclass
class FileScan:
    """``summary`` has a row a file, ``candidates`` a row for each finding in a file."""

    summary: DataFrame
    candidates: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def _name(path: Column) -> Column:
    """A file's path written one way, whether listed or told by the reader."""
    plain = F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def _listed(spark: SparkSession, paths: str | Sequence[str]) -> tuple[list[str], dict[str, str]]:
    found, errors = [], {}
    for path in expand_paths(paths):
        try:
            matches = list_files(spark, path)
        except Exception as exc:
            errors[path] = _told(exc)
            continue
        if not matches:
            errors[path] = "no such file"
        found += matches
    return list(dict.fromkeys(found)), errors


def _told(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"[:500]


def _read_apart(files: Sequence[str], run: Callable[[list[str]], DataFrame]) -> tuple[list[DataFrame], dict[str, str]]:
    """``run`` on all files; where that fails on each half, down to single files and their errors."""
    if not files:
        return [], {}
    try:
        return [run(list(files))], {}
    except Exception as exc:
        if len(files) == 1:
            return [], {files[0]: _told(exc)}
        middle = len(files) // 2
        left, faults = _read_apart(files[:middle], run)
        right, more = _read_apart(files[middle:], run)
        return left + right, faults | more


def scan_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    config: ScanConfig | None = None,
    *,
    fmt: str = "parquet",
    fail_on: Sequence[str] = GATE_FAIL_ON,
    max_ratio: float = GATE_RATIO,
    **options,
) -> FileScan:
    """Counted detectors and rules of each file, with a gate for each: findings of a ``fail_on`` severity fail a file when
    one of them touches more than ``max_ratio`` of its rows.

    ``paths`` are files or patterns; ``options`` go to the reader (a ``schema``, where files do not tell it).
    """
    config = config or ScanConfig()
    files, errors = _listed(spark, paths)
    held: list[DataFrame] = []

    def run(some: list[str]) -> DataFrame:
        df = read_table(spark, some, fmt, **options)
        checks = [c for d, build in COUNTED.items() if config.detectors is None or d in config.detectors for c in build(df, config)]
        checks += _rules(df, config.rules)
        tagged = df.withColumn(FILE, _name(F.col("_metadata.file_path")))
        counts = [tagged.groupBy(FILE).agg(F.count(F.lit(1)).alias(ROWS), *count_exprs(group)) for group in chunked(checks) or [[]]]
        # A few numbers a file, counted once and used twice.
        counts = [c.persist(StorageLevel.MEMORY_AND_DISK) for c in counts]
        held.extend(counts)
        parts = [report(Target(df), c, group, keys=(FILE, ROWS)) for c, group in zip(counts, chunked(checks))]
        # A file without findings is known by its rows.
        sizes = counts[0].select(FILE, ROWS)
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, sizes])
        found = found.persist(StorageLevel.MEMORY_AND_DISK)
        found.count()
        held.append(found)
        return found

    parts, faults = _read_apart(files, run)
    errors |= faults
    told = spark.createDataFrame(
        [(f, errors.get(f)) for f in [*files, *(e for e in errors if e not in files)]], f"{FILE} string, error string"
    ).withColumn(FILE, _name(F.col(FILE)))
    if parts:
        everything = reduce(DataFrame.unionByName, parts)
    else:
        everything = spark.createDataFrame([], f"{FILE} string, {ROWS} bigint, severity string, affected_count bigint, detector_id string")
    found = everything.filter(F.col("detector_id").isNotNull())
    severe = F.col("severity").isin(*fail_on) & (F.col("affected_count") / F.col(ROWS) > max_ratio)
    per_file = everything.groupBy(FILE).agg(F.max(ROWS).alias(ROWS), F.count("detector_id").alias("findings"), F.count_if(severe).alias("failing"))
    summary = told.join(per_file, FILE, "left").select(
        FILE,
        F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"),
        "error",
        F.when(F.col("error").isNull(), F.coalesce(ROWS, F.lit(0))).alias("row_count"),
        F.when(F.col("error").isNull(), F.coalesce("findings", F.lit(0))).alias("findings"),
        (F.col("error").isNull() & (F.coalesce("failing", F.lit(0)) == 0)).alias("passed"),
    )
    return FileScan(summary, found.drop(ROWS), held)


def _rules(df: DataFrame, rules: Sequence[Rule]) -> list[Check]:
    checks, broken = rule_checks(df, rules)
    if broken:
        raise ValueError("; ".join(f"{k}: {v}" for k, v in broken.items()))
    return checks
