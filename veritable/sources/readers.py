"""Table sources (S01-S06): thin, declarative uses of Spark's readers."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ---- fixed values: formats --------------------------------------------------
SUFFIXES = {
    ".csv": "csv",
    ".tsv": "csv",
    ".parquet": "parquet",
    ".pq": "parquet",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
}
DELIMITERS = (",", ";", "\t", "|")
REMOTE_SCHEMES = {"s3": "s3a", "gs": "gs", "az": "abfs"}
DATABASES = {"postgresql": "public", "mysql": None}
# ---- end of fixed values ----------------------------------------------------


def format_of(path: str) -> str:
    suffix = posixpath.splitext(path.split("?")[0].rstrip("/").lower())[1]
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type: {path}")
    return SUFFIXES[suffix]


def resolve_uri(path: str) -> str:
    """Object-store addresses in the scheme Spark's file systems use."""
    scheme, sep, rest = path.partition("://")
    return f"{REMOTE_SCHEMES.get(scheme, scheme)}://{rest}" if sep else path


def _uris(path: str | Sequence[str]) -> list[str]:
    return [resolve_uri(p) for p in ([path] if isinstance(path, str) else path)]


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str | None = None,
    schema: StructType | str | None = None,
    encoding: str = "UTF-8",
    **options,
) -> DataFrame:
    """Header row, quotes, empty fields NULL.  Give ``schema`` for large inputs:
    inferring it reads the files once more."""
    sep = sep or ("\t" if _uris(path)[0].lower().endswith(".tsv") else ",")
    if sep not in DELIMITERS:
        raise ValueError(f"unsupported delimiter: {sep!r}")
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"')
    reader = reader.option("escape", '"').option("encoding", encoding).option("multiLine", False)
    for k, v in options.items():
        reader = reader.option(k, v)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(_uris(path))


def read_parquet(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """S02."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*_uris(path))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """One JSON document per line."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(_uris(path))


def read_jdbc(
    spark: SparkSession,
    kind: str,
    url: str,
    table: str,
    *,
    schema: str | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    **options,
) -> DataFrame:
    """A database table, read in parallel ranges of ``partition_column``."""
    if kind not in DATABASES:
        raise ValueError(f"unsupported database: {kind}")
    if not table:
        raise ValueError("a table name is required")
    schema = schema or DATABASES[kind]
    name = f"{schema}.{table}" if schema else table
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition_column:
        low, high = bounds
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", low)
            .option("upperBound", high)
            .option("numPartitions", partitions)
        )
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None, **options) -> DataFrame:
    """Any supported file source by suffix, or by ``fmt`` for folders without one; several files of one shape as one."""
    fmt = fmt or format_of(path if isinstance(path, str) else path[0])
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt == "jsonl":
        return read_jsonl(spark, path, **options)
    if fmt == "parquet":
        return read_parquet(spark, path, **options)
    raise ValueError(f"unsupported format: {fmt}")


def expand_paths(paths: str | Sequence[str]) -> list[str]:
    """A comma, semicolon or newline separated list without repetitions, in order."""
    listed = re.split(r"[,;\n]", paths) if isinstance(paths, str) else list(paths)
    return list(dict.fromkeys(p.strip() for p in listed if p.strip()))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob, as Spark's file source lists them."""
    listed = spark.read.format("binaryFile").load(resolve_uri(pattern)).select("path")
    return sorted(r["path"] for r in listed.collect())


def read_many(spark: SparkSession, paths: str | Sequence[str], **options) -> dict:
    """Each path as its own table; a failing path maps to its error."""
    found: dict[str, DataFrame | Exception] = {}
    for path in expand_paths(paths):
        try:
            globbed = any(ch in path for ch in "*?[")
            matches = list_files(spark, path) if globbed else [path]
        except Exception as exc:
            found[path] = exc
            continue
        for match in matches:
            try:
                found[match] = read_table(spark, match, **options)
            except Exception as exc:
                found[match] = exc
    return found


def union_with_source(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables of one shape as one, each row with its ``source_path``."""
    out = None
    for path, df in tables.items():
        part = df.withColumn("source_path", F.lit(path))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out
