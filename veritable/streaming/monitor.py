"""Streams (Z01, Z02): new files are scanned as they arrive.

The checkpoint remembers what was seen, so nothing polls fingerprints and nothing
is scanned twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from veritable.functions.columns import col
from veritable.operators.completeness import BUCKET_ROWS, MIN_GAP, MIN_RATIO
from veritable.operators.history import History
from veritable.plans.scan import ScanConfig, scan
from veritable.session import scratch_path


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    glob: str | None = None,
    fmt="parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A folder whose files, as they arrive, are the stream's batches."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def scan_stream(
    stream: DataFrame,
    history: History,
    dataset_id: str,
    config: ScanConfig | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Every micro-batch goes through the full scan and into the history.

    The run id names the batch.  A stored batch is recognised; one that failed half-way is stored
    again over what it left.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{dataset_id}-batch-{batch_id}"
        known = history.read("scan_runs")
        if known is not None and not known.filter(F.col("scan_run_id") == run_id).isEmpty():
            return
        if batch.isEmpty():
            return
        result = scan(batch, config, dataset_id=dataset_id, scan_run_id=run_id)
        try:
            history.save(result)
        finally:
            result.release()

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )


def _as_instant(c: Column) -> Column:
    """A time without zone as the instant it names in UTC (watermarks need an instant)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")


def _from_instant(c: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def null_rates(
    stream: DataFrame,
    time_column: str,
    cols: Sequence[str],
    baseline: dict[str, float],
    window: str = "1 day",
    lateness: str = "1 day",
) -> DataFrame:
    """NULL rate of each column per tumbling event-time window against a baseline.

    State is one counter per column and open window; rows later than ``lateness``
    are dropped by the watermark.
    """
    tallies = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]
    zoneless = isinstance(stream.schema[time_column].dataType, TimestampNTZType)
    moment = _as_instant(col(time_column)) if zoneless else col(time_column)

    def shown(c: Column) -> Column:
        return _from_instant(c) if zoneless else c

    counted = (
        stream.withColumn("__at", moment)
        .withWatermark("__at", lateness)
        .groupBy(F.window("__at", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"), *tallies)
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("nulls"),
            F.lit(float(baseline.get(c, 0.0))).alias("baseline"),
        )
        for i, c in enumerate(cols)
    ]
    ratio = F.col("nulls") / F.col("rows")
    limit = F.greatest(F.lit(MIN_RATIO), F.col("baseline") + MIN_GAP)
    return (
        counted.select("w", "rows", F.inline(F.array(*cells)))
        .select(
            shown(F.col("w.start")).alias("window_start"),
            shown(F.col("w.end")).alias("window_end"),
            "column",
            "rows",
            "nulls",
            ratio.alias("null_ratio"),
            "baseline",
            ((F.col("rows") >= BUCKET_ROWS) & (ratio >= limit)).alias("alert"),
        )
    )


#: So many tables of one level become one of the next.
FAN = 10


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a path, as its file system lists them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()) if fs.exists(where) else []


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _latest(written: DataFrame) -> DataFrame:
    """Each window's row of its latest batch."""
    values = F.struct(*[c for c in written.columns if c not in ("window_start", "column", "batch")])
    latest = written.groupBy("window_start", "column").agg(F.max_by(values, "batch").alias("v"), F.max("batch").alias("batch"))
    return latest.select("window_start", "column", "v.*", "batch")


class WindowTable:
    """Windows as updated by batches, in folders ``level-number``: level 0 has one for each batch.

    ``fan`` folders of a level are merged into one of the next, so ``n`` batches leave at most ``fan - 1`` folders on each
    of ``log(n)`` levels, and a window is rewritten once a level.  Rows keep their batch number and the latest of a window
    wins, so nothing depends on a merge having been finished: one that broke off leaves copies of rows that are still
    there, and folders are dropped only when what was made of them is complete.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.schema = StructType([*schema.fields, StructField("batch", LongType())])

    def _at(self, level: int, number: int) -> str:
        return f"{self.path}/{level}-{number:012d}"

    def levels(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for name in _folders(self.spark, self.path):
            level, number = name.split("-")
            found.setdefault(int(level), []).append(int(number))
        return found

    def store(self, batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        numbered.write.mode("overwrite").parquet(self._at(0, batch_id))
        self.merge()

    def merge(self) -> None:
        level = 0
        while len(numbers := self.levels().get(level, [])) >= self.fan:
            parts = [self._at(level, n) for n in numbers]
            merged = _latest(self.spark.read.schema(self.schema).parquet(*parts))
            merged.write.mode("overwrite").parquet(self._at(level + 1, max(numbers)))
            for part in parts:
                _drop(self.spark, part)
            level += 1

    def read(self) -> DataFrame:
        parts = [self._at(level, n) for level, numbers in self.levels().items() for n in numbers]
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("batch")
        return _latest(self.spark.read.schema(self.schema).parquet(*parts)).drop("batch")


def run_null_rates(
    rates: DataFrame, checkpoint: str | None = None, output: str | None = None, fan: int = FAN
) -> DataFrame:
    """Drain the available input and return the windows as a table.

    Each batch replaces the windows it updated: it is written under its own batch
    number and the latest state of a window wins, so a replayed batch changes nothing.
    Windows live beside the checkpoint (or in ``output``), so a restart goes on with them;
    older batches are merged, so what is read does not grow with their number.
    """
    spark = rates.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream")
    windows = WindowTable(spark, output or f"{checkpoint.rstrip('/')}-windows", rates.schema, fan)
    query = (
        rates.writeStream.outputMode("update")
        .foreachBatch(windows.store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return windows.read().select(*rates.columns)
