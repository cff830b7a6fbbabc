"""Session helpers: a tuned local session for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "veritable", cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session with the settings this library is tested under.

    On a cluster, submit with your own session: nothing here is required.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        # A scan compiles a few hundred expressions; keep them for the next one.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Local mode runs everything in the driver's heap.
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Column expressions are built many at a time; skip a call-site capture for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a session that names none (a local test) gets a temporary one, which is
    then recorded on the session so later calls agree.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


SMALL_BYTES = 1 << 30


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size; very large where it knows nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, cache: bool | None = None) -> tuple[DataFrame, bool]:
    """``df`` ready for several passes, and whether it is now held in memory.

    A small input (up to ``SMALL_BYTES``) is cut finer and kept: its few file splits would leave
    most cores idle in every pass.  Any other is read from its source each time, unless ``cache``
    says otherwise; it is never shuffled.
    """
    from veritable.functions.columns import col, flat_columns

    if cache is False:
        return df, False
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = estimated_bytes(df) <= SMALL_BYTES and df.rdd.getNumPartitions() < cores
    if cache is None and not small:
        return df, False
    if not small:
        if df.storageLevel.useMemory or df.storageLevel.useDisk:
            return df, False  # the caller's own, which is not for us to free
        return df.persist(StorageLevel.MEMORY_AND_DISK), True
    # By value rather than round robin, which would sort the rows first.
    by = [col(c) for c in flat_columns(df)]
    finer = df.repartition(cores, *by) if by else df.repartition(cores)
    return finer.persist(StorageLevel.MEMORY_AND_DISK), True
