"""Run history and comparison over time (H05-H16), on plain Parquet tables."""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritable.operators.file_fingerprint import SETTLE_SECONDS, file_leaves, folded
from veritable.operators.fingerprint import changed_since
from veritable.sources.readers import expand_paths, read_table

# ---- fixed values: thresholds ----------------------------------------------
ROW_DRIFT, SCORE_DRIFT = 0.20, 5.0
TREND_STEP = 0.5
# ---- end of fixed values ----------------------------------------------------

TABLES = ("scan_runs", "detector_runs", "issues", "profiles", "rule_results", "repair_proposals", "repair_runs", "file_leaves")


_REPAIR_FILES = ("rollback_artifact", "output_path", "restored_path", "fingerprint_before", "fingerprint_after")
_REPAIR_RUN = (
    "repair_id string, dataset_id string, status string, columns array<string>, operations array<string>, "
    "created_at timestamp, " + ", ".join(f"{c} string" for c in _REPAIR_FILES)
)


def _stamped(df: DataFrame, run_id: str, dataset_id: str) -> DataFrame:
    return df.withColumns(
        {"run_id": F.lit(run_id), "dataset_id": F.lit(dataset_id), "stored_at": F.lit(dt.datetime.now(dt.timezone.utc))}
    )


@dataclass(frozen=True)
class History:
    """Parquet tables under one folder, a subfolder for each run: storing a run again replaces it."""

    spark: SparkSession
    path: str

    def _at(self, table: str) -> str:
        return f"{self.path.rstrip('/')}/{table}"

    def store(self, table: str, df: DataFrame, run_id: str) -> None:
        folder = hashlib.sha256(run_id.encode()).hexdigest()[:24]
        df.write.mode("overwrite").parquet(f"{self._at(table)}/run-{folder}")

    def read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.option("recursiveFileLookup", "true").parquet(self._at(table))
        except Exception as exc:
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise

    def save(self, result, profile: DataFrame | None = None) -> None:
        """Store a scan: details first, so that a run is listed only when complete."""
        run_id = result.scan_run.first()["scan_run_id"]
        self.store("issues", result.issues, run_id)
        self.store("detector_runs", result.detector_runs, run_id)
        if profile is not None:
            self.store("profiles", profile.withColumn("scan_run_id", F.lit(run_id)), run_id)
        self.store("scan_runs", result.scan_run, run_id)

    def save_rules(self, run_id: str, dataset_id: str, results: DataFrame) -> None:
        """Store a rule pre-run (``rules.preflight`` or ``rules.approve``) under an id of its own."""
        self.store("rule_results", _stamped(results, run_id, dataset_id), run_id)

    def save_repair(self, repair_id: str, dataset_id: str, run: dict, repairs, proposals: DataFrame | None = None) -> None:
        """Store a repair run (``repair.write_repair`` or ``repair.rollback``) and what was proposed for it.

        Storing it again, as after a rollback, replaces it.
        """
        if proposals is not None:
            self.store("repair_proposals", _stamped(proposals, repair_id, dataset_id), repair_id)
        row = (
            repair_id,
            dataset_id,
            run["status"],
            sorted({c for r in repairs for c in r.columns}),
            list(dict.fromkeys(r.operation for r in repairs)),
            dt.datetime.now(dt.timezone.utc),
            *(run.get(k) for k in _REPAIR_FILES),
        )
        self.store("repair_runs", self.spark.createDataFrame([row], _REPAIR_RUN), repair_id)

    def leaves(self, dataset_id: str) -> tuple[DataFrame | None, int]:
        """The last stored file leaves of a dataset, and the number of their generation."""
        stored = self.read("file_leaves")
        if stored is None:
            return None, 0
        own = stored.filter(F.col("dataset_id") == dataset_id)
        last = own.agg(F.max("generation")).first()[0]
        if last is None:
            return None, 0
        return own.filter(F.col("generation") == last).drop("dataset_id", "generation"), last

    def save_leaves(self, dataset_id: str, leaves: DataFrame, generation: int) -> None:
        """Store file leaves under a generation of their own, so that those they were made from stay readable."""
        stamped = leaves.withColumns({"dataset_id": F.lit(dataset_id), "generation": F.lit(generation).cast("bigint")})
        self.store("file_leaves", stamped, f"{dataset_id}/{generation}")

    def latest(self, dataset_id: str) -> dict | None:
        runs = self.read("scan_runs")
        if runs is None:
            return None
        done = runs.filter((F.col("dataset_id") == dataset_id) & (F.col("status") == "completed"))
        row = done.orderBy(F.desc("started_at")).limit(1).first()
        return row.asDict() if row else None


def incremental_scan(df: DataFrame, history: History, dataset_id: str, config=None, **scan_args):
    """The stored run when neither schema, size, content nor configuration changed, else a new scan.

    Returns (scan_run, issues, reused).
    """
    from veritable.plans.scan import ScanConfig, scan

    return _unless_stored(df, history, dataset_id, config or ScanConfig(), scan, **scan_args)


def incremental_scan_files(
    spark: SparkSession,
    paths,
    history: History,
    dataset_id: str,
    config=None,
    *,
    fmt: str | None = None,
    settle_seconds: float = SETTLE_SECONDS,
    reader: dict | None = None,
    **scan_args,
) -> tuple[DataFrame, DataFrame, bool, DataFrame]:
    """H06 for files: only those that changed since the last call are read to tell whether anything did.

    Returns (scan_run, issues, reused, leaves); ``leaves`` tells of each file whether its leaf was ``reused``.
    ``reader`` holds the reader's options.  An interrupted call leaves whole leaves or none.
    """
    from veritable.plans.scan import ScanConfig, scan

    reader = reader or {}
    previous, generation = history.leaves(dataset_id)
    made = file_leaves(spark, paths, fmt, previous, settle_seconds, **reader)
    history.save_leaves(dataset_id, made, generation + 1)
    leaves, _ = history.leaves(dataset_id)
    df = read_table(spark, expand_paths(paths), fmt, **reader)
    rows, content = folded(df, leaves)
    found = _unless_stored(
        df, history, dataset_id, config or ScanConfig(), scan, known=(rows, content), **scan_args
    )
    return (*found, leaves)


def _unless_stored(df, history: History, dataset_id: str, config, scan, known=(None, None), **scan_args):
    before = history.latest(dataset_id)
    if before is not None and before["config"] != config.describe():
        before = None
    rows, content = known
    told = changed_since(df, before, rows, content)
    if before is not None and not told["changed"]:
        same = F.col("scan_run_id") == before["scan_run_id"]
        return history.read("scan_runs").filter(same), history.read("issues").filter(same), True
    content = content or told["content_fingerprint"]
    result = scan(df, config, dataset_id=dataset_id, content=content, **scan_args)
    history.save(result)
    return result.scan_run, result.issues, False


def _signature(run: DataFrame, side: str) -> DataFrame:
    return run.select(F.posexplode("column_signature").alias(f"{side}_pos", "c")).select(
        F.col("c.name").alias("name"), F.col("c.type").alias(f"{side}_type"), f"{side}_pos"
    )


def schema_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Added, removed and retyped columns; a changed order only when nothing else did."""
    both = _signature(reference, "ref").join(_signature(current, "cur"), "name", "full_outer")
    change = (
        F.when(F.col("ref_type").isNull(), "added")
        .when(F.col("cur_type").isNull(), "removed")
        .when(F.col("ref_type") != F.col("cur_type"), "dtype_changed")
    )
    told = both.withColumn("change_type", change).withColumn(
        # One row per column of a schema.
        "real",
        F.count("change_type").over(Window.partitionBy()),
    )
    moved = F.col("ref_pos") != F.col("cur_pos")
    reordered = (
        told.filter((F.col("real") == 0))
        .agg(F.count_if(moved).alias("moved"), F.min_by("name", "ref_pos").alias("column"))
        .filter("moved > 0")
        .select(
            F.lit("order_changed").alias("change_type"),
            "column",
            F.lit(None).cast("string").alias("before"),
            F.lit(None).cast("string").alias("after"),
        )
    )
    changed = told.filter(F.col("change_type").isNotNull()).select(
        "change_type",
        F.col("name").alias("column"),
        F.col("ref_type").alias("before"),
        F.col("cur_type").alias("after"),
    )
    return changed.unionByName(reordered)


def _side(runs: DataFrame, side: str, *cols: str) -> DataFrame:
    return runs.select("dataset_id", *[F.col(c).alias(f"{side}_{c}") for c in cols])


def number_drift(
    reference: DataFrame,
    current: DataFrame,
    row_threshold: float = ROW_DRIFT,
    score_threshold: float = SCORE_DRIFT,
) -> DataFrame:
    """Drift of row count and overall score, per dataset (one run each side)."""
    both = _side(reference, "ref", "row_count", "overall").join(
        _side(current, "cur", "row_count", "overall"), "dataset_id"
    )
    ref_rows, cur_rows = F.col("ref_row_count"), F.col("cur_row_count")
    ref_score, cur_score = F.col("ref_overall"), F.col("cur_overall")
    moved = F.abs(cur_rows - ref_rows) / F.when(ref_rows > 0, ref_rows)
    gap = F.round(F.abs(cur_score - ref_score), 2)

    def entry(metric, value, hit, threshold, up):
        return F.struct(
            F.lit("__dataset__").alias("column"),
            F.lit("numeric").alias("drift_type"),
            F.lit(metric).alias("metric"),
            value.alias("value"),
            F.lit(float(threshold)).alias("threshold"),
            F.when(up, "increase").otherwise("decrease").alias("direction"),
            F.lit("medium").alias("severity"),
            F.coalesce(hit, F.lit(False)).alias("hit"),
        )

    entries = F.array(
        entry("row_count", F.round(moved, 4), moved >= row_threshold, row_threshold, cur_rows > ref_rows),
        entry("quality_overall", gap, gap >= score_threshold, score_threshold, cur_score >= ref_score),
    )
    return both.select("dataset_id", F.inline(entries)).filter("hit").drop("hit")


def issue_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Change in the number of issues of each type."""
    sides = reference.select("issue_type", F.lit(1).alias("r"), F.lit(0).alias("c")).unionAll(
        current.select("issue_type", F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    counts = sides.groupBy("issue_type").agg(F.sum("r").alias("before"), F.sum("c").alias("after"))
    before, after = F.col("before"), F.col("after")
    direction = (
        F.when(before == 0, "new_category")
        .when(after == 0, "gone_category")
        .when(after > before, "increase")
        .otherwise("decrease")
    )
    return counts.filter(before != after).select(
        F.lit("__issues__").alias("column"),
        F.lit("categorical").alias("drift_type"),
        F.concat(F.lit("issue_count."), "issue_type").alias("metric"),
        F.abs(after - before).cast("double").alias("value"),
        F.lit(1.0).alias("threshold"),
        direction.alias("direction"),
        F.when(before == 0, "high").otherwise("medium").alias("severity"),
    )


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    reference_issues: DataFrame,
    current_issues: DataFrame,
    **thresholds,
) -> tuple[DataFrame, DataFrame]:
    """(schema changes, drifts) between two runs."""
    numbers = number_drift(reference, current, **thresholds).drop("dataset_id")
    return (
        schema_drift(reference, current),
        numbers.unionByName(issue_drift(reference_issues, current_issues)),
    )


def latest_two(runs: DataFrame) -> DataFrame:
    """Each dataset's two most recent completed runs, as ``position`` 1 and 2.

    Spark keeps two rows per dataset and task before it shuffles.
    """
    w = Window.partitionBy("dataset_id").orderBy(F.desc("started_at"), F.desc("scan_run_id"))
    done = runs.filter(F.col("status") == "completed")
    return done.withColumn("position", F.row_number().over(w)).filter("position <= 2")


def drift_latest(runs: DataFrame, issues: DataFrame, dataset_id: str):
    """H11 for the two latest runs of one dataset; None when there are not two."""
    two = latest_two(runs.filter(F.col("dataset_id") == dataset_id)).collect()
    if len(two) < 2:
        return None
    ids = {r["position"]: r["scan_run_id"] for r in two}

    def pick(df, position):
        return df.filter(F.col("scan_run_id") == ids[position])

    return drift_report(pick(runs, 2), pick(runs, 1), pick(issues, 2), pick(issues, 1))


def _scored(runs: DataFrame) -> DataFrame:
    done = runs.filter((F.col("status") == "completed") & F.col("overall").isNotNull())
    return done.withColumn("at", F.coalesce("finished_at", "started_at"))


def trends(runs: DataFrame) -> DataFrame:
    """First and latest score of each dataset and the direction between them."""
    issues = F.aggregate(F.map_values("issues_count"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    told = (
        _scored(runs)
        .withColumn("issues_total", issues)
        .groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min_by("overall", F.struct("at", "scan_run_id")).alias("first_score"),
            F.max_by("overall", F.struct("at", "scan_run_id")).alias("latest_score"),
            F.max_by("issues_total", F.struct("at", "scan_run_id")).alias("latest_issues"),
            F.max("at").alias("latest_at"),
        )
    )
    delta = F.col("latest_score") - F.col("first_score")
    return told.withColumn("delta", delta).withColumn(
        "direction",
        F.when(F.col("delta") >= TREND_STEP, "up")
        .when(F.col("delta") <= -TREND_STEP, "down")
        .otherwise("flat"),
    )


def run_comparison(runs: DataFrame, current_run_id: str | None = None) -> DataFrame:
    """Scores and counts of each run beside the change from the run before it."""
    w = Window.partitionBy("dataset_id").orderBy("at", "scan_run_id")
    everything = Window.partitionBy("dataset_id")
    overall = F.round("overall", 1)
    rounded = F.transform_values("dimensions", lambda _, v: F.round(v, 1))
    return (
        _scored(runs)
        .withColumn("overall", overall)
        .withColumn("runs", F.count(F.lit(1)).over(everything))
        .filter("runs >= 2")
        .select(
            "dataset_id",
            "scan_run_id",
            "at",
            "overall",
            F.round(F.col("overall") - F.lag("overall").over(w), 1).alias("delta"),
            rounded.alias("dimensions"),
            "issues_count",
            F.coalesce(F.col("scan_run_id") == F.lit(current_run_id), F.lit(False)).alias("current"),
        )
    )


def issue_diff(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Issues by (type, columns): new, fixed or persistent, with the change in number."""
    sides = [
        df.groupBy("issue_type", F.array_join("columns", ",").alias("columns")).agg(
            F.count(F.lit(1)).alias(side)
        )
        for df, side in ((reference, "before"), (current, "after"))
    ]
    both = sides[0].join(sides[1], ["issue_type", "columns"], "full_outer")
    before, after = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    status = F.when(before == 0, "NEW").when(after == 0, "FIXED").otherwise("PERSISTENT")
    return both.select(
        "issue_type",
        "columns",
        before.alias("before"),
        after.alias("after"),
        F.when(after == 0, before).otherwise(after - before).alias("delta"),
        status.alias("status"),
    )


def fixed_by(diff: DataFrame, repairs: DataFrame, dataset_id: str) -> DataFrame:
    """Fixed groups beside the applied repairs that touched one of their columns.

    ``repairs``: repair_id, dataset_id, status, columns array, operations array, created_at.
    """
    fixed = diff.filter("status = 'FIXED'").select(
        "issue_type", "columns", F.explode(F.split("columns", ",")).alias("part")
    )
    applied = repairs.filter((F.col("status") == "applied") & (F.col("dataset_id") == dataset_id))
    touched = applied.select("repair_id", "operations", "created_at", F.explode("columns").alias("part"))
    joined = fixed.withColumn("part", F.trim("part")).join(touched, "part")
    return joined.select("issue_type", "columns", "repair_id", "operations", "created_at").distinct()


def run_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of every dimension score and severity count between two runs."""

    def long(run: DataFrame, side: str) -> DataFrame:
        dims = run.select(F.lit("dimension").alias("kind"), F.explode("dimensions").alias("name", side))
        counts = run.select(
            F.lit("severity").alias("kind"),
            F.explode("issues_count").alias("name", "n"),
        ).select("kind", "name", F.col("n").cast("double").alias(side))
        return dims.unionByName(counts)

    both = long(before, "before").join(long(after, "after"), ["kind", "name"], "full_outer")
    severity = F.col("kind") == "severity"
    b = F.when(severity, F.coalesce("before", F.lit(0.0))).otherwise(F.col("before"))
    a = F.when(severity, F.coalesce("after", F.lit(0.0))).otherwise(F.col("after"))
    return both.select(
        "kind", "name", b.alias("before"), a.alias("after"), F.round(a - b, 1).alias("delta")
    )

