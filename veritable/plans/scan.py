"""The full scan (E01): every detector, few passes.

Pass A  one aggregate: row count, NULL counts, ranges, and all counted
        predicates of all columns, built-in and user-declared, and the rules.
Pass B  quantiles, deviations, outlier counts and histograms of all numeric columns together, in zones
        that sketches leave open; NULL pairs, if there are any.
Pass C  the value-frequency table, computed once and read by the duplicate,
        category, spelling and date detectors.
The remaining detectors (time buckets, groups, histogram, orphans, model) are one
grouped pass each.  Only one-row aggregates return to the driver before the
candidates are written.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.columns import (
    TIME_TEXT_HINTS,
    col,
    hinted,
    numeric_columns,
    string_columns,
    temporal_columns,
)
from veritable.operators import categorical, completeness, cross, dates, model_outlier, numeric
from veritable.operators import text_format, uniqueness
from veritable.operators.checks import (
    ROWS,
    Check,
    Target,
    chunked,
    empty,
    one_row,
    report,
)
from veritable.operators.cross import Reference
from veritable.operators.fingerprint import (
    content_fingerprint,
    sampled_fingerprint,
    schema_hash,
    signature,
    statistics_fingerprint,
)
from veritable.operators.frequency import text_values, value_counts
from veritable.operators.fusion import fuse, score
from veritable.operators.quality import quality, quality_summary, severity_counts
from veritable.operators.rules import Rule, counted_apart, rule_checks
from veritable.operators.sampling import sample
from veritable.plans.registry import Detector, Registry, default_registry
from veritable.schema import CANDIDATE, DETECTOR_RUN, SCAN_RUN
from veritable.session import spread


@dataclass(frozen=True)
class ScanConfig:
    detectors: Sequence[str] | None = None
    rules: Sequence[Rule] = ()
    references: Sequence[Reference] = ()
    sampling: str = "none"
    sample_size: int | None = None
    sample_ratio: float | None = None
    time_column: str | None = None
    strata: Sequence[str] | None = None
    keys: Sequence[str] | None = None
    seed: int = 42
    as_of: str | None = None
    approx: bool = False
    criticality: str = "normal"
    detector_params: Mapping[str, Mapping] = field(default_factory=dict)
    fingerprint: bool = True
    cache_input: bool | None = None

    def describe(self) -> str:
        shown = {
            "detectors": list(self.detectors) if self.detectors is not None else None,
            "rules": [repr(r) for r in self.rules],
            "references": [[r.name, sorted(r.columns.items())] for r in self.references],
            "sampling": self.sampling,
            "sample_size": self.sample_size,
            "sample_ratio": self.sample_ratio,
            "seed": self.seed,
            "as_of": self.as_of,
            "approx": self.approx,
            "time_column": self.time_column,
            "strata": list(self.strata or ()),
            "keys": list(self.keys or ()),
            "criticality": str(self.criticality),
            "detector_params": {k: dict(v) for k, v in self.detector_params.items()},
            "fingerprint": self.fingerprint,
        }
        return json.dumps(shown, sort_keys=True, default=str)


@dataclass
class ScanResult:
    scan_run: DataFrame
    detector_runs: DataFrame
    candidates: DataFrame
    issues: DataFrame
    quality: DataFrame
    rows: int
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free what the scan kept in executor storage."""
        for df in self.held:
            df.unpersist()


# Detectors answered by counted predicates of the first aggregate.
COUNTED: dict[str, Callable[[DataFrame, ScanConfig], list[Check]]] = {
    "excessive_null_rate": lambda df, c: completeness.null_rate_checks(df),
    "suspicious_missing_token": lambda df, c: completeness.missing_token_checks(df),
    "suspicious_placeholder": lambda df, c: categorical.placeholder_checks(df),
    "tail_probability": lambda df, c: numeric.tail_checks(df),
    "cross_field_rule": lambda df, c: cross.range_checks(df),
    "invalid_date": lambda df, c: dates.invalid_date_checks(df),
    "impossible_date": lambda df, c: dates.impossible_date_checks(df),
    "future_date": lambda df, c: dates.future_checks(df, as_of=c.as_of),
    "stale_date": lambda df, c: dates.stale_checks(df, as_of=c.as_of),
    **{d: (lambda df, c, d=d: text_format.text_checks(d, df)) for d in text_format.COUNTED},
}
# Those that look at one text at a time, and find nothing in a NULL.
_PER_TEXT = {"suspicious_missing_token", "suspicious_placeholder", "invalid_date", "impossible_date", *text_format.COUNTED}
_FREQUENCY = {
    "uniqueness_violation": lambda at, f, rows: uniqueness.uniqueness_violation(at, freq=f),
    "fuzzy_duplicate": lambda at, f, rows: uniqueness.fuzzy_duplicate(at, freq=f),
    "rare_category": lambda at, f, rows: categorical.rare_category(at, freq=f, rows=rows),
    "category_explosion": lambda at, f, rows: categorical.category_explosion(at, freq=f),
    "inconsistent_case": lambda at, f, rows: categorical.inconsistent_case(at, freq=f),
    "spelling_variant": lambda at, f, rows: text_format.spelling_variant(at, freq=f, rows=rows),
    "mixed_date_format": lambda at, f, rows: dates.mixed_date_format(at, freq=f),
    "duplicate_timestamp": lambda at, f, rows: dates.duplicate_timestamp(at, freq=f),
}
_PARALLEL_JOBS = 6
_QUANTILE = ("iqr_outlier", "percentile_outlier", "modified_zscore")
_PAIRS = {
    "conditional_missingness": (completeness.conditional_checks, completeness.conditional_missingness),
    "correlated_missingness": (completeness.correlated_checks, completeness.correlated_missingness),
}


@dataclass
class _Pass:
    """What one table (the sample, or everything) yields, detector by detector."""

    at: Target
    config: ScanConfig
    ids: list[str]
    users: list[Detector]
    errors: dict[str, str] = field(default_factory=dict)
    rule_errors: dict[str, str] = field(default_factory=dict)
    skipped: set[str] = field(default_factory=set)
    held: list[DataFrame] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)
    freq: DataFrame | None = None
    rows: int = 0
    nulls: dict[str, int] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    slots: dict[str, int] = field(default_factory=dict)
    parts: list[tuple[str, DataFrame]] = field(default_factory=list)

    def guard(self, detector_id: str, build: Callable):
        """Run ``build``; a failure marks that detector and leaves the others alone."""
        try:
            return build()
        except Exception as exc:
            self.errors[detector_id] = f"{type(exc).__name__}: {exc}"[:500]
            return None

    def hold(self, df: DataFrame) -> DataFrame:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(kept)
        return kept

    def has(self, *ids: str) -> bool:
        return any(i in self.ids for i in ids)

    # -- pass A ---------------------------------------------------------------
    def counted_checks(self) -> list[Check]:
        checks: list[Check] = []
        for d in self.ids:
            if d in COUNTED:
                found = self.guard(d, lambda d=d: COUNTED[d](self.at.df, self.config))
                if found == []:
                    self.skipped.add(d)
                checks += found or []
        for user in self.users:
            if user.checks:
                checks += self.guard(user.detector_id, lambda u=user: list(u.checks(self.at.df))) or []
        return checks

    def pass_a(self, checks: list[Check]) -> None:
        df = self.at.df
        numbers, texts = numeric_columns(df), string_columns(df)
        extra, read = [], []
        for i, c in enumerate(df.columns):
            extra.append(F.count_if(col(c).isNull()).alias(f"null{i}"))
        for i, c in enumerate(numbers):
            x = col(c).cast("double")
            extra += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count(x).alias(f"nn{i}")]
        if self.has("group_missingness"):
            read = texts
            extra += [completeness.occupied_slots(col(c)).alias(f"sk{i}") for i, c in enumerate(read)]
        row = self.count(checks, extra)
        self.rows = row[ROWS]
        self.nulls = {c: row[f"null{i}"] for i, c in enumerate(df.columns)}
        self.ranges = {c: (row[f"lo{i}"], row[f"hi{i}"], row[f"nn{i}"]) for i, c in enumerate(numbers)}
        self.slots = {c: row[f"sk{i}"] for i, c in enumerate(read)}

    def count(self, checks: list[Check], extra: Sequence = ()) -> dict:
        """Count the checks, add their candidates, and return the first aggregate's row.

        Checks of single texts look at each short value once, however many rows it has.
        """
        texts = set(string_columns(self.at.df))
        per_text = [c for c in checks if c.detector_id in _PER_TEXT and texts.issuperset(c.columns)]
        others = [c for c in checks if not any(c is p for p in per_text)]
        first: dict = {}
        for i, group in enumerate(chunked(others) or [[]]):
            row, group = self.counted(self.at.df, group, list(extra) if i == 0 else [])
            self.add_counts(row, group)
            first = first or row
        for group in chunked(per_text) if first[ROWS] else []:
            names = list(dict.fromkeys(c for check in group for c in check.columns))
            n = "n"
            while n in {c.lower() for c in names}:
                n += "_"
            values = text_values(self.at.df, names)
            values = values.select(F.col("n").alias(n), *[F.when(F.col("column") == c, F.col("value")).alias(c) for c in names])
            row, group = self.counted(values, group, [], F.col(n))
            self.add_counts({**row, ROWS: first[ROWS]}, group)
        return first

    def counted(self, df: DataFrame, group: list[Check], head: Sequence, times: Column | None = None) -> tuple[dict, list[Check]]:
        """Counts of the checks that could be counted; a row of ``df`` stands for so many ``times``.

        A detector whose checks fail is marked failed and leaves no candidates; rules share one detector, and each
        stands by itself.
        """
        units: dict[tuple, list[Check]] = {}
        for c in group:
            units.setdefault((c.detector_id, c.issue_type if c.detector_id == "contract_rule" else None), []).append(c)

        def tally(hit: Column) -> Column:
            return F.count_if(hit) if times is None else F.coalesce(F.sum(F.when(hit, times)), F.lit(0))

        parts = [(key, [tally(c.hit) for c in own]) for key, own in units.items()]
        row, counts, errors = counted_apart(df, parts, head)
        for (detector_id, issue_type), error in errors.items():
            if issue_type is None:
                self.errors[detector_id] = error
            else:
                self.rule_errors[issue_type.removeprefix("rule:")] = error
        kept = []
        for key, values in counts.items():
            for check, value in zip(units[key], values):
                row[f"hit{len(kept)}"] = value
                kept.append(check)
        return row, kept

    def add_counts(self, row: dict, group: list[Check]) -> None:
        if not group:
            return
        counts = {k: v for k, v in row.items() if k == ROWS or k.startswith("hit")}
        schema = ", ".join(f"{k} bigint" for k in counts)
        one = self.at.spark.createDataFrame([tuple(counts.values())], schema)
        self.parts.append((group[0].detector_id, report(self.at, one, group)))

    # -- passes B and C -------------------------------------------------------
    def pass_c(self) -> None:
        df, checks = self.at.df, []
        numbers = [c for c, s in self.ranges.items() if s[2]]
        if self.config.approx and self.has(*_QUANTILE) and numbers:
            checks += self.approximate_checks(numbers)
        elif self.has(*_QUANTILE) and numbers:
            self.guard("iqr_outlier", lambda: self.outliers(numbers))
        pairs = completeness.sparse_pairs(self.nulls, self.rows)
        for d, (build, found) in _PAIRS.items():
            if self.has(d) and len(pairs) <= completeness.COUNTED_PAIRS:
                checks += build(self.nulls, self.rows)
        if self.has(*_PAIRS) and len(pairs) > completeness.COUNTED_PAIRS:
            both = self.guard("correlated_missingness", lambda: self.hold(completeness.null_pairs(df, completeness.sparse_columns(self.nulls, self.rows))))
            for d, (build, found) in _PAIRS.items():
                if self.has(d) and both is not None:
                    self.parts.append((d, found(self.at, (self.rows, self.nulls), both)))
        if checks:
            self.count(checks)

    def approximate_checks(self, numbers: list[str]) -> list[Check]:
        df, checks = self.at.df, []
        q = self.guard("iqr_outlier", lambda: numeric.column_quantiles(df, numbers, approx=True)) or {}
        if self.has("iqr_outlier"):
            checks += numeric.iqr_checks(q)
        if self.has("percentile_outlier"):
            checks += numeric.percentile_checks(q)
        if self.has("modified_zscore") and q:
            medians = {c: v[0.5] for c, v in q.items()}
            mads = self.guard("modified_zscore", lambda: numeric.approximate_deviations(df, medians))
            checks += numeric.zscore_checks(medians, mads or {})
        return checks

    def outliers(self, numbers: list[str]) -> None:
        """Quantiles, deviations, everything counted outside of their bounds, and the histograms: one read."""
        steps = numeric.histogram_steps(self.ranges) if self.has("histogram_rarity") else {}
        found = numeric.resolved(
            self.at.df,
            numbers,
            bins={c: (lo, width) for c, (lo, width, _) in steps.items()},
        )
        wanted = [d for d in _QUANTILE if self.has(d)]
        self.parts.append((wanted[0] if wanted else "histogram_rarity", numeric.counted(self.at, self.rows, numeric.outlier_counts(found, wanted))))
        if self.has("histogram_rarity"):
            counts = {c: f.bins for c, f in found.items()}
            self.parts.append(("histogram_rarity", numeric.histogram_rarity(self.at, known=self.ranges, counts=counts)))

    # -- pass D and the grouped passes ---------------------------------------
    def pass_d(self) -> None:
        wanted = [d for d in _FREQUENCY if self.has(d)]
        if not wanted:
            return
        self.freq = value_counts(self.at.df).persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(self.freq)
        for d in wanted:
            part = self.guard(d, lambda d=d: _FREQUENCY[d](self.at, self.freq, self.rows))
            if part is not None:
                self.parts.append((d, part))

    def grouped(self) -> None:
        at, known = self.at, (self.rows, self.nulls)
        model = dict(self.config.detector_params.get("model_outlier", {}))
        builders = {
            "sudden_missingness": lambda: completeness.sudden_missingness(at, known),
            "group_missingness": lambda: completeness.group_missingness(at, known, self.slots),
            **({"histogram_rarity": lambda: numeric.histogram_rarity(at, known=self.ranges)} if self.config.approx or not self.has(*_QUANTILE) else {}),
            "model_outlier": lambda: model_outlier.model_outlier(
                at, known=self.ranges, seed=self.config.seed, freq=self.freq, **model
            ),
        }
        for d, build in builders.items():
            if self.has(d):
                part = self.guard(d, build)
                if part is not None:
                    self.parts.append((d, part))
        for user in self.users:
            if user.detect is not None:
                part = self.guard(user.detector_id, lambda u=user: u.detect(at))
                if part is not None:
                    self.parts.append((user.detector_id, part))

    def collect_parts(self) -> DataFrame:
        """Run every detector's plan, several at a time, and gather the candidates.

        A built-in detector reports per column, per calendar bucket, or per category of
        a column with few of them, so its rows are few whatever the size of the table;
        a user's detector may report more and stays distributed.  One that fails while
        running is marked failed and the candidates of the others stand.
        """
        users = {u.detector_id for u in self.users}

        def evaluate(entry: tuple[str, DataFrame]):
            detector_id, part = entry
            part = part.select(*CANDIDATE.names)
            if detector_id not in users:
                return self.guard(detector_id, part.collect)
            kept = part.persist(StorageLevel.MEMORY_AND_DISK)
            self.kept.append(kept)
            return None if self.guard(detector_id, kept.count) is None else kept

        with ThreadPoolExecutor(_PARALLEL_JOBS) as pool:
            done = [p for p in pool.map(evaluate, self.parts) if p is not None]
        rows = [row for part in done if isinstance(part, list) for row in part]
        local = self.at.spark.createDataFrame(rows, CANDIDATE)
        return reduce(DataFrame.unionByName, [p for p in done if not isinstance(p, list)], local)

    def run(self) -> None:
        self.pass_a(self.counted_checks())
        if self.rows == 0:
            return
        # Independent passes: submitted together, so one fills the gaps of the other.
        with ThreadPoolExecutor(2) as pool:
            bounds = pool.submit(self.pass_c)
            self.pass_d()
            self.grouped()
            bounds.result()


def _not_applicable(df: DataFrame, config: ScanConfig) -> set[str]:
    """Built-in detectors with nothing to look at in this schema."""
    numbers, texts, times = numeric_columns(df), string_columns(df), temporal_columns(df)
    need_two = {"group_missingness", "conditional_missingness", "correlated_missingness"}
    out = set(_QUANTILE) | {"tail_probability", "histogram_rarity", "model_outlier"} if not numbers else set()
    if not texts:
        out |= {"fuzzy_duplicate", "spelling_variant", "inconsistent_case"}
    if len(df.columns) < 2:
        out |= need_two
    if not (times or hinted(texts, TIME_TEXT_HINTS)):
        out.add("sudden_missingness")
    if not times:
        out |= {"duplicate_timestamp"}
    if not dates._date_texts(df):
        out.add("mixed_date_format")
    if not config.references:
        out.add("foreign_key_violation")
    return out


def _fingerprint(df: DataFrame, config: ScanConfig, sampled: bool) -> str | None:
    if not config.fingerprint:
        return None
    return sampled_fingerprint(df) if sampled else content_fingerprint(df)


def sample_size(config: ScanConfig, rows: int) -> int | None:
    if config.sampling == "none":
        return None
    if config.sample_size is not None:
        return config.sample_size
    return max(1, int(rows * config.sample_ratio)) if config.sample_ratio is not None else None


def scan(
    df: DataFrame,
    config: ScanConfig | None = None,
    *,
    dataset_id: str = "dataset",
    table_name: str | None = None,
    source_path: str | None = None,
    registry: Registry | None = None,
    scan_run_id: str | None = None,
    content: str | None = None,
) -> ScanResult:
    """Detect, apply rules, fuse, score, summarise.

    ``content`` is the table's content fingerprint where the caller knows it already.  What was held of the table is freed
    at the end: Spark would answer a later read of the same files from it, whether or not they changed since.
    """
    work: list[DataFrame] = []
    try:
        return _scan(df, config or ScanConfig(), registry or default_registry(), work, dataset_id, table_name, source_path, scan_run_id, content)
    finally:
        for held in work:
            held.unpersist()


def _scan(df, config, registry, inputs: list[DataFrame], dataset_id, table_name, source_path, scan_run_id, content) -> ScanResult:
    spark, started = df.sparkSession, dt.datetime.now(dt.timezone.utc)
    run_id = scan_run_id or f"scan_{uuid.uuid4().hex[:12]}"
    flat, cached = spread(df, config.cache_input)
    if cached:
        inputs.append(flat)

    chosen = registry.list(config.detectors)
    built_in = default_registry().detectors
    users = [d for d in chosen if d.detector_id not in built_in or d.detect is not built_in[d.detector_id].detect]
    idle = _not_applicable(df, config) | {
        u.detector_id for u in users if not u.supports(df)
    }
    active = [d for d in chosen if d.detector_id not in idle]

    full_rows: int | None = None
    scanned = flat
    wanted = None
    if config.sampling != "none":
        full_rows = flat.count()
        wanted = sample_size(config, full_rows)
    sampled = wanted is not None and wanted < full_rows
    if sampled:
        scanned = sample(
            flat,
            config.sampling,
            wanted,
            time_column=config.time_column,
            strata=config.strata,
            keys=config.keys,
            seed=config.seed,
        ).persist(StorageLevel.MEMORY_AND_DISK)
        inputs.append(scanned)

    user_ids = {u.detector_id for u in users}
    users = [u for u in users if u.detector_id not in idle]
    # Whatever does not work on a sample sees the whole table.
    apart = [u for u in users if sampled and not u.supports_sampling]
    work = _Pass(
        Target(scanned, dataset_id, table_name),
        config,
        [d.detector_id for d in active if d.detector_id not in user_ids],
        [u for u in users if u not in apart],
        held=inputs,
    )
    work.run()
    rows = work.rows if full_rows is None else full_rows
    full = _Pass(Target(flat, dataset_id, table_name), config, [], apart, held=inputs)
    if apart:
        full.run()
    if "foreign_key_violation" in work.ids and rows:
        part = full.guard(
            "foreign_key_violation", lambda: cross.foreign_key_violation(full.at, config.references)
        )
        if part is not None:
            full.parts.append(("foreign_key_violation", part))
    broken: dict[str, str] = {}
    if config.rules and rows:
        checks, broken = rule_checks(flat, config.rules)
        full.count(checks)
        broken |= full.rule_errors

    # Candidates are few: per column and detector, plus reported buckets and groups.
    with ThreadPoolExecutor(1) as pool:
        hashed = pool.submit(lambda: _fingerprint(flat, config, sampled) if sampled or content is None else content)
        # A ratio is taken over the rows that its own detector saw.
        seen = [
            p.collect_parts().withColumn("rows_examined", F.lit(n).cast("bigint"))
            for p, n in ((work, work.rows), (full, rows))
        ]
        fingerprint = hashed.result()
    candidates = seen[0].unionByName(seen[1])
    issues = score(fuse(candidates, run_id, work.rows), config.criticality)
    candidates = candidates.drop("rows_examined")
    issues = issues.persist(StorageLevel.MEMORY_AND_DISK)
    held = [*work.kept, *full.kept, issues]
    errors, skipped_ids = work.errors | full.errors, work.skipped | full.skipped

    sampled_ids = {d.detector_id for d in active if d.supports_sampling} if sampled else set()
    runs = []
    for d in chosen:
        error = errors.get(d.detector_id)
        skipped = d.detector_id in idle or d.detector_id in skipped_ids
        status = "failed" if error else "skipped" if skipped else "completed"
        is_sampled = d.detector_id in sampled_ids
        seen = 0 if status != "completed" else work.rows if is_sampled else rows
        runs.append((run_id, d.detector_id, status, seen, rows, is_sampled, error))
    if config.rules:
        error = "; ".join(f"{k}: {v}" for k, v in broken.items())[:2000] or None
        runs.append((run_id, "contract_rule", "failed" if error else "completed", rows, rows, False, error))
    failed = {r[1]: r[6] for r in runs if r[2] == "failed"}
    ran = {registry.get(r[1]).dimension for r in runs if r[2] == "completed" and r[1] != "contract_rule"}
    scored = quality(issues, sorted(ran))
    counts = severity_counts(issues).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "issues")))).alias("m")
    )
    fixed = (
        run_id,
        dataset_id,
        source_path,
        "failed" if failed else "completed",
        "; ".join(f"{k}: {v}" for k, v in failed.items()) or None,
        started,
        None,
        rows,
        work.rows,
        schema_hash(df),
        statistics_fingerprint(df, rows),
        fingerprint,
        signature(df),
        None,
        None,
        None,
        config.describe(),
    )
    # Both summaries are one row, read once here so that the run record is a constant.
    summary, tally = one_row(quality_summary(scored)), one_row(counts)
    values = dict(zip(SCAN_RUN.names, fixed))
    values.update(
        finished_at=dt.datetime.now(dt.timezone.utc),
        issues_count=tally["m"],
        overall=summary["overall"] if ran else None,
        dimensions=summary["dimensions"],
    )
    return ScanResult(
        scan_run=spark.createDataFrame([tuple(values[n] for n in SCAN_RUN.names)], SCAN_RUN),
        detector_runs=spark.createDataFrame(runs, DETECTOR_RUN),
        candidates=candidates,
        issues=issues,
        quality=scored,
        rows=rows,
        held=held,
    )


def scan_many(
    tables: Mapping[str, DataFrame | Exception],
    config: ScanConfig | None = None,
    **kwargs,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan several datasets; one that fails is reported and the rest go on.

    Returns (per dataset summary, all issues with their dataset, totals).
    """
    if not tables:
        raise ValueError("no datasets")
    runs, issues, failures, spark = [], [], [], None
    for name, df in tables.items():
        if isinstance(df, Exception):
            failures.append((name, str(df)[:500]))
            continue
        spark = df.sparkSession
        try:
            result = scan(df, config, dataset_id=name, source_path=name, **kwargs)
        except Exception as exc:
            failures.append((name, f"{type(exc).__name__}: {exc}"[:500]))
            continue
        runs.append(result.scan_run)
        issues.append(result.issues)
    if spark is None:
        raise ValueError("; ".join(f"{n}: {e}" for n, e in failures))
    summary_schema = (
        "dataset_id string, status string, error string, row_count bigint, "
        "overall double, issues_count map<string,bigint>"
    )
    bad = spark.createDataFrame([(n, "failed", e, None, None, None) for n, e in failures], summary_schema)
    done = [r.select("dataset_id", "status", "error", "row_count", "overall", "issues_count") for r in runs]
    summary = reduce(DataFrame.unionByName, [*done, bad])
    totals = summary.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("row_count").alias("rows"),
        F.sum(
            F.aggregate(F.map_values("issues_count"), F.lit(0).cast("bigint"), lambda a, b: a + b)
        ).alias("issues"),
    )
    return summary, reduce(DataFrame.unionByName, issues) if issues else None, totals


