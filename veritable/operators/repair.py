"""Value-level repairs (X01-X13): proposed from issues, previewed, applied to a copy.

A repair is a Column expression, so a preview is the same lazy table an apply
writes out; the source is never overwritten.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions import predicates as P
from veritable.functions.columns import col
from veritable.operators.checks import one_row
from veritable.operators.fingerprint import content_fingerprint, row_lanes
from veritable.operators.frequency import value_counts

# ---- fixed values: which operation repairs what -----------------------------
OPERATION_FOR = {
    "leading_or_trailing_whitespace": "trim_whitespace",
    "inconsistent_case": "normalize_case",
    "suspicious_missing_token": "replace_missing_token",
    "invalid_date": "set_null",
    "impossible_date": "set_null",
    "iqr_outlier": "clip_value",
    "percentile_outlier": "clip_value",
    "modified_zscore": "clip_value",
}
RISK = {
    "trim_whitespace": "low",
    "normalize_case": "low",
    "replace_missing_token": "medium",
    "set_null": "medium",
    "clip_value": "medium",
}
EXAMPLES = 10
# ---- end of fixed values ----------------------------------------------------

RATIONALE = {
    "trim_whitespace": "the value without the blanks around it",
    "normalize_case": "one spelling in small letters for all forms of a value",
    "replace_missing_token": "NULL where a text only says that nothing is known",
    "set_null": "NULL where the value cannot be a date",
    "clip_value": "the nearest bound where a number lies outside the usual range",
}

PROPOSAL = (
    "issue_id string, issue_type string, operation string, columns array<string>, lower double, "
    "upper double, rationale string, risk_level string, reversibility string, "
    "estimated_rows_changed bigint"
)


@dataclass(frozen=True)
class Repair:
    operation: str
    columns: tuple[str, ...]
    params: Mapping[str, float] = field(default_factory=dict)


def clip_bounds(lower: float, upper: float) -> dict[str, float]:
    """User-given clip bounds must be finite and in order."""
    lower, upper = float(lower), float(upper)
    if not (math.isfinite(lower) and math.isfinite(upper)) or lower > upper:
        raise ValueError("clip bounds must be finite with lower <= upper")
    return {"lower": lower, "upper": upper}


def repaired(operation: str, c: Column, params: Mapping[str, float] | None = None) -> Column:
    """The value after the repair."""
    if operation == "trim_whitespace":
        return F.trim(c)
    if operation == "normalize_case":
        return F.lower(c)
    if operation == "replace_missing_token":
        return F.when(~F.coalesce(P.is_missing_token(c), F.lit(False)), c)
    if operation == "set_null":
        return F.when(~(P.is_not_iso_date(c) | P.is_impossible_date(c)), c)
    if operation == "clip_value":
        bounds = clip_bounds(params["lower"], params["upper"])
        low, high = F.lit(bounds["lower"]), F.lit(bounds["upper"])
        # greatest/least would turn NULL into a bound.
        return F.when(c < low, low).when(c > high, high).otherwise(c)
    raise ValueError(f"unsupported repair operation: {operation}")


def _chain(df: DataFrame, repairs: Sequence[Repair]) -> dict[str, Column]:
    """The final expression of every touched column; later repairs see earlier ones."""
    out: dict[str, Column] = {}
    for r in repairs:
        for c in r.columns:
            out[c] = repaired(r.operation, out.get(c, col(c)), r.params)
    return out


def apply_repairs(df: DataFrame, repairs: Sequence[Repair]) -> DataFrame:
    """The whole table with repaired columns, all in one projection."""
    exprs = _chain(df, repairs)
    return df.select(*[(exprs[c] if c in exprs else col(c)).alias(c) for c in df.columns])


def _choice(detectors: Sequence[str], bounds: tuple | None, columns: Sequence[str]):
    """The first detector of an issue that some operation repairs."""
    for d in detectors:
        operation = OPERATION_FOR.get(d)
        if operation == "clip_value" and (bounds is None or len(columns) != 1):
            continue
        if operation:
            return d, operation
    return None


def _evidence_bound(name: str) -> Column:
    """First ``name`` in an issue's evidence documents."""
    found = F.transform("evidence", lambda e: F.get_json_object(e, f"$.{name}").cast("double"))
    return F.try_element_at(F.array_compact(found), F.lit(1))


def propose(df: DataFrame, issues: DataFrame, asked: Sequence[tuple[str, tuple[str, ...]]] = ()) -> DataFrame:
    """Proposals for a run's issues; unsupported ones are left out.

    The rows each would change are all counted in one aggregate.  Where no row would change there is no proposal, unless
    it is among ``asked``: pairs of a detector of the run and its columns, which are told in any case, without an issue
    and bounds if the run found none.
    """
    rows = issues.select(
        "issue_id",
        "columns",
        "detector_ids",
        _evidence_bound("lower").alias("lower"),
        _evidence_bound("upper").alias("upper"),
    ).orderBy("issue_id").collect()  # issues of one run: few per column
    plans = []
    for r in rows:
        bounds = None if r["lower"] is None or r["upper"] is None else (r["lower"], r["upper"])
        chosen = _choice(r["detector_ids"], bounds, r["columns"])
        if chosen and set(r["columns"]) <= set(df.columns) and r["columns"]:
            params = clip_bounds(*bounds) if chosen[1] == "clip_value" else {}
            plans.append((r["issue_id"], chosen[0], Repair(chosen[1], tuple(r["columns"]), params)))
    found = {(d, tuple(r["columns"])): r for r in rows for d in r["detector_ids"]}
    told = {(source, r.columns) for _, source, r in plans}
    for source, columns in asked:
        if (source, columns) not in told:
            r = found.get((source, columns))
            bounded = OPERATION_FOR[source] == "clip_value" and r is not None and None not in (r["lower"], r["upper"])
            params = clip_bounds(r["lower"], r["upper"]) if bounded else {}
            plans.append((r and r["issue_id"], source, Repair(OPERATION_FOR[source], columns, params)))
    # A clip without bounds is one whose detector found nothing outside of them.
    counts = iter(count_changes(df, [r for *_, r in plans if r.operation != "clip_value" or r.params]))
    out = []
    for issue_id, source, r in plans:
        n = 0 if r.operation == "clip_value" and not r.params else next(counts)
        if n > 0 or (source, r.columns) in asked:
            kind = "partially_reversible" if r.operation == "set_null" else "fully_reversible"
            out.append(
                (
                    issue_id,
                    source,
                    r.operation,
                    list(r.columns),
                    r.params.get("lower"),
                    r.params.get("upper"),
                    RATIONALE[r.operation],
                    RISK[r.operation],
                    kind,
                    n,
                )
            )
    return df.sparkSession.createDataFrame(out, PROPOSAL)


def count_changes(df: DataFrame, repairs: Sequence[Repair]) -> list[int]:
    """Changed cells of each repair taken alone (F04), in one aggregate."""
    if not repairs:
        return []
    aggs = []
    for i, r in enumerate(repairs):
        hits = [
            F.count_if(P.changes(col(c), repaired(r.operation, col(c), r.params))) for c in r.columns
        ]
        aggs.append(reduce(lambda a, b: a + b, hits).alias(f"c{i}"))
    row = one_row(df.agg(*aggs))
    return [row[f"c{i}"] for i in range(len(repairs))]


def to_repairs(proposals: DataFrame) -> list[Repair]:
    return [
        Repair(
            r["operation"],
            tuple(r["columns"]),
            {} if r["lower"] is None else {"lower": r["lower"], "upper": r["upper"]},
        )
        for r in proposals.filter("estimated_rows_changed > 0").orderBy("issue_id").collect()
    ]


def _pairs(df: DataFrame, repairs: Sequence[Repair]) -> list[tuple[str, Column, Column]]:
    return [(c, col(c), after) for c, after in _chain(df, repairs).items()]


def preview(df: DataFrame, repairs: Sequence[Repair], exact_unique: bool = True) -> DataFrame:
    """Per column, changed rows and the change in NULLs and distinct values."""
    spark, pairs = df.sparkSession, _pairs(df, repairs)
    names = [c for c, _, _ in pairs]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (_, before, after) in enumerate(pairs):
        aggs.append(F.count_if(P.changes(before, after)).alias(f"ch{i}"))
        aggs.append((F.count_if(after.isNull()) - F.count_if(before.isNull())).alias(f"nu{i}"))
    wide = df.agg(*aggs)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"ch{i}").alias("rows_changed"),
            (F.col(f"ch{i}") / F.col("rows")).alias("changed_ratio"),
            F.col(f"nu{i}").alias("null_delta"),
        )
        for i, c in enumerate(names)
    ]
    told = wide.select(F.inline(F.array(*cells)))
    if not exact_unique:
        return told
    sides = [
        value_counts(table, names).groupBy("column").agg(F.count(F.lit(1)).alias(label))
        for table, label in ((df, "u_before"), (apply_repairs(df, repairs).select(*map(col, names)), "u_after"))
    ]
    base = spark.createDataFrame([(c,) for c in names], "column string")
    # One row per repaired column in every table of these joins.
    unique = base.join(F.broadcast(sides[0]), "column", "left").join(F.broadcast(sides[1]), "column", "left")
    unique = unique.select(
        "column",
        (F.coalesce("u_after", F.lit(0)) - F.coalesce("u_before", F.lit(0))).alias("unique_delta"),
    )
    return told.join(F.broadcast(unique), "column")


def change_log(
    df: DataFrame, repairs: Sequence[Repair], keys: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Before and after of changed cells, from one read; with ``limit``, the first of each column by key."""
    cells = [
        F.when(
            P.changes(before, after),
            F.struct(
                F.lit(c).alias("column"),
                before.cast("string").alias("before_value"),
                after.cast("string").alias("after_value"),
            ),
        )
        for c, before, after in _pairs(df, repairs)
    ]
    rows = df.select(*[col(k) for k in keys], F.inline(F.array_compact(F.array(*cells))))
    if limit is None:
        return rows
    first = F.row_number().over(Window.partitionBy("column").orderBy(*[col(k) for k in keys]))
    return rows.withColumn("__k", first).filter(F.col("__k") <= limit).drop("__k")


def examples(df: DataFrame, repairs: Sequence[Repair], keys: Sequence[str]) -> DataFrame:
    """The first ten changes per column."""
    return change_log(df, repairs, keys, EXAMPLES)


def candidates_before_after(df: DataFrame, repairs: Sequence[Repair], detectors: Mapping) -> DataFrame:
    """How many candidates each detector reports before and after."""
    fixed = apply_repairs(df, repairs)
    parts = [
        detect(table).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("detector_id"), F.lit(side).alias("side"), "n"
        )
        for name, detect in detectors.items()
        for side, table in (("before", df), ("after", fixed))
    ]
    counts = reduce(DataFrame.unionByName, parts).groupBy("detector_id")
    return counts.agg(
        F.max(F.when(F.col("side") == "before", F.col("n"))).alias("candidates_before"),
        F.max(F.when(F.col("side") == "after", F.col("n"))).alias("candidates_after"),
    )


def write_repair(df: DataFrame, repairs: Sequence[Repair], path: str, fmt: str = "parquet") -> dict:
    """Keep a snapshot of the source, write the repaired copy, fingerprint both.

    Parquet keeps values and types, so once it is written the snapshot stands for the source, which is read only once.
    """
    from veritable.sources.sinks import write_table

    snapshot, output = f"{path.rstrip('/')}/before", f"{path.rstrip('/')}/after"
    write_table(df, snapshot, fmt)
    if fmt == "parquet":
        df = df.sparkSession.read.schema(df.schema).parquet(snapshot)
    after = apply_repairs(df, repairs)
    write_table(after, output, fmt)
    if fmt == "parquet":
        after = df.sparkSession.read.schema(after.schema).parquet(output)
    return {
        "rollback_artifact": snapshot,
        "output_path": output,
        "format": fmt,
        "fingerprint_before": content_fingerprint(df),
        "fingerprint_after": content_fingerprint(after),
        "status": "applied",
    }


def rollback(spark, run: Mapping, path: str) -> dict:
    """Write the kept snapshot out again."""
    from veritable.sources.readers import read_table
    from veritable.sources.sinks import write_table

    if not run.get("rollback_artifact"):
        raise ValueError("run has no rollback artifact")
    write_table(read_table(spark, run["rollback_artifact"], run["format"]), path, run["format"])
    return {**run, "status": "rolled_back", "restored_path": path}


def row_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """X11: changed cells of rows matched by key, and rows present on one side only.

    Keys and 128 bits of each row are compared first; cells are carried only for the keys that differ, so equal tables
    shuffle their keys and hashes alone.  A NULL key matches none.  Rows that share a key are compared each with each of
    the other side.
    """
    cells = [c for c in before.columns if c not in keys and c in after.columns]
    shared = [f"__k{i}" for i in range(len(keys))]
    sides = [t.select(*[col(k).alias(n) for k, n in zip(keys, shared)], F.struct(*row_lanes(t, cells)).alias(h)) for t, h in ((before, "a"), (after, "b"))]
    differing = sides[0].join(sides[1], shared, "full_outer").filter(P.changes(F.col("a"), F.col("b"))).select(*shared).distinct()

    def touched(table: DataFrame, side: str) -> DataFrame:
        named = table.select(*[col(k) for k in keys], *[col(c).alias(f"{side}{i}") for i, c in enumerate(cells)])
        same = [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, shared)]
        return named.join(differing, same, "left_semi")

    old, new = touched(before, "o"), touched(after, "n")
    old, new = old.withColumn("old_row", F.lit(True)), new.withColumn("new_row", F.lit(True))
    both = old.join(new, list(keys), "full_outer")
    status = (
        F.when(F.col("old_row").isNull(), "added").when(F.col("new_row").isNull(), "removed").otherwise("changed")
    )
    differ = [P.changes(F.col(f"o{i}"), F.col(f"n{i}")) for i in range(len(cells))]
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"o{i}").cast("string").alias("old_value"),
            F.col(f"n{i}").cast("string").alias("new_value"),
            differ[i].alias("differs"),
        )
        for i, c in enumerate(cells)
    ]
    return (
        both.withColumn("change", status)
        .select(*[col(k) for k in keys], "change", F.inline(F.array(*parts)))
        .filter("differs")
        .drop("differs")
    )


def verify(source_issues: DataFrame, verify_issues: DataFrame, strict: bool = False) -> DataFrame:
    """Issue types fixed, persisting and new after a rescan; fails on new types, or
    on any remaining issue when ``strict``."""
    sides = source_issues.select("issue_type", F.lit(1).alias("s"), F.lit(0).alias("v")).unionAll(
        verify_issues.select("issue_type", F.lit(0).alias("s"), F.lit(1).alias("v"))
    )
    types = sides.groupBy("issue_type").agg(F.sum("s").alias("s"), F.sum("v").alias("v"))
    # One row per issue type.
    def of(keep):
        return F.sort_array(F.collect_list(F.when(keep, F.col("issue_type"))))

    told = types.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_issue_count"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("verify_issue_count"),
        of((F.col("s") > 0) & (F.col("v") == 0)).alias("fixed_types"),
        of((F.col("s") > 0) & (F.col("v") > 0)).alias("persistent_types"),
        of((F.col("s") == 0) & (F.col("v") > 0)).alias("new_types"),
    )
    clean = F.size("new_types") == 0
    return told.withColumn("passed", clean & (F.col("verify_issue_count") == 0) if strict else clean)


def suggestions(issues: DataFrame) -> DataFrame:
    """All different operations for an issue, in the order of its detectors."""
    from veritable.operators.fusion import lookup

    none = F.lit(None).cast("string")
    found = F.array_distinct(
        F.array_compact(F.transform("detector_ids", lambda d: lookup(d, OPERATION_FOR, none)))
    )
    return issues.select(
        "issue_id", "columns", F.posexplode(found).alias("pos", "operation")
    ).select(
        "issue_id",
        (F.col("pos") + 1).alias("rank"),
        "operation",
        lookup(F.col("operation"), RISK, none).alias("risk"),
        lookup(F.col("operation"), RATIONALE, none).alias("rationale"),
        "columns",
    )
