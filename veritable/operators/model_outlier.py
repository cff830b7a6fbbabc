"""Model-based outliers of single numeric columns.

Isolation forest: each column's trees are grown in one task from a bounded random
pool.  On one column a forest is a step function of the value, so every row of
the table is placed on its step by Arrow batches, rows are counted per step on
the map side, and scores and threshold follow from those few counts.

Local outlier factor: of every value of the column.  In one dimension the nearest
neighbours of a value are adjacent in sorted order, so distinct values with their
counts are dealt out by range, and each range sees as many values beyond its ends
as its own factors depend on.  A value's neighbours' neighbours' neighbours lie
within three times k values, and more than k + 1 copies of a value change no
factor.  The threshold is found by counting, so a column is gathered nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions.columns import col, numeric_columns
from veritable.operators.checks import Target, candidate, empty, evidence_json, target
from veritable.operators.numeric import spans

# ---- fixed values: model parameters -----------------------------------------
TREES, SUBSAMPLE = 100, 256
CONTAMINATION, MAX_RATIO, MIN_ANOMALIES = 0.02, 0.05, 3
MAX_SAMPLES, MIN_VALUES = 20_000, 8
NEIGHBOURS_MIN, NEIGHBOURS_MAX = 5, 20
# ---- end of fixed values ----------------------------------------------------

MODELS = ("isolation_forest", "local_outlier_factor")
_COLUMNS_PER_JOB = 20
#: Distinct values beyond a range's ends on which its factors depend, and values judged at once.
_HALO, _SLICE = 3 * NEIGHBOURS_MAX, 1024
#: Bits of a factor by which its rank is counted out, round by round.
_SHIFTS = (48, 36, 24, 12, 0)
_EXAMPLES = 10


def average_path(n: int) -> float:
    """Expected depth of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return float(2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n)


def grow_tree(values: np.ndarray, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """Cut points and leaf depths, left to right, of one random isolation tree."""
    limit = int(np.ceil(np.log2(max(2, len(values)))))
    cuts: list[float] = []
    depths: list[float] = []
    # Nodes still to visit; a cut waits on the stack between its two subtrees.
    stack: list = [(np.sort(values), 0)]
    while stack:
        item = stack.pop()
        if isinstance(item, float):
            cuts.append(item)
            continue
        part, depth = item
        if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            depths.append(depth + average_path(len(part)))
            continue
        cut = float(rng.uniform(part[0], part[-1]))
        at = int(np.searchsorted(part, cut, side="right"))
        stack += [(part[at:], depth + 1), cut, (part[:at], depth + 1)]
    return cuts, depths


def grow_forest(values: np.ndarray, seed: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of all trees and the anomaly score on each step between them."""
    rng = np.random.default_rng(seed)
    size = min(SUBSAMPLE, len(values))
    grown = [grow_tree(rng.choice(values, size, replace=False), rng) for _ in range(trees)]
    cuts = np.unique(np.concatenate([np.asarray(c, dtype=float) for c, _ in grown]))
    right_ends = np.append(cuts, np.inf)
    depth = np.zeros(len(right_ends))
    for tree_cuts, tree_depths in grown:
        depth += np.asarray(tree_depths)[np.searchsorted(tree_cuts, right_ends, side="left")]
    return cuts, np.exp2(-(depth / trees) / max(average_path(size), 1e-12))


def neighbours_of(n: int) -> int:
    """How many neighbours each of ``n`` values has."""
    return min(NEIGHBOURS_MAX, max(NEIGHBOURS_MIN, n // 10), n - 1)


def local_outlier_factors(values: np.ndarray, k: int | None = None) -> np.ndarray:
    """LOF of each value of a sorted array."""
    n = len(values)
    k = neighbours_of(n) if k is None else k
    offsets = np.concatenate([np.arange(-k, 0), np.arange(1, k + 1)])
    near = np.arange(n)[:, None] + offsets
    distance = np.where(
        (near >= 0) & (near < n), np.abs(values[np.clip(near, 0, n - 1)] - values[:, None]), np.inf
    )
    pick = np.argsort(distance, axis=1, kind="stable")[:, :k]
    near, distance = np.take_along_axis(near, pick, 1), np.take_along_axis(distance, pick, 1)
    reach = np.maximum(distance[:, -1][near], distance)
    density = 1.0 / (reach.mean(axis=1) + 1e-10)
    return density[near].mean(axis=1) / density


def _cells(df: DataFrame, names: list[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(i).alias("no"), col(c).cast("double").alias("x")) for i, c in enumerate(names)
    ]
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))
    return df.select(F.inline(F.array(*cells))).filter(finite)


def _counted(df: DataFrame, names: list[str], freq: DataFrame | None) -> DataFrame:
    """The distinct values of each column with their counts."""
    if freq is not None:
        return _distinct_cells(freq, names)
    return _cells(df, names).groupBy("no", "x").agg(F.count(F.lit(1)).alias("n"))


def _pool(df: DataFrame, names: list[str], counts: dict[str, tuple], size: int, seed: int, freq=None):
    """A pool of about ``size`` values per column, whatever their multiplicity.

    A value seen n times is drawn n * share times, rounded up or down by a hash of the value
    and the seed: the pool depends on the data alone, not on how they are partitioned.
    """
    share = [min(1.0, size / max(1, counts[c][2])) for c in names]
    counted = _counted(df, names, freq)
    wanted = F.col("n") * F.get(F.array(*[F.lit(s) for s in share]), F.col("no"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "no", "x"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.floor(wanted + chance).cast("int")
    return counted.select("no", F.explode(F.array_repeat("x", drawn)).alias("x"))


def _isolation(at: Target, names, counts, trees, contamination, size, seed, freq) -> DataFrame:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        no, values = int(pdf["no"].iloc[0]), np.sort(pdf["x"].to_numpy())
        cuts, scores = grow_forest(values, seed + no, trees)
        return pd.DataFrame({"no": [no], "cuts": [cuts], "scores": [scores]})

    grown = (
        _pool(at.df, names, counts, size, seed, freq)
        .groupBy("no")
        .applyInPandas(grow, "no int, cuts array<double>, scores array<double>")
        .toArrow()
    )
    # At most trees * SUBSAMPLE steps per column, whatever the size of the table.
    steps = {
        no: (np.asarray(cuts), np.asarray(scores))
        for no, cuts, scores in zip(*(grown[c].to_pylist() for c in ("no", "cuts", "scores")))
    }
    shared = at.spark.sparkContext.broadcast(steps)

    @F.pandas_udf("double")
    def score(no: pd.Series, x: pd.Series) -> pd.Series:
        no, x = no.to_numpy(), x.to_numpy()
        out = np.zeros(len(x))
        for k, (cuts, scores) in shared.value.items():
            here = np.flatnonzero(no == k)
            if len(here):
                out[here] = scores[np.searchsorted(cuts, x[here], side="left")]
        return pd.Series(out)

    if freq is None:
        cells = _cells(at.df, names).withColumn("n", F.lit(1))
    else:
        cells = _distinct_cells(freq, names)
    scored = cells.groupBy("no", score("no", "x").alias("score")).agg(
        F.sum("n").alias("n"), F.min("x").alias("example")
    )
    # As many rows per column as the forest has steps, so a window per column is bounded.
    per_column = Window.partitionBy("no")
    limit = F.expr(f"percentile(score, {1 - contamination}D, n)").over(per_column)
    return (
        scored.withColumns({"limit": limit, "total": F.sum("n").over(per_column)})
        .filter(F.col("score") > F.col("limit"))
        .groupBy("no", "total")
        .agg(
            F.sum("n").alias("anomalies"),
            F.slice(F.sort_array(F.collect_set("example")), 1, 10).alias("examples"),
        )
    )


def _distinct_cells(freq: DataFrame, names: list[str]) -> DataFrame:
    """The distinct values of the columns with their counts, from the frequency table."""
    number = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column")) - 1
    found = freq.filter(F.col("column").isin(names)).select(
        number.cast("int").alias("no"), F.col("value").cast("double").alias("x"), "n"
    )
    return found.filter(~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))))


def _columns_of(batches: Iterator[pa.RecordBatch]):
    """The columns of a sorted range: number, part, values and their counts."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    no, part, x, n = (table.column(c).to_numpy() for c in ("no", "part", "x", "n"))
    edges = np.append(np.flatnonzero(np.append(True, no[1:] != no[:-1])), len(no))
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(no[lo]), int(part[lo]), x[lo:hi], n[lo:hi]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each column in a range, and the values at both ends."""
    for no, part, x, n in _columns_of(batches):
        cells = [no, part, int(n.sum()), x[:_HALO], n[:_HALO], x[-_HALO:], n[-_HALO:]]
        names = ["no", "part", "total", "first_x", "first_n", "last_x", "last_n"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.float64()), pa.list_(pa.int64())] * 2]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names)


def _beyond(ends: list[tuple[int, list, list]]) -> tuple[np.ndarray, np.ndarray]:
    """The ``_HALO`` values nearest to a range, from the other ranges' ends, nearest range first."""
    xs, ns = [], []
    for _, x, n in ends:
        if sum(map(len, xs)) >= _HALO:
            break
        xs.append(np.asarray(x, float))
        ns.append(np.asarray(n, np.int64))
    if not xs:
        return np.zeros(0), np.zeros(0, np.int64)
    x, n = np.concatenate(xs), np.concatenate(ns)
    order = np.argsort(x)
    return x[order], n[order]


def weighted_factors(x: np.ndarray, n: np.ndarray, k: int, before: int = 0, after: int = 0) -> np.ndarray:
    """LOF of sorted distinct values that occur ``n`` times, but for the first and last few."""
    out = []
    end = len(x) - after
    for a in range(before, end, _SLICE):
        b = min(a + _SLICE, end)
        lo, hi = max(0, a - _HALO), min(len(x), b + _HALO)
        copies = np.minimum(n[lo:hi], k + 1)
        factors = local_outlier_factors(np.repeat(x[lo:hi], copies), k)
        # All copies of a value have the same neighbours, so the same factor.
        out.append(factors[(np.cumsum(copies) - copies)[a - lo : b - lo]])
    most = np.finfo(float).max
    return np.nan_to_num(np.concatenate(out), nan=most, posinf=most)


def _limits(scored: DataFrame, totals: dict[int, int], share: float) -> dict[int, float]:
    """The interpolated quantile of each column's factors over all rows.

    A positive number's bits order as the number, so each round counts rows by some more of them.
    """
    places = {no: share * (n - 1) for no, n in totals.items()}
    ranks = {(no, min(math.floor(p) + i, totals[no] - 1)) for no, p in places.items() for i in (0, 1)}
    known = {key: (0, key[1]) for key in ranks}  # leading bits, and the rank among the rows that have them
    for i, shift in enumerate(_SHIFTS):
        within = scored
        if i:
            wide = F.shiftright("bits", _SHIFTS[i - 1])
            here = {(no, lead) for (no, _), (lead, _) in known.items()}
            within = scored.filter(reduce(lambda p, q: p | q, [(F.col("no") == no) & (wide == lead) for no, lead in here]))
        found = within.groupBy("no", F.shiftright("bits", shift).alias("step")).agg(F.sum("n").alias("n")).toArrow()
        steps: dict[int, list[tuple[int, int]]] = {}
        for no, step, n in zip(*(found.column(c).to_pylist() for c in ("no", "step", "n"))):
            steps.setdefault(no, []).append((step, n))
        for key, (lead, rank) in known.items():
            inside = [s for s in steps[key[0]] if not i or s[0] >> (_SHIFTS[i - 1] - shift) == lead]
            for step, n in sorted(inside):
                if rank < n:
                    known[key] = (step, rank)
                    break
                rank -= n
    value = {key: float(np.int64(bits).view(np.float64)) for key, (bits, _) in known.items()}
    out = {}
    for no, p in places.items():
        low, high = (value[no, min(math.floor(p) + i, totals[no] - 1)] for i in (0, 1))
        out[no] = float(np.percentile([low, high], 100 * (p - math.floor(p))))
    return out


def _neighbours(at: Target, names, contamination, freq) -> DataFrame:
    schema = "no int, total bigint, anomalies bigint, examples array<double>"
    tasks = int(at.spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        _counted(at.df, names, freq)
        .repartitionByRange(tasks, "no", "x")
        .sortWithinPartitions("no", "x")
        .withColumn("part", F.spark_partition_id())
        .persist()
    )
    scored = None
    try:
        ends_schema = "no int, part int, total bigint, first_x array<double>, first_n array<bigint>, last_x array<double>, last_n array<bigint>"
        # A few values a range, whatever the size of the table.
        ends = sorted(ranged.mapInArrow(_ends, ends_schema).toArrow().to_pylist(), key=lambda r: (r["no"], r["part"]))
        totals: dict[int, int] = {}
        for r in ends:
            totals[r["no"]] = totals.get(r["no"], 0) + r["total"]
        totals = {no: n for no, n in totals.items() if n >= MIN_VALUES}
        if not totals:
            return at.spark.createDataFrame([], schema)
        shared = at.spark.sparkContext.broadcast(ends)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for no, part, x, n in _columns_of(batches):
                if no not in totals:
                    continue
                own = [r for r in shared.value if r["no"] == no]
                low_x, low_n = _beyond([(r["part"], r["last_x"], r["last_n"]) for r in own[::-1] if r["part"] < part])
                high_x, high_n = _beyond([(r["part"], r["first_x"], r["first_n"]) for r in own if r["part"] > part])
                every, times = np.concatenate([low_x, x, high_x]), np.concatenate([low_n, n, high_n])
                factors = weighted_factors(every, times, neighbours_of(totals[no]), len(low_x), len(high_x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), no), pa.int32()), pa.array(x), pa.array(n), pa.array(factors), pa.array(factors.view(np.int64))],
                    ["no", "x", "n", "factor", "bits"],
                )

        scored = ranged.mapInArrow(judge, "no int, x double, n bigint, factor double, bits bigint").persist()
        limits = _limits(scored, totals, 1 - contamination)
        limit = F.get(F.array(*[F.lit(limits.get(no)).cast("double") for no in range(len(names))]), F.col("no"))
        odd = scored.filter(F.col("factor") > limit)
        found = {r["no"]: r["n"] for r in odd.groupBy("no").agg(F.sum("n").alias("n")).collect()}
        rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("factor"), "x"))
        examples: dict[int, list[float]] = {}
        for r in odd.withColumn("rank", rank).filter(F.col("rank") <= _EXAMPLES).select("no", "x").collect():
            examples.setdefault(r["no"], []).append(r["x"])
    finally:
        for df in (scored, ranged):
            if df is not None:
                df.unpersist()
    # One row a column.
    return at.spark.createDataFrame([(no, totals[no], n, sorted(examples[no])) for no, n in found.items()], schema)


def model_outlier(
    df: DataFrame | Target,
    cols=None,
    model: str = "isolation_forest",
    contamination: float = CONTAMINATION,
    max_ratio: float = MAX_RATIO,
    min_anomalies: int = MIN_ANOMALIES,
    max_samples: int = MAX_SAMPLES,
    trees: int = TREES,
    seed: int = 42,
    known: dict | None = None,
    freq: DataFrame | None = None,
) -> DataFrame:
    """Values a univariate model isolates; nothing when they are too many to be outliers.

    With a frequency table at hand each distinct value is scored once.  ``max_samples`` bounds what a
    forest is grown on; the local outlier factor takes all values.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    at = target(df)
    names = numeric_columns(at.df, cols)
    counts = known if known is not None else spans(at.df, names)
    names = [c for c in names if counts[c][2] >= MIN_VALUES]
    out = empty(at.spark)
    for i in range(0, len(names), _COLUMNS_PER_JOB):
        part = names[i : i + _COLUMNS_PER_JOB]
        if model == "isolation_forest":
            found = _isolation(at, part, counts, trees, contamination, max_samples, seed, freq)
        else:
            found = _neighbours(at, part, contamination, freq)
        ratio = F.col("anomalies") / F.col("total")
        found = found.filter((F.col("anomalies") >= min_anomalies) & (ratio <= max_ratio))
        name = F.get(F.array(*[F.lit(c) for c in part]), F.col("no"))
        out = out.unionByName(
            found.select(
                *candidate(
                    at,
                    issue_type="model_outlier",
                    detector_id="model_outlier",
                    columns=F.array(name),
                    affected=F.col("anomalies"),
                    raw=F.col("anomalies"),
                    confidence=0.7,
                    fpr=0.3,
                    severity="low",
                    evidence=evidence_json(
                        "statistical_measure",
                        {
                            "model": model,
                            "anomaly_count": F.col("anomalies"),
                            "anomaly_ratio": F.round(ratio, 6),
                            "total_values": F.col("total"),
                            "examples": F.transform("examples", lambda v: F.round(v, 4)),
                        },
                    ),
                )
            )
        )
    return out


DETECTORS = {"model_outlier": model_outlier}
