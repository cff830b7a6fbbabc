"""Numeric outlier detectors.

Quantiles, deviations and the counts outside the bounds made of them come from two reads of the table for
all numeric columns together (``operators/brackets``); histograms ride on the second one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.functions.columns import col, numeric_columns
from veritable.operators.brackets import Found, Outliers, as_value, resolve
from veritable.operators.checks import (
    ROWS,
    Check,
    Target,
    candidate,
    empty,
    evidence_json,
    report,
    run_checks,
    target,
)
from veritable.operators.quantiles import exact_quantiles, value_spans

# ---- fixed values: thresholds ----------------------------------------------
LOWER_K, UPPER_K = 1.5, 3.0
LOW_P, HIGH_P = 0.001, 0.999
MAD_SCALE, MAD_LIMIT = 0.6745, 3.5
MINIMUM = 0.0
BINS, BIN_RATIO = 20, 1e-5
# ---- end of fixed values ----------------------------------------------------

PROBS = (LOW_P, 0.25, 0.5, 0.75, HIGH_P)
STATISTICAL = "statistical_measure"


def column_quantiles(df: DataFrame, names: Sequence[str], **how) -> dict[str, dict[float, float]]:
    found = exact_quantiles(df, {c: col(c) for c in names}, PROBS, **how)
    return {c: dict(zip(PROBS, q)) for c, q in found.items() if q[0] is not None}


def outliers(limit: float = MAD_LIMIT) -> Outliers:
    return Outliers(LOWER_K, UPPER_K, LOW_P, HIGH_P, MAD_SCALE, limit)


def resolved(df: DataFrame, names: Sequence[str], limit: float = MAD_LIMIT, **known) -> dict[str, Found]:
    """Quantiles, deviations and outlier counts of numeric columns, from two reads of the table."""
    found = resolve(df, {c: as_value(col(c)) for c in names}, PROBS, outliers(limit), **known)
    return {c: f for c, f in found.items() if f.rows}


def quantiles_of(found: Mapping[str, Found]) -> dict[str, dict[float, float]]:
    return {c: dict(zip(PROBS, f.quantiles)) for c, f in found.items()}


def outlier_counts(found: Mapping[str, Found], detectors: Sequence[str], limit: float = MAD_LIMIT) -> list[tuple[Check, int]]:
    """The checks of D26-D28 with their counts."""
    q, out = quantiles_of(found), []
    if "iqr_outlier" in detectors:
        out += [(c, found[c.columns[0]].outside_fences) for c in iqr_checks(q)]
    if "percentile_outlier" in detectors:
        out += [(c, found[c.columns[0]].outside_quantiles) for c in percentile_checks(q)]
    if "modified_zscore" in detectors:
        medians, mads = {c: v[0.5] for c, v in q.items()}, {c: f.mad for c, f in found.items()}
        out += [(c, found[c.columns[0]].far) for c in zscore_checks(medians, mads, limit)]
    return out


def counted(at: Target, rows: int, counts: Sequence[tuple[Check, int]]) -> DataFrame:
    """Candidates of checks that were counted already."""
    if not counts:
        return empty(at.spark)
    names = [ROWS, *(f"hit{i}" for i in range(len(counts)))]
    one = at.spark.createDataFrame([(rows, *(n for _, n in counts))], ", ".join(f"{n} bigint" for n in names))
    return report(at, one, [c for c, _ in counts])


def _outside(name: str, lower: float, upper: float):
    c = col(name)
    return (c < F.lit(lower)) | (c > F.lit(upper))


def iqr_checks(quantiles, lower_k=LOWER_K, upper_k=UPPER_K) -> list[Check]:
    out = []
    for c, q in quantiles.items():
        q25, q75 = q[0.25], q[0.75]
        iqr = q75 - q25
        if not iqr > 0:
            continue
        lower, upper = q25 - lower_k * iqr, q75 + upper_k * iqr
        out.append(
            Check(
                "iqr_outlier",
                (c,),
                _outside(c, lower, upper),
                confidence=0.9,
                severity="medium",
                evidence={"q25": q25, "q75": q75, "iqr": iqr, "lower": lower, "upper": upper},
                evidence_type=STATISTICAL,
            )
        )
    return out


def percentile_checks(quantiles) -> list[Check]:
    return [
        Check(
            "percentile_outlier",
            (c,),
            _outside(c, q[LOW_P], q[HIGH_P]),
            confidence=0.9,
            severity="medium",
            evidence={"p0_1": q[LOW_P], "p99_9": q[HIGH_P]},
            evidence_type=STATISTICAL,
        )
        for c, q in quantiles.items()
    ]


def zscore_checks(medians, mads, limit=MAD_LIMIT) -> list[Check]:
    return [
        Check(
            "modified_zscore",
            (c,),
            F.abs(col(c) - F.lit(medians[c])) > F.lit(MAD_SCALE * mads[c] * limit),
            confidence=0.8,
            severity="medium",
            evidence={"median": medians[c], "mad": mads[c], "threshold": limit},
            evidence_type=STATISTICAL,
        )
        for c in medians
        if mads.get(c)
    ]


def tail_checks(df: DataFrame, cols=None, minimum: float = MINIMUM) -> list[Check]:
    return [
        Check(
            "tail_probability",
            (c,),
            col(c) < F.lit(minimum),
            confidence=0.95,
            severity="medium",
            evidence={"min_value": minimum},
            evidence_type="constraint_violation",
        )
        for c in numeric_columns(df, cols)
    ]


def _outliers(df: DataFrame | Target, detector: str, cols, approx: bool, limit: float = MAD_LIMIT) -> DataFrame:
    at = target(df)
    names = numeric_columns(at.df, cols)
    if not approx:
        rows = at.df.count()
        return counted(at, rows, outlier_counts(resolved(at.df, names, limit), [detector], limit))
    q = column_quantiles(at.df, names, approx=True)
    if detector == "iqr_outlier":
        return run_checks(at, iqr_checks(q))
    if detector == "percentile_outlier":
        return run_checks(at, percentile_checks(q))
    medians = {c: v[0.5] for c, v in q.items()}
    return run_checks(at, zscore_checks(medians, approximate_deviations(at.df, medians), limit))


def approximate_deviations(df: DataFrame, medians: Mapping[str, float]) -> dict[str, float]:
    """Median absolute deviation per column, from a sketch."""
    spread = {c: F.abs(col(c).cast("double") - F.lit(m)) for c, m in medians.items()}
    return {c: q[0] for c, q in exact_quantiles(df, spread, [0.5], approx=True).items()}


def iqr_outlier(df: DataFrame | Target, cols=None, approx: bool = False) -> DataFrame:
    """Outside [q25 - 1.5 IQR, q75 + 3 IQR]."""
    return _outliers(df, "iqr_outlier", cols, approx)


def percentile_outlier(df: DataFrame | Target, cols=None, approx: bool = False) -> DataFrame:
    """Below P0.1 or above P99.9."""
    return _outliers(df, "percentile_outlier", cols, approx)


def modified_zscore(df: DataFrame | Target, cols=None, limit=MAD_LIMIT, approx: bool = False) -> DataFrame:
    """Further than 0.6745 * 3.5 * MAD from the median."""
    return _outliers(df, "modified_zscore", cols, approx, limit)


def tail_probability(df: DataFrame | Target, cols=None, minimum: float = MINIMUM) -> DataFrame:
    """Below a physical minimum."""
    at = target(df)
    return run_checks(at, tail_checks(at.df, cols, minimum))


def spans(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float, int]]:
    """Minimum, maximum and non-null rows per numeric column."""
    return value_spans(df, {c: col(c).cast("double") for c in names}) if names else {}


def histogram_steps(known: Mapping[str, tuple], bins: int = BINS, min_ratio: float = BIN_RATIO) -> dict[str, tuple[float, float, int]]:
    """Start, width and least frequency of the bins of each column that can have rare ones."""
    usable = {
        c: (lo, (hi - lo) / bins, max(1, int(n * min_ratio)))
        for c, (lo, hi, n) in known.items()
        if n and 0 < (hi - lo) / bins < float("inf")
    }
    # A bin holding at least one row is never below a limit of one.
    return {c: v for c, v in usable.items() if v[2] > 1}


def histogram_rarity(
    df: DataFrame | Target,
    cols=None,
    bins: int = BINS,
    min_ratio: float = BIN_RATIO,
    known=None,
    counts: Mapping[str, Mapping[int, int]] | None = None,
) -> DataFrame:
    """Equal-width bins holding very few rows (the maximum falls in its own bin).

    ``counts`` are the rows in each bin of each column where they are known.
    """
    at = target(df)
    known = known if known is not None else spans(at.df, numeric_columns(at.df, cols))
    usable = histogram_steps(known, bins, min_ratio)
    if not usable:
        return empty(at.spark)

    def of(values):
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("no"))

    if counts is None:
        cells = [
            F.struct(
                F.lit(i).alias("no"),
                F.floor((col(c).cast("double") - F.lit(lo)) / F.lit(width)).alias("bin"),
            )
            for i, (c, (lo, width, _)) in enumerate(usable.items())
        ]
        counted_bins = at.df.select(F.inline(F.array(*cells))).filter("bin is not null").groupBy("no", "bin").agg(F.count(F.lit(1)).alias("n"))
    else:
        # At most ``bins`` + 1 rows per column.
        local = [(i, b, n) for i, c in enumerate(usable) for b, n in counts.get(c, {}).items()]
        counted_bins = at.spark.createDataFrame(local, "no int, bin bigint, n bigint")
    limits = of([v[2] for v in usable.values()])
    rare = counted_bins.filter(F.col("n") < limits)
    # At most ``bins`` + 1 rows per column.
    return (
        rare.groupBy("no")
        .agg(
            F.sum("n").alias("affected"),
            F.count(F.lit(1)).alias("rare"),
            F.sort_array(F.collect_list(F.struct("n", "bin"))).alias("rare_bins"),
        )
        .select(
            *candidate(
                at,
                issue_type="histogram_rarity",
                detector_id="histogram_rarity",
                columns=F.array(of(usable)),
                affected=F.col("affected"),
                raw=F.col("rare"),
                confidence=0.85,
                fpr=0.1,
                severity="medium",
                evidence=evidence_json(
                    STATISTICAL,
                    {
                        "n_bins": bins,
                        "bin_width": of([v[1] for v in usable.values()]),
                        "min_frequency": limits,
                        "rare_bins": F.col("rare_bins"),
                    },
                ),
            )
        )
    )


DETECTORS = {
    "iqr_outlier": iqr_outlier,
    "modified_zscore": modified_zscore,
    "tail_probability": tail_probability,
    "percentile_outlier": percentile_outlier,
    "histogram_rarity": histogram_rarity,
}
