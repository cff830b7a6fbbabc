"""Exact quantiles and order statistics that never gather a column in one task.

Quantiles of columns are bracketed by sketches (``operators/brackets``).  Order statistics of one expression, as
samples need them, are located by counting: one aggregate counts the values in equal-width bins, only
the bins that hold a wanted rank are split again, and bins that have become
small are listed.  Counts are exact at every step, so the result is too; a pass
returns a bounded number of bins and combines on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.operators.brackets import as_value, resolve
from veritable.operators.checks import one_row

LISTED_ROWS = 5_000
_FIRST_BINS, _LATER_BINS = 4096, 256
_EDGES = [i / 64 for i in range(65)]
_ACCURACY = 10_000


@dataclass(frozen=True)
class _Bracket:
    """Values of one expression in [lo, hi], of which ``below`` rows lie before."""

    name: str
    lo: float
    hi: float
    below: int
    ranks: tuple[int, ...]
    edges: tuple[float, ...] | None = None


def _bin(x: Column, b: _Bracket, bins: int) -> Column:
    """Monotone bin number of ``x`` inside a bracket."""
    if b.edges is not None:
        # Each edge is a bin of its own, so one very frequent value cannot hide others.
        marks = [(x > e).cast("bigint") + (x >= e).cast("bigint") for e in b.edges]
        return reduce(lambda p, q: p + q, marks)
    width = b.hi - b.lo
    if not 0 < width < math.inf:
        return F.lit(0).cast("bigint")
    return F.least(F.floor((x - F.lit(b.lo)) / F.lit(width) * F.lit(bins)), F.lit(bins - 1))


def _cells(
    df: DataFrame, values: Mapping[str, Column], brackets: Sequence[_Bracket], bins: int | None
) -> DataFrame:
    """``(no, bin, x)`` for each value inside a bracket; ``bins`` None leaves out ``bin``."""
    by_name: dict[str, list[tuple[int, _Bracket]]] = {}
    for no, b in enumerate(brackets):
        by_name.setdefault(b.name, []).append((no, b))
    cells = []
    for name, members in by_name.items():
        x = values[name]
        no, at = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for i, b in members:
            hit = x.between(F.lit(b.lo), F.lit(b.hi))
            no = F.when(hit, F.lit(i)).otherwise(no)
            if bins:
                at = F.when(hit, _bin(x, b, bins)).otherwise(at)
        cells.append(F.struct(no.alias("no"), at.alias("bin"), x.alias("x")))
    return df.select(F.inline(F.array(*cells))).filter("no is not null")


def _split(brackets, counted, listed_rows):
    """Where each bracket's ranks fall: found values, bins to list, bins to split again."""
    found: dict[tuple[str, int], float] = {}
    small: list[_Bracket] = []
    large: list[tuple[_Bracket, bool]] = []
    per_bracket: dict[int, list] = {}
    for row in counted:
        per_bracket.setdefault(row["no"], []).append(row)
    for no, rows in per_bracket.items():
        b = brackets[no]
        total, below = sum(r["n"] for r in rows), b.below
        for r in sorted(rows, key=lambda r: r["bin"]):
            ranks = tuple(k for k in b.ranks if below <= k < below + r["n"])
            if ranks and r["lo"] == r["hi"]:
                found.update({(b.name, k): r["lo"] for k in ranks})
            elif ranks:
                part = _Bracket(b.name, r["lo"], r["hi"], below, ranks)
                if r["n"] <= listed_rows:
                    small.append(part)
                else:
                    large.append((part, r["n"] > total / 2))
            below += r["n"]
    return found, small, large


def _with_edges(df, values, large) -> list[_Bracket]:
    """Split a bracket that equal-width bins barely reduced at its approximate quantiles."""
    stuck = [b for b, slow in large if slow]
    if not stuck:
        return [b for b, _ in large]
    row = one_row(
        df.agg(
            *[
                F.percentile_approx(
                    F.when(values[b.name].between(b.lo, b.hi), values[b.name]), _EDGES, _ACCURACY
                ).alias(f"e{i}")
                for i, b in enumerate(stuck)
            ]
        )
    )
    edged = [
        _Bracket(b.name, b.lo, b.hi, b.below, b.ranks, tuple(dict.fromkeys(row[f"e{i}"])))
        for i, b in enumerate(stuck)
    ]
    return [b for b, slow in large if not slow] + edged


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    spans: Mapping[str, tuple[float, float]],
    ranks: Mapping[str, Sequence[int]],
    listed_rows: int = LISTED_ROWS,
) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank; ``spans`` need only enclose the values."""
    brackets = [_Bracket(k, *spans[k], 0, tuple(sorted(set(r)))) for k, r in ranks.items()]
    found: dict[tuple[str, int], float] = {}
    small: list[_Bracket] = []
    bins = _FIRST_BINS
    while brackets:
        counted = (
            _cells(df, values, brackets, bins)
            .groupBy("no", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect()
        )
        hits, listed, large = _split(brackets, counted, listed_rows)
        found.update(hits)
        small += listed
        brackets = _with_edges(df, values, large)
        bins = _LATER_BINS
    if small:
        runs: dict[int, list[tuple[float, int]]] = {}
        # At most ``listed_rows`` rows per bracket were counted above.
        for r in _cells(df, values, small, None).groupBy("no", "x").count().collect():
            runs.setdefault(r["no"], []).append((r["x"], r["count"]))
        for no, pairs in runs.items():
            b, at = small[no], small[no].below
            for x, n in sorted(pairs):
                found.update({(b.name, k): x for k in b.ranks if at <= k < at + n})
                at += n
    return found


def value_spans(df: DataFrame, values: Mapping[str, Column]) -> dict[str, tuple]:
    """(minimum, maximum, non-null rows) of each expression."""
    row = one_row(
        df.agg(
            *[F.min(v).alias(f"lo{i}") for i, v in enumerate(values.values())],
            *[F.max(v).alias(f"hi{i}") for i, v in enumerate(values.values())],
            *[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())],
        )
    )
    return {k: (row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"]) for i, k in enumerate(values)}


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Sequence[float],
    *,
    approx: bool = False,
) -> dict[str, list[float | None]]:
    """Quantiles of each named expression, linearly interpolated, NULLs skipped.

    ``approx`` answers from one sketch pass instead of two reads.
    """
    names, probs = list(values), list(probs)
    unknown: list[float | None] = [None] * len(probs)
    if not names:
        return {}
    if not approx:
        return {k: f.quantiles for k, f in resolve(df, {k: as_value(v) for k, v in values.items()}, probs).items()}
    row = one_row(
        df.agg(*[F.percentile_approx(v.cast("double"), probs, _ACCURACY).alias(f"q{i}") for i, v in enumerate(values.values())])
    )
    return {k: list(row[f"q{i}"] or unknown) for i, k in enumerate(names)}
