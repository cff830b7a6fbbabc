"""Exact quantiles, deviations and outlier counts of many columns from two reads of a table.

The first read keeps a KLL sketch of each column.  Its quantiles cut a column into
cells of about equal counts, and interval arithmetic over the cells tells where everything wanted can lie: a
quantile between two values, a fence made of quantiles between two others, the median deviation and the score
limit made of it likewise.  Only values inside these zones matter one by one; of all others it is enough to know how many lie
between which zones.  The second read counts just that: a row for each distinct value in a zone, and one for each gap.

With exact counts the same arithmetic is done again.  When every interval has shrunk to a point, the results are
those of a full sort.  A sketch may miss its bound once in a hundred times; then some interval lies in a gap, and
the gap becomes a zone of another read.  Zones that hold more than ``LISTED`` distinct values are cut at quantiles of their
own and counted in cells first, on the zones' rows and no longer on the table, until what is left is small.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, its cells, and the share of rows by which its ranks may be off.
SKETCH_K, GRID, SLACK = 2048, 256, 0.003
#: Distinct values that are read one by one, and cells of a zone that holds more.
LISTED, ZONE_CELLS = 500_000, 256


@dataclass(frozen=True)
class Outliers:
    """What is counted beyond the quantiles: values outside fences around the quartiles, outside two quantiles, and far
    from the median in units of the median deviation."""

    lower_k: float
    upper_k: float
    low_p: float
    high_p: float
    scale: float
    limit: float


@dataclass
class Found:
    rows: int
    quantiles: list[float | None]
    mad: float | None = None
    outside_fences: int = 0
    outside_quantiles: int = 0
    far: int = 0
    bins: dict[int, int] = field(default_factory=dict)


def as_value(c: Column) -> Column:
    """A double that sorts as Spark does: what is not a number counts as infinite."""
    x = c.cast("double")
    return F.when(F.isnan(x), F.lit(math.inf)).otherwise(x)


def _limits(x: Column, cells: int) -> Column:
    """The limits of ``cells`` cells of about equal counts, as an aggregate."""
    steps = F.expr("array(" + ", ".join(f"{i / cells}D" for i in range(cells + 1)) + ")")
    return F.call_function("kll_sketch_get_quantile_double", F.kll_sketch_agg_double(x, SKETCH_K), steps)


def sketches_of(df: DataFrame, values: Mapping[str, Column]) -> dict[str, tuple[int, Sequence[float] | None]]:
    """Rows and cell limits of each expression, from one read.

    An aggregate of its own: beside sketches Spark would not compile the other aggregates.
    """
    named = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values.values())))
    row = named.agg(
        *(F.count(f"v{i}").alias(f"n{i}") for i in range(len(values))),
        *(F.when(F.count(f"v{i}") > 0, _limits(F.col(f"v{i}"), GRID)).alias(f"s{i}") for i in range(len(values))),
    ).first()
    return {k: (row[f"n{i}"], row[f"s{i}"]) for i, k in enumerate(values)}


class Cells:
    """Ranges of values in order, each with a count: single values, or what lies between two."""

    def __init__(self, lo, hi, n, slack: float = 0.0):
        self.lo, self.hi = np.asarray(lo, float), np.asarray(hi, float)
        self.n = np.asarray(n)
        self.rows, self.slack = self.n.sum(), slack

    def kth(self, values: np.ndarray, k: float) -> float:
        order = np.argsort(values, kind="stable")
        at = np.searchsorted(np.cumsum(self.n[order]), min(max(k, 0), self.rows - 1), side="right")
        return float(values[order[min(at, len(order) - 1)]])

    def quantile(self, lo: np.ndarray, hi: np.ndarray, p: float, rows: int, slack: float) -> tuple[float, float, float, float]:
        """Between which values the interpolated quantile of ``rows`` values, each in [lo, hi], lies, and between which
        the two values that it is made of."""
        pos = (rows - 1) * p
        low, high = math.floor(pos), math.ceil(pos)

        def mixed(values, off):
            a, b = self.kth(values, low + off), self.kth(values, high + off)
            return a, b, a if low == high or a == b else (high - pos) * a + (pos - low) * b

        (first, _, least), (_, last, most) = mixed(lo, -slack), mixed(hi, slack)
        return least, most, first, last

    def spread(self, m: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """How far from the median the values of each cell are, at least and at most."""
        with np.errstate(invalid="ignore"):
            least = np.maximum(np.maximum(self.lo - m[1], m[0] - self.hi), 0.0)
            most = np.maximum(self.hi - m[0], m[1] - self.lo)
        # An infinite value is nowhere near an infinite median, by convention.
        return np.where(np.isnan(least), 0.0, least), np.where(np.isnan(most), np.inf, most)


@dataclass
class _State:
    """Intervals of all wanted numbers, and the cells that keep them from being points."""

    quantiles: list[tuple[float, float]]
    mad: tuple[float, float] | None
    counts: list[tuple[int, int]]
    open: np.ndarray


def _span(*values: float) -> tuple[float, float]:
    """Least and most of some bounds; undefined ones (of infinities) do not bound."""
    real = [v for v in values if not math.isnan(v)]
    return (min(real), max(real)) if len(real) == len(values) else (-math.inf, math.inf)


def _evaluate(cells: Cells, rows: int, probs: Sequence[float], want: Outliers | None, every: bool) -> _State:
    """``every``: mark all cells that decide, not only those that leave something open (counts are estimates)."""
    open_ = np.zeros(len(cells.lo), bool)
    single = cells.lo == cells.hi

    def mark(inside: np.ndarray, settled: bool) -> None:
        nonlocal open_
        if every or not settled:
            open_ |= inside if every else inside & ~single

    def quantile(p):
        low, high, first, last = cells.quantile(cells.lo, cells.hi, p, rows, cells.slack)
        mark((cells.hi >= first) & (cells.lo <= last), low == high)
        return low, high

    quantiles = [quantile(p) for p in probs]
    if want is None:
        return _State(quantiles, None, [], open_)

    def counted(certain: np.ndarray, possible: np.ndarray) -> tuple[int, int]:
        mark(possible & ~certain, not (possible & ~certain).any())
        return cells.n[certain].sum(), cells.n[possible].sum()

    def outside(low: tuple[float, float], high: tuple[float, float]) -> tuple[int, int]:
        certain = (cells.hi < low[0]) | (cells.lo > high[1])
        possible = (cells.lo < low[1]) | (cells.hi > high[0])
        return counted(certain, possible)

    q25, q50, q75 = (quantile(p) for p in (0.25, 0.5, 0.75))
    with np.errstate(invalid="ignore"):
        iqr = _span(q75[0] - q25[1], q75[1] - q25[0])
        lower = _span(q25[0] - want.lower_k * iqr[1], q25[1] - want.lower_k * iqr[0])
        upper = _span(q75[0] + want.upper_k * iqr[0], q75[1] + want.upper_k * iqr[1])
        counts = [outside(lower, upper), outside(quantile(want.low_p), quantile(want.high_p))]
        least, most = cells.spread(q50)
        *mad, first, last = cells.quantile(least, most, 0.5, rows, 2 * cells.slack)
        mark((most >= first) & (least <= last), mad[0] == mad[1])
        reach = [want.scale * d * want.limit for d in mad]
        counts.append(counted(least > reach[1], most > reach[0]))
    return _State(quantiles, (mad[0], mad[1]), counts, open_)


def _zones(cells: Cells, marked: np.ndarray) -> list[tuple[float, float]]:
    """The ranges of marked cells, touching ones as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(zip(cells.lo[marked].tolist(), cells.hi[marked].tolist())):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _placed(x: Column, no: Column, zones: Sequence[Sequence[tuple[float, float]]]) -> tuple[Column, Column]:
    """How many zones of its column lie below ``x``, and ``x`` itself where it lies in one.

    The limits are looked up by the column's number, so the expression is as small for many columns as for one.
    """
    gap, inside = F.lit(0), F.lit(False)
    for k in range(max(map(len, zones), default=0)):
        # A zone that is not there lies above everything and holds nothing.
        own = [z[k] if k < len(z) else (math.inf, -math.inf) for z in zones]
        above = [z[k][1] if k < len(z) else math.inf for z in zones]
        lo, hi, top = (F.get(_numbers(v), no) for v in ([z[0] for z in own], [z[1] for z in own], above))
        gap = gap + (x > top).cast("int")
        inside = inside | ((x >= lo) & (x <= hi))
    return gap, F.when(inside, x)


def _numbers(values: Sequence[float]) -> Column:
    names = {math.inf: "double('Infinity')", -math.inf: "double('-Infinity')"}
    return F.expr("array(" + ", ".join(names.get(v) or f"{v!r}D" for v in map(float, values)) + ")")


_GROUP = ("no", "gap", "x")


def _from_source(df: DataFrame, values: Sequence[Column], zones: Sequence, bins: Sequence) -> DataFrame:
    """``no, gap, x, bin, lo, hi, n``: every column's values, single in zones and counted in gaps."""
    named = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    cells = F.array(*(F.struct(F.lit(i).alias("no"), F.col(f"v{i}").alias("v")) for i in range(len(values))))
    rows = named.select(F.inline(cells)).filter(F.col("v").isNotNull())
    gap, key = _placed(F.col("v"), F.col("no"), zones)
    bin_ = F.lit(None).cast("bigint")
    if any(bins):
        start, width = (F.get(_numbers([b[i] if b else math.inf for b in bins]), F.col("no")) for i in (0, 1))
        bin_ = F.when(width < math.inf, F.floor((F.col("v") - start) / width))
    rows = rows.select("no", gap.alias("gap"), key.alias("x"), bin_.alias("bin"), "v")
    return rows.groupBy(*_GROUP, "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))


def _narrowed(table: DataFrame, zones: Sequence) -> DataFrame:
    """The single values of a counted table that lie in narrower zones."""
    gap, key = _placed(F.col("x"), F.col("no"), zones)
    return table.withColumns({"gap": gap, "x": key}).withColumn("bin", F.lit(None).cast("bigint")).filter(F.col("x").isNotNull())


def _in_cells(table: DataFrame) -> DataFrame:
    """``no, lo, hi, n``: the values of a zone in up to ``ZONE_CELLS`` cells between quantiles of its distinct values."""
    single = table.filter(F.col("x").isNotNull())
    # A row a zone, some twenty a column.
    edges = single.groupBy("no", "gap").agg(_limits(F.col("x"), ZONE_CELLS).alias("limits"))
    cell = F.size(F.filter("limits", lambda e: e < F.col("x")))
    told = single.join(F.broadcast(edges), ["no", "gap"]).withColumn("cell", cell)
    told = told.groupBy("no", "gap", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    between = table.filter(F.col("x").isNull()).groupBy("no", "gap").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return told.select("no", "lo", "hi", "n", F.lit(False).alias("between")).unionByName(between.select("no", "lo", "hi", "n", F.lit(True).alias("between")))


class _Known:
    """The cells of a column so far; ``between`` are those of values that were counted only as lying between zones."""

    def __init__(self, told) -> None:
        told = told.sort_values(["lo", "hi"])
        self.cells = Cells(told["lo"], told["hi"], told["n"].to_numpy(np.int64))
        self.between = told["between"].to_numpy(bool)

    def finer(self, told, opened: np.ndarray) -> None:
        """Put what was read in the place of the opened cells."""
        told = told[~told["between"].to_numpy(bool)]
        c = self.cells
        lo, hi, n = (np.concatenate([old[~opened], told[k].to_numpy(old.dtype)]) for old, k in ((c.lo, "lo"), (c.hi, "hi"), (c.n, "n")))
        between = np.concatenate([self.between[~opened], np.zeros(len(told), bool)])
        order = np.lexsort((hi, lo))
        self.cells, self.between = Cells(lo[order], hi[order], n[order]), between[order]


def resolve(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Sequence[float],
    outliers: Outliers | None = None,
    *,
    sketches: Mapping[str, tuple[int, Sequence[float] | None]] | None = None,
    bins: Mapping[str, tuple[float, float]] | None = None,
) -> dict[str, Found]:
    """All of it for each named expression (``as_value`` ones); NULLs are skipped.

    ``sketches`` (what ``sketches_of`` returned) save the first read.  ``bins`` (start and width) ask for counts in bins of equal
    width, which the same read gives.
    """
    if not values:
        return {}
    sketches = sketches_of(df, values) if sketches is None else sketches
    names = [k for k in values if sketches[k][0]]
    found = {k: Found(0, [None] * len(probs)) for k in values}
    if not names:
        return found
    rows = [sketches[k][0] for k in names]
    zones = []
    for k, n in zip(names, rows):
        limits = np.array(sketches[k][1], float)
        guess = Cells(limits[:-1], limits[1:], np.full(GRID, n / GRID), SLACK * n + 1)
        zones.append(_zones(guess, _evaluate(guess, n, probs, outliers, True).open))
    steps = [(bins or {}).get(k) for k in names]
    columns = [values[k] for k in names]
    source, table, held, known, states = True, df, [], [], []
    try:
        while True:
            if source:
                table = _from_source(df, columns, zones, [None] * len(names) if known else steps).persist(StorageLevel.MEMORY_AND_DISK)
                held.append(table)
            else:
                table = _narrowed(table, zones)
            few = table.count() <= LISTED
            if few:
                told = table.toArrow().to_pandas()
                told["between"] = told["x"].isna()
                counted = told.dropna(subset=["bin"]).groupby(["no", "bin"], as_index=False)["n"].sum().to_dict("records")
                # What was told apart by bins only is one.
                told = told.groupby(["no", "gap", "x"], dropna=False, as_index=False).agg({"lo": "min", "hi": "max", "n": "sum", "between": "first"})
            else:
                if bins and not known:
                    counted = table.filter("bin IS NOT NULL").groupBy("no", "bin").agg(F.sum("n").alias("n")).collect()
                if source:
                    table = table.groupBy(*_GROUP).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
                told = _in_cells(table).toArrow().to_pandas()
            if bins and not known:
                for r in counted:
                    found[names[r["no"]]].bins[int(r["bin"])] = int(r["n"])
            parts = [told[told["no"] == i] for i in range(len(names))]
            if known:
                for k, part, state in zip(known, parts, states):
                    k.finer(part, state.open)
            else:
                known = [_Known(part) for part in parts]
            states = [_evaluate(k.cells, n, probs, outliers, False) for k, n in zip(known, rows)]
            if not any(s.open.any() for s in states):
                break
            # What is open inside zones is looked at more closely first, as that may settle the rest; a gap needs another read.
            source = not any((s.open & ~k.between).any() for s, k in zip(states, known))
            for s, k in zip(states, known):
                s.open &= source | ~k.between
            zones = [_zones(k.cells, s.open) for s, k in zip(states, known)]
    finally:
        for h in held:
            h.unpersist()
    for k, n, s in zip(names, rows, states):
        f = found[k]
        f.rows, f.quantiles = n, [q[0] for q in s.quantiles]
        if outliers is not None:
            f.mad = s.mad[0]
            f.outside_fences, f.outside_quantiles, f.far = (int(c[0]) for c in s.counts)
    return found
