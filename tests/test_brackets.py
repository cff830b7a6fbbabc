"""Exact quantiles, deviations, counts and bins against numpy, on few reads, at every path."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.operators import brackets
from veritable.operators.brackets import Outliers, as_value, resolve

PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
WANT = Outliers(1.5, 3.0, 0.001, 0.999, 0.6745, 3.5)


def plain(x):
    def quantile(v, p):
        v = np.sort(v)
        pos = (len(v) - 1) * p
        a, b = v[math.floor(pos)], v[math.ceil(pos)]
        return a if a == b else (math.ceil(pos) - pos) * a + (pos - math.floor(pos)) * b

    q = [quantile(x, p) for p in PROBS]
    q25, m, q75 = (quantile(x, p) for p in (0.25, 0.5, 0.75))
    lower, upper = q25 - 1.5 * (q75 - q25), q75 + 3 * (q75 - q25)
    mad = quantile(np.abs(x - m), 0.5)
    low, high = quantile(x, 0.001), quantile(x, 0.999)
    return q, mad, [int(c.sum()) for c in ((x < lower) | (x > upper), (x < low) | (x > high), np.abs(x - m) > 0.6745 * mad * 3.5)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 20_000
    return {
        "normal": rng.standard_normal(n), "heavy": np.exp(rng.standard_normal(n) * 4), "few": rng.integers(0, 7, n).astype(float),
        "constant": np.full(n, 2.5), "mostly": np.where(rng.random(n) < 0.9, 0.0, rng.standard_normal(n)), "signed": rng.standard_cauchy(n) ** 3,
        "wide": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n), "steps": np.round(rng.standard_normal(n), 1), "hole": np.where(np.arange(n) % 3 == 0, np.nan, rng.random(n)),
    }


@pytest.fixture(scope="module")
def table(spark, data):
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(data)).withColumn("hole", F.when(~F.isnan("hole"), F.col("hole"))).withColumn("none", F.lit(None).cast("double"))
    return df.repartition(8).persist()


def same(found, data):
    for name, x in data.items():
        x = x[~np.isnan(x)]
        q, mad, counts = plain(x)
        f = found[name]
        assert f.rows == len(x), name
        assert f.quantiles == q, name
        assert f.mad == mad, name
        assert [f.outside_fences, f.outside_quantiles, f.far] == counts, name
    assert found["none"].rows == 0 and found["none"].quantiles == [None] * len(PROBS)


def values(df):
    return {c: as_value(F.col(c)) for c in df.columns}


def test_equal_to_a_full_sort(table, data):
    same(resolve(table, values(table), PROBS, WANT), data)


def test_narrowing_without_another_read(table, data, monkeypatch):
    """Zones of more distinct values than are read one by one are narrowed on their own rows."""
    monkeypatch.setattr(brackets, "LISTED", 400)
    monkeypatch.setattr(brackets, "ZONE_CELLS", 16)
    reads = []
    real = brackets._from_source
    monkeypatch.setattr(brackets, "_from_source", lambda *a: reads.append(1) or real(*a))
    same(resolve(table, values(table), PROBS, WANT), data)
    assert len(reads) == 1


def test_a_sketch_that_misses_costs_another_read(table, data, monkeypatch):
    monkeypatch.setattr(brackets, "SLACK", 0.0)
    monkeypatch.setattr(brackets, "SKETCH_K", 16)
    reads = []
    real = brackets._from_source
    monkeypatch.setattr(brackets, "_from_source", lambda *a: reads.append(1) or real(*a))
    same(resolve(table, values(table), PROBS, WANT), data)
    assert len(reads) > 1


def test_bins_ride_along(table, data):
    bins = {"normal": (-5.0, 0.5), "few": (0.0, 0.3)}
    found = resolve(table, values(table), [0.5], bins=bins)
    for name, (lo, width) in bins.items():
        at, n = np.unique(np.floor((data[name] - lo) / width), return_counts=True)
        assert found[name].bins == dict(zip(at.astype(int).tolist(), n.tolist()))


def test_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 5.0, 1), (nan, None, 2), (inf, None, None), (-inf, None, 4), (2.0, None, 5)], "a double, b double, c int")
    found = resolve(df, {c: as_value(F.col(c)) for c in df.columns}, [0.0, 0.5, 1.0], WANT)
    # What is not a number counts as infinite.
    assert found["a"].quantiles == [-inf, 2.0, inf] and found["a"].rows == 5
    assert found["b"].quantiles == [5.0, 5.0, 5.0] and found["b"].mad == 0.0
    assert found["c"].quantiles == [1.0, 3.0, 5.0] and found["c"].mad == 1.5
    assert resolve(df.limit(0), {"b": as_value(F.col("b"))}, [0.5])["b"].quantiles == [None]
    assert resolve(df, {}, [0.5]) == {}


def test_a_hot_value_is_one_row_in_its_zone(spark):
    df = spark.range(200_000).selectExpr("IF(id % 3 = 0, 7.0D, CAST(id AS DOUBLE)) AS x")
    found = resolve(df, {"x": as_value(F.col("x"))}, PROBS, WANT)["x"]
    x = np.arange(200_000.0)
    x[::3] = 7.0
    q, mad, counts = plain(x)
    assert found.quantiles == q and found.mad == mad and [found.outside_fences, found.outside_quantiles, found.far] == counts
