"""File leaves, row differences by hash, and windows merged over many batches."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from veritable.operators import history, repair
from veritable.operators.file_fingerprint import file_changes, file_leaves, folded
from veritable.operators.fingerprint import content_fingerprint
from veritable.plans.scan import ScanConfig, scan
from veritable.session import scratch_path
from veritable.streaming import monitor

SCHEMA = "id bigint, name string, seen array<int>, part int"


def _ten_files(spark, path, n=200):
    df = spark.range(n).selectExpr(
        "id", "IF(id % 7 = 0, NULL, concat('n', id % 5)) name", "array(int(id), IF(id % 3 = 0, NULL, 1)) seen", "int(id % 10) part"
    )
    df.repartition(10, "part").write.partitionBy("part").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def _files(path):
    return sorted(os.path.join(at, f) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def _spoil(path):
    """Bytes that no reader understands, under the same size and time."""
    state = os.stat(path)
    with open(path, "r+b") as f:
        f.write(b"\0" * state.st_size)
    os.utime(path, ns=(state.st_atime_ns, state.st_mtime_ns))


def _later(path):
    state = os.stat(path)
    os.utime(path, ns=(state.st_atime_ns, state.st_mtime_ns + 5_000_000_000))


def test_leaves_add_up_and_unchanged_files_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    df = _ten_files(spark, path)
    leaves = file_leaves(spark, path, "parquet", schema=SCHEMA).persist()
    assert leaves.count() == 10 and leaves.filter("reused").isEmpty()
    assert folded(df, leaves) == (200, content_fingerprint(df))
    # Nine files could not be read any more if anything tried to.
    files = _files(path)
    for f in files[1:]:
        _spoil(f)
    _later(files[0])
    again = file_leaves(spark, path, "parquet", leaves, 0.0, schema=SCHEMA).persist()
    assert again.filter("not reused").count() == 1
    told = {r["change"]: r["n"] for r in file_changes(leaves, again).groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert told == {"same": 9, "touched": 1}
    assert folded(df, again) == folded(df, leaves)
    assert file_leaves(spark, path, "parquet", again, 0.0, schema=SCHEMA).filter("not reused").isEmpty()
    leaves.unpersist(), again.unpersist()


def test_leaves_of_fresh_files_and_other_schemas_are_not_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    _ten_files(spark, path)
    leaves = file_leaves(spark, path, "parquet", schema=SCHEMA).persist()
    leaves.count()
    # An hour: all files are too young to be trusted.
    assert file_leaves(spark, path, "parquet", leaves, 3600.0, schema=SCHEMA).filter("reused").isEmpty()
    fewer = "id bigint, part int"
    assert file_leaves(spark, path, "parquet", leaves, 0.0, schema=fewer).filter("reused").isEmpty()
    leaves.unpersist()


def test_empty_files_and_folders(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    (leaf,) = file_leaves(spark, str(tmp_path / "none"), "parquet").collect()
    assert (leaf["rows"], leaf["lane_a"]) == (0, 0)
    os.mkdir(tmp_path / "bare")
    df = spark.read.schema("id bigint").parquet(str(tmp_path / "bare"))
    leaves = file_leaves(spark, str(tmp_path / "bare"), "parquet", schema="id bigint")
    assert leaves.count() == 0 and folded(df, leaves) == (0, content_fingerprint(df))


def test_incremental_scan_of_files(spark, tmp_path):
    path, store = str(tmp_path / "t"), history.History(spark, scratch_path(spark, "history"))
    _ten_files(spark, path)
    config = ScanConfig(detectors=("excessive_null_rate",))

    def attempt():
        run, _, reused, leaves = history.incremental_scan_files(
            spark, path, store, "t", config, fmt="parquet", settle_seconds=0.0, reader={"schema": SCHEMA}
        )
        return run.first()["scan_run_id"], reused, leaves.filter("reused").count()

    first = attempt()
    assert first[1:] == (False, 0)
    assert attempt() == (first[0], True, 10)
    spark.range(3).selectExpr("id", "'x' name", "array(1) seen").coalesce(1).write.parquet(f"{path}/part=11")
    more = attempt()
    assert more[0] != first[0] and more[1:] == (False, 10)
    assert attempt() == (more[0], True, 11)


def test_scan_sees_files_that_changed(spark, tmp_path):
    path, config = str(tmp_path / "t"), ScanConfig(detectors=("excessive_null_rate", "uniqueness_violation"))
    rows = []
    for i in range(2):
        spark.range(10 + i).selectExpr("id", "IF(id < 9, NULL, 1) v").write.mode("append").parquet(path)
        rows.append(scan(spark.read.schema("id bigint, v int").parquet(path), config).rows)
    assert rows == [10, 21]


def test_scan_leaves_the_callers_cache(spark):
    df = spark.range(50).persist()
    df.count()
    scan(df, ScanConfig(detectors=("excessive_null_rate",), cache_input=True))
    assert df.storageLevel.useMemory
    df.unpersist()


@pytest.mark.parametrize(
    "kind, one, other",
    [
        ("array<int>", [1, None], [None, 1]),
        ("array<array<int>>", [[1], [2]], [[1, 2]]),
        ("struct<a:int,b:int>", (1, None), (None, 1)),
        ("array<string>", [], None),
    ],
)
def test_nested_cells_have_their_own_fingerprint(make, kind, one, other):
    a, b = (make([(x,)], f"v {kind}") for x in (one, other))
    assert content_fingerprint(a) != content_fingerprint(b)


def test_row_diff_of_nulls_and_repeated_keys(make):
    schema = "k int, `a.b` string, v array<int>"
    a = make([(1, "x", [1, None]), (2, "y", [2]), (None, "n", [3]), (4, "p", [4]), (4, "p", [4])], schema)
    b = make([(1, "x", [None, 1]), (2, "y", [2]), (None, "n", [3]), (4, "p", [4]), (4, "q", [4])], schema)
    rows = sorted(map(str, (tuple(r) for r in repair.row_diff(a, b, ["k"]).collect())))
    assert rows == sorted(
        map(
            str,
            [
                (1, "changed", "v", "[1, null]", "[null, 1]"),
                (None, "removed", "a.b", "n", None),
                (None, "removed", "v", "[3]", None),
                (None, "added", "a.b", None, "n"),
                (None, "added", "v", None, "[3]"),
                (4, "changed", "a.b", "p", "q"),
                (4, "changed", "a.b", "p", "q"),
            ],
        )
    )
    assert repair.row_diff(a.filter("k = 2"), a.filter("k = 2"), ["k"]).isEmpty()


def test_windows_of_many_batches(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    schema = "at timestamp, v int"
    day = dt.datetime(2024, 1, 1)

    def arrive(first, last):
        for i in range(first, last):
            rows = [(day + dt.timedelta(hours=6 * i), None if i % 3 == 0 else i)] * 5
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = monitor.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
        rates = monitor.null_rates(stream, "at", ["v"], {}, lateness="10 days")
        found = monitor.run_null_rates(rates, checkpoint, fan=3)
        return found, sorted(tuple(r) for r in found.select("window_start", "rows", "nulls").collect())

    def expected():
        table = spark.read.parquet(folder).groupBy(F.window("at", "1 day").start).agg(F.count("*"), F.count_if(F.col("v").isNull()))
        return sorted(tuple(r) for r in table.collect())

    arrive(0, 12)
    assert run()[1] == expected()
    arrive(12, 20)
    assert run()[1] == expected()
    kept = monitor.WindowTable(spark, f"{checkpoint}-windows", run()[0].schema, 3).levels()
    assert all(len(numbers) < 3 for numbers in kept.values()) and max(kept) >= 2
    # The last batch again, as after a driver that died before its commit.
    commits = f"{checkpoint}/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{commits}/{name}")
    assert run()[1] == expected()


def test_merge_that_broke_off(spark, tmp_path):
    schema = "window_start int, column string, rows bigint"
    windows = monitor.WindowTable(spark, str(tmp_path / "w"), spark.createDataFrame([], schema).schema, 3)
    for i in range(2):
        windows.store(spark.createDataFrame([(1, "v", i), (i, "u", i)], schema), i)
    # A merged copy of the first batch, whose source was not dropped yet.
    copied = spark.read.parquet(windows._at(0, 0))
    copied.write.parquet(windows._at(1, 0))
    assert sorted(map(tuple, windows.read().collect())) == [(0, "u", 0), (1, "u", 1), (1, "v", 1)]
    windows.store(spark.createDataFrame([(1, "v", 7)], schema), 2)
    assert sorted(map(tuple, windows.read().collect())) == [(0, "u", 0), (1, "u", 1), (1, "v", 7)]
    assert windows.levels() == {1: [0, 2]}
