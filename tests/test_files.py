"""Many files from one read: a row for each file, failing ones apart."""

import pytest
from pyspark.sql import functions as F

from veritable.operators.rules import Condition, Rule
from veritable.plans.files import scan_files
from veritable.plans.scan import ScanConfig
from veritable.session import scratch_path


@pytest.fixture(scope="module")
def folder(spark):
    path = scratch_path(spark, "many files")
    rows = spark.range(2000).selectExpr("id", "IF(id % 40 = 1 AND id % 20 = 1, NULL, id) AS v", "IF(id % 20 = 3, -1, 1) AS price", "CAST(id % 20 AS INT) AS part")
    rows.repartition(20, "part").write.partitionBy("part").parquet(path)
    return path


RULES = [Rule("positive", Condition("price", "gte", 0), severity="critical")]


def by_part(df):
    return {int(r["part"]): r for r in df.withColumn("part", F.regexp_extract("file_path", "part=([0-9]+)", 1)).collect()}


def test_each_file_is_judged_by_itself(spark, folder):
    result = scan_files(spark, f"{folder}/part=*/*.parquet", ScanConfig(detectors=("excessive_null_rate",), rules=RULES))
    told = by_part(result.summary)
    assert sorted(told) == list(range(20))
    assert {r["row_count"] for r in told.values()} == {100} and {r["status"] for r in told.values()} == {"completed"}
    assert {k for k, r in told.items() if r["findings"]} == {1, 3}
    assert [k for k, r in told.items() if not r["passed"]] == [3]
    found = by_part(result.candidates)
    assert found[1]["columns"] == ["v"] and found[1]["affected_count"] == 50
    assert found[3]["issue_type"] == "rule:positive" and found[3]["affected_count"] == 100
    result.release()


def test_failing_files_are_rows(spark, folder):
    bad = scratch_path(spark, "bad")
    spark.range(1).selectExpr("'this is no parquet file, and long enough to look at' AS value").coalesce(1).write.text(bad)
    empty = scratch_path(spark, "empty")
    spark.read.parquet(f"{folder}/part=0").limit(0).coalesce(1).write.parquet(empty)
    listed = f"{folder}/part=*/*.parquet, {bad}/*.txt; {empty}/*.parquet\n{folder}/nothing/*.parquet"
    result = scan_files(spark, listed, ScanConfig(detectors=("excessive_null_rate",)))
    rows = result.summary.collect()
    failed = [r for r in rows if r["status"] == "failed"]
    assert len(rows) == 23 and len(failed) == 2 and all(r["error"] and r["row_count"] is None and not r["passed"] for r in failed)
    (none,) = [r for r in rows if r["row_count"] == 0]
    assert none["status"] == "completed" and none["passed"] and "empty" in none["file_path"]
    result.release()


def test_the_number_of_jobs_does_not_grow_with_the_files(spark, folder):
    def jobs(pattern, group):
        spark.sparkContext.setJobGroup(group, "")
        result = scan_files(spark, pattern, ScanConfig(detectors=("excessive_null_rate", "tail_probability")))
        result.summary.collect()
        result.release()
        spark.sparkContext.setJobGroup("other", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(f"{folder}/part=*/*.parquet", "files20") <= jobs(f"{folder}/part=1/*.parquet", "files1") + 2


def test_csv_files_with_a_schema(spark, folder):
    path = scratch_path(spark, "csv files")
    spark.read.parquet(folder).filter("part < 4").repartition(4, "part").write.partitionBy("part").option("header", True).csv(path)
    result = scan_files(spark, f"{path}/part=*/*.csv", fmt="csv", schema="id bigint, v bigint, price int")
    told = by_part(result.summary)
    assert sorted(told) == [0, 1, 2, 3] and told[1]["findings"] and told[3]["findings"]
    result.release()


def test_no_files(spark, folder):
    result = scan_files(spark, f"{folder}/nowhere-*.parquet")
    (row,) = result.summary.collect()
    assert row["status"] == "failed" and result.candidates.collect() == []
