"""Results that changed, or cost too much, on larger copies of the tables."""

import json

import duckdb
from pyspark.sql import functions as F

from compare import difference
from veritable.functions import predicates as P
from veritable.functions.columns import col
from veritable.operators import repair, text_format, uniqueness
from veritable.operators.checks import Check
from veritable.operators.repair import Repair
from veritable.plans import scan as plan
from test_queries import ORACLES, QUERIES, SF


def _orders(spark, path, **changed):
    """The orders with some columns changed, as a folder of tables and a connection to it."""
    spark.read.parquet(f"{SF}/orders.parquet").withColumns(changed).write.parquet(f"{path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet/*.parquet'")
    return con


def test_proposals_that_change_nothing(spark, tmp_path):
    # Keys of 60 copies reach so far that none is an outlier any more.
    con = _orders(spark, tmp_path, o_custkey=F.col("o_custkey") * 6000)
    assert difference(spark, con, QUERIES["x06_propose"], ORACLES["x06_propose"], str(tmp_path)) is None


def test_asked_proposals_have_no_repair(spark, make):
    df = make([(" a", 1.0), ("b", 2.0)], "t string, x double")
    asked = [("leading_or_trailing_whitespace", ("t",)), ("inconsistent_case", ("t",)), ("iqr_outlier", ("x",))]
    none = make([], "issue_id string, columns array<string>, detector_ids array<string>, evidence array<string>")
    found = repair.propose(df, none, asked)
    told = {r["issue_type"]: r["estimated_rows_changed"] for r in found.collect()}
    assert told == {"leading_or_trailing_whitespace": 1, "inconsistent_case": 0, "iqr_outlier": 0}
    assert [r.operation for r in repair.to_repairs(found)] == ["trim_whitespace"]
    assert repair.propose(df, none).isEmpty()


def test_fuzzy_keys_in_batches(make):
    long = "Ab c" * 40
    texts = ["", "a", "A-b", "ab", "中", "中 文", "中文", "é", "éA", "x\u0130I", "\u212aB", "٣4", "一鿿", "a\U0001f600b", "㐀a", long, long.upper(), None]
    df = make(texts, "t string")
    known = df.filter("t is not null").selectExpr("'t' AS column", "t AS value", "1L AS n")
    kept = uniqueness._keyed(known, kept=True).select(F.col("value").cast("string").alias("v"), F.col("start").cast("string").alias("start"))
    plain = known.select(F.col("value").alias("v"), P.fuzzy_key("value").alias("k")).filter("length(k) >= 2")
    assert sorted(map(tuple, kept.collect())) == sorted((r["v"], r["k"][:64]) for r in plain.collect())
    (found,) = uniqueness.fuzzy_duplicate(df).collect()
    told = {g["key"]: g["rows"] for g in json.loads(found["evidence"])["groups"]}
    assert told == {"ab": 3, "中文": 2, long.replace(" ", "").lower(): 2} and found["affected_count"] == 4


def test_fuzzy_duplicates_shuffle_no_long_texts(spark):
    df = spark.range(2000).select(F.repeat(F.concat(F.lit("Word-"), F.col("id").cast("string"), F.lit(" ")), 200).alias("t"))
    found = uniqueness.fuzzy_duplicate(df)
    assert found.isEmpty()
    # Keys of texts are made by the task that reads them, once, and only those of examples by a regular expression.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") <= 2 and "hashpartitioning(column#" in plan


def _seen(spark, kind):
    """A function that counts its calls, and the counter."""
    calls = spark.sparkContext.accumulator(0)

    def look(v):
        calls.add(1)
        return v if kind == "string" else v is not None and v.startswith(" ")

    return F.udf(look, kind), calls


def test_a_scan_looks_once_at_each_short_text(spark, monkeypatch):
    look, calls = _seen(spark, "boolean")
    checks = {"leading_or_trailing_whitespace": lambda df, c: [Check("leading_or_trailing_whitespace", ("t",), look(col("t")), 0.9, "low")]}
    monkeypatch.setattr(plan, "COUNTED", checks)
    df = spark.range(20000).select(F.when(F.col("id") % 4 == 0, " a").when(F.col("id") % 4 == 1, "b").alias("t"))
    config = plan.ScanConfig(detectors=["leading_or_trailing_whitespace"], fingerprint=False)
    (found,) = plan.scan(df, config).candidates.collect()
    assert found["affected_count"] == 5000 and 0 < calls.value < 200


def test_counts_of_short_and_long_texts(spark):
    texts = F.array(F.lit(" a"), F.lit("n/a"), F.lit("=1"), F.repeat(F.lit("long "), 300), F.lit(None), F.lit("\x01"), F.repeat(F.lit(" x"), 40))
    df = spark.range(7000).select(F.get(texts, (F.col("id") % 7).cast("int")).alias("n"), F.lit("2024-02-30").alias("a.date"))
    names = [d for d in plan.COUNTED if d in plan._PER_TEXT]
    found = plan.scan(df, plan.ScanConfig(detectors=names, fingerprint=False)).candidates
    told = {(r["detector_id"], r["columns"][0]): r["affected_count"] for r in found.collect()}
    alone = {(c.detector_id, c.columns[0]): df.filter(c.hit).count() for d in text_format.COUNTED for c in text_format.text_checks(d, df)}
    assert {k: n for k, n in told.items() if k in alone} == {k: n for k, n in alone.items() if n}
    assert told["suspicious_missing_token", "n"] == 1000 and told["impossible_date", "a.date"] == 7000


def test_a_written_repair_reads_its_source_once(spark, tmp_path):
    look, calls = _seen(spark, "string")
    df = spark.range(100).select("id", look(F.concat(F.lit(" "), F.col("id").cast("string"))).alias("t"))
    run = repair.write_repair(df, [Repair("trim_whitespace", ("t",))], str(tmp_path / "r"))
    assert calls.value == 100
    assert run["fingerprint_before"] == repair.content_fingerprint(df)
    assert run["fingerprint_after"] == repair.content_fingerprint(repair.apply_repairs(df, [Repair("trim_whitespace", ("t",))]))
