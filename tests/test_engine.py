"""Quantiles, sampling, fingerprints, fusion, scans, history, repairs, masking, sources, streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.operators import fingerprint, fusion, history, privacy, profile, quality, repair
from veritable.operators import rules, sampling
from veritable.operators.checks import run_checks
from veritable.operators.completeness import null_rate_checks
from veritable.operators.frequency import column_totals, value_counts
from veritable.operators.quantiles import exact_quantiles
from veritable.plans import scan as scan_module
from veritable.schema import FAMILY_TITLE
from veritable.plans.registry import Detector, counted, default_registry
from veritable.plans.scan import ScanConfig, scan
from veritable.session import scratch_path
from veritable.sources import query, readers, sinks

PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


def _cases():
    rng = random.Random(7)
    return {
        "heavy tail": [math.exp(rng.gauss(0, 1) * 60) for _ in range(3000)],
        "one hot value": [7.0] * 2000 + [rng.random() * 1e9 for _ in range(1000)] + [6.999999],
        "two values": [1.0, 2.0] * 500,
        "constant": [3.5] * 100,
        "both signs": [rng.uniform(-1e6, 1e6) for _ in range(3000)],
        "tiny": [5.0],
    }


@pytest.mark.parametrize("name", sorted(_cases()))
def test_counted_quantiles_are_exact(make, name):
    values = _cases()[name]
    df = make(values + [None], "x double").repartition(5)
    (found,) = exact_quantiles(df, {"x": F.col("x")}, PROBS).values()
    assert found == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


def test_frequency_sums_to_rows(make):
    df = make([(1, "a", 0.5), (1, None, 0.5), (2, "b", None)], "i int, s string, d double")
    totals = {r["column"]: (r["distinct"], r["non_null"]) for r in column_totals(value_counts(df)).collect()}
    assert totals == {"i": (2, 3), "s": (2, 2), "d": (1, 2)}


def test_nested_columns_are_skipped(spark):
    df = spark.createDataFrame([([1.0], {"a": 1}, 1)], "e array<double>, m map<string,int>, i int")
    assert {r["column"] for r in value_counts(df).collect()} == {"i"}
    assert profile.profile(df).count() == 1
    assert scan(df).scan_run.first()["status"] == "completed"


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    drawn = df.withColumn("draw", sampling.draw_order(df, ["id"], 42)).orderBy("draw").limit(700)
    gathered = {r["id"] for r in drawn.collect()}
    placed = {r["id"] for r in sampling.reservoir_sample(df.repartition(3), 700, ["id"]).collect()}
    assert placed == gathered and len(placed) == 700
    assert sampling.reservoir_sample(df, 9000, ["id"]).count() == 5000


def test_sample_names(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 4)
    for method in sampling.METHODS:
        assert sampling.sample(df, method, 20, strata=["g"], time_column="id", keys=["id"]).count() == 20
    with pytest.raises(ValueError):
        sampling.sample(df, "other", 5)


def test_content_fingerprint(make):
    df = make([(1, "a"), (2, None), (2, None), (None, "2")], "i int, s string")
    base = fingerprint.content_fingerprint(df)
    assert fingerprint.content_fingerprint(df.repartition(4).orderBy(F.desc("s"))) == base
    swapped = make([(1, "a"), (2, None), (2, None), (2, None)], "i int, s string")
    assert fingerprint.content_fingerprint(swapped) != base
    pairs = make([(1, "a"), (None, "2")], "i int, s string")
    assert fingerprint.content_fingerprint(pairs) != base


def test_fusion_and_score(make):
    df = make([(None,)] * 4 + [(1,)] * 6, "a int")
    issues = fusion.score(fusion.fuse(run_checks(df, null_rate_checks(df)), "r", 10)).collect()
    (i,) = issues
    assert (i["issue_type"], i["severity"], i["affected_ratio"]) == ("missingness", "high", 0.4)
    assert i["title"] == f"{FAMILY_TITLE[i['issue_type']]} in a" and i["quality_dimensions"] == ["completeness"]
    assert i["priority_score"] == pytest.approx(7.5 + 23.75 + 15 + 4 + 5 + 5 + 10 + 5)


def test_row_ids_union_counts(spark, make):
    found = run_checks(make([(None,), (1,)], "a int"), null_rate_checks(make([], "a int")))
    found = found.withColumn("affected_rows", F.array(F.lit("1"), F.lit("2"), F.lit("1")))
    (issue,) = fusion.fuse(found.unionByName(found), "r", 2).collect()
    assert issue["affected_count"] == 2 and issue["affected_row_ids"] == ["1", "2"]
    assert issue["confidence"] == pytest.approx(0.9975)


def _issue_table(spark, rows):
    return spark.createDataFrame(
        rows, "issue_id string, severity string, confidence double, affected_ratio double, quality_dimensions array<string>"
    )


def test_gate(spark):
    issues = _issue_table(
        spark, [("a", "critical", 1.0, 0.5, ["validity"]), ("b", "low", 1.0, 0.02, ["validity"])]
    )
    assert quality.gate(issues).first()["failed_issues"] == ["a"]
    assert quality.gate(issues, max_ratio=0.6).first()["passed"]
    assert quality.gate(issues.filter("issue_id = 'b'")).first()["passed"]
    assert quality.gate(issues.filter("false")).first()["passed"]
    assert quality.gate(issues, max_ratio=0.6, max_issues={"low": 0}).first()["failed_issues"] == ["b"]
    assert quality.gate(issues, require_repair=True, repaired=True).first()["passed"]
    assert not quality.gate(issues, require_repair=True).first()["passed"]


def test_quality_weights(spark):
    issues = _issue_table(spark, [("a", "high", 0.8, 0.5, ["accuracy_proxy", "validity"])])
    rows = {r["dimension"]: r for r in quality.quality(issues, ["validity", "completeness"]).collect()}
    assert rows["validity"]["score"] == pytest.approx(100 * (1 - 0.3 / 1.6), abs=0.06)
    assert rows["completeness"]["score"] == 100.0 and rows["integrity"]["score"] is None
    with pytest.raises(ValueError):
        quality.quality(issues, weights={"validity": -1.0})


def test_failing_detectors_leave_the_rest(make):
    registry = default_registry()

    def broken(at):
        raise RuntimeError("no")

    def broken_later(at):
        bad = F.udf(lambda v: 1 / 0, "string")
        return run_checks(at, null_rate_checks(at.df)).withColumn("severity", bad("severity"))

    registry.register(Detector("broken", detect=broken))
    registry.register(Detector("broken_later", detect=broken_later))
    registry.register(counted("odd", lambda df: ["a"], lambda c: c % 2 == 1))
    df = make([(1, None), (2, None), (3, "x")], "a int, b string")
    chosen = ("excessive_null_rate", "broken", "broken_later", "odd")
    result = scan(df, ScanConfig(detectors=chosen), registry=registry)
    status = {r["detector_id"]: r["status"] for r in result.detector_runs.collect()}
    assert status == {
        "excessive_null_rate": "completed",
        "broken": "failed",
        "broken_later": "failed",
        "odd": "completed",
    }
    assert result.scan_run.first()["status"] == "failed"
    assert {r["detector_id"] for r in result.candidates.collect()} == {"excessive_null_rate", "odd"}
    with pytest.raises(ValueError):
        registry.register(Detector("odd"))


def test_runtime_failure_in_shared_aggregate_is_isolated(make):
    registry = default_registry()
    registry.register(counted("bad_cast", lambda df: ["b"], lambda c: c.cast("int") > 0))
    df = make([(None, "x"), (1, "y")], "a int, b string")
    result = scan(df, ScanConfig(detectors=("excessive_null_rate", "bad_cast")), registry=registry)
    status = {r["detector_id"]: r["status"] for r in result.detector_runs.collect()}
    assert status == {"excessive_null_rate": "completed", "bad_cast": "failed"}
    assert result.candidates.count() == 1


def test_empty_table_scan(make):
    result = scan(make([], "a int, b string"))
    run = result.scan_run.first()
    assert run["row_count"] == 0 and result.issues.count() == 0 and run["overall"] == 100.0


def test_scan_equals_single_detectors(spark, make):
    rng = random.Random(3)
    rows = [
        (i, rng.choice(["A-1", "a1", "B-2", "b2", None]), rng.gauss(0, 1), f"2024-01-{1 + i % 28:02d}")
        for i in range(400)
    ]
    df = make(rows, "id int, code_x string, amount double, event_date string")
    chosen = [d for d in scan_module.COUNTED if "date" not in d] + [
        "uniqueness_violation",
        "spelling_variant",
        "iqr_outlier",
        "percentile_outlier",
        "modified_zscore",
        "mixed_date_format",
    ]
    result = scan(df, ScanConfig(detectors=chosen))
    key = lambda r: (r["detector_id"], tuple(r["columns"]), r["affected_count"], r["severity"])
    whole = sorted(key(r) for r in result.candidates.collect())
    registry = default_registry()
    single = sorted(key(r) for d in chosen for r in registry.get(d).detect(df).collect())
    assert whole == single


def test_rules(make):
    df = make([(1, -5), (2, 10), (3, None)], "id int, price int")
    bad = rules.Rule("x", rules.Condition("price", "between", [1]))
    rows = {r["rule_id"]: r for r in rules.preflight(df, [bad, rules.Rule("n")]).collect()}
    assert not rows["x"]["valid"] and rows["x"]["schema_valid"] and not rows["n"]["valid"]
    all_bad = rules.Rule("all", rules.Condition("id", "gt", 100))
    assert not rules.approve(df, [all_bad]).first()["approved"]
    assert rules.approve(df, [all_bad], force=True).first()["approved"]


def test_history(spark, make):
    store = history.History(spark, scratch_path(spark, "history"))
    config = ScanConfig(detectors=("tail_probability",))
    df = make([(1, 1.0), (2, -1.0)], "id int, amount double")
    run, issues, reused = history.incremental_scan(df, store, "d", config=config)
    assert not reused and issues.count() == 1
    again, stored, reused = history.incremental_scan(df.repartition(2), store, "d", config=config)
    assert reused and again.first()["scan_run_id"] == run.first()["scan_run_id"] and stored.count() == 1
    more = make([(i, 1.0) for i in range(6)], "id int, amount double")
    history.incremental_scan(more, store, "d", config=config)
    changes, drifts = history.drift_latest(store.read("scan_runs"), store.read("issues"), "d")
    told = {r["metric"]: r["direction"] for r in drifts.collect()}
    assert told["row_count"] == "increase" and told["issue_count.numeric_outlier"] == "gone_category"
    assert changes.count() == 0


def test_column_order_drift(make):
    config = ScanConfig(detectors=("tail_probability",), fingerprint=False)
    runs = [scan(make([(1, 2)], s), config).scan_run for s in ("a int, b int", "b int, a int")]
    (row,) = history.schema_drift(*runs).collect()
    assert (row["change_type"], row["column"]) == ("order_changed", "a")
    assert history.schema_drift(runs[0], runs[0]).count() == 0


def test_repairs(spark, make):
    df = make(
        [(1, " a ", 5.0, "2024-02-30"), (2, "N/A", None, "2024-01-01"), (3, "b", 900.0, None)],
        "id int, name string, price double, event_date string",
    )
    plan = [
        repair.Repair("trim_whitespace", ("name",)),
        repair.Repair("replace_missing_token", ("name",)),
        repair.Repair("clip_value", ("price",), {"lower": 10, "upper": 100}),
        repair.Repair("set_null", ("event_date",)),
    ]
    fixed = repair.apply_repairs(df, plan).orderBy("id").collect()
    assert [tuple(r) for r in fixed] == [(1, "a", 10.0, None), (2, None, None, "2024-01-01"), (3, "b", 100.0, None)]
    with pytest.raises(ValueError):
        repair.clip_bounds(5, 1)
    with pytest.raises(ValueError):
        repair.clip_bounds(float("nan"), 1)
    with pytest.raises(ValueError):
        repair.repaired("map_category", F.col("name"))
    base = scratch_path(spark, "repair")
    run = repair.write_repair(df, plan, base)
    assert run["fingerprint_before"] != run["fingerprint_after"]
    back = repair.rollback(spark, run, f"{base}/back")
    restored = readers.read_table(spark, back["restored_path"], "parquet")
    assert fingerprint.content_fingerprint(restored) == run["fingerprint_before"]
    with pytest.raises(Exception):
        sinks.write_table(df, f"{base}/back")


def test_row_diff_sees_added_and_removed(make):
    a, b = make([(1, "x"), (2, "y")], "id int, v string"), make([(2, "z"), (3, "w")], "id int, v string")
    rows = {(r["id"], r["change"], r["old_value"], r["new_value"]) for r in repair.row_diff(a, b, ["id"]).collect()}
    assert rows == {(1, "removed", "x", None), (2, "changed", "y", "z"), (3, "added", None, "w")}


TEXTS = [
    "mail a.b@c.org or call 13812345678 now",
    "13812345678@x.com",
    "see http://x.org/a@b.com/1.2.3.4?id=11010119900307451X end",
    "id 11010119900307451X and 110101900307451",
    "1.2.3.4 and 1234.5.6.7",
    "a@b.comhttp://x.y",
    "two a@b.co a@b.co",
    "no hit 12345",
    "",
    None,
]


def test_masking_matches_spans(spark, make):
    df = make(list(enumerate(TEXTS)), "id int, t string")
    masked = {r["id"]: r["t"] for r in privacy.mask(df, ["t"]).collect()}
    patterns = privacy._compiled()
    for i, text in enumerate(TEXTS):
        if text is None:
            assert masked[i] is None
            continue
        covered = [False] * len(text)
        for p in patterns.values():
            for m in p.finditer(text):
                covered[m.start() : m.end()] = [True] * (m.end() - m.start())
        kept = "".join(ch for ch, hit in zip(text, covered) if not hit)
        assert masked[i].replace(privacy.MASK, "") == kept
        assert (privacy.MASK in masked[i]) == any(covered)
    assert masked[1] == privacy.MASK and masked[5] == "[REDACTED]"
    assert masked[0] == "mail [REDACTED] or call [REDACTED] now"


def test_tokens_restore(spark, make):
    df = make(list(enumerate(TEXTS)), "id int, t string")
    masked, tokens = privacy.tokenise(df, ["t"])
    assert tokens.filter("kind = 'email' and value = 'a@b.co'").first()["occurrences"] == 2
    back = privacy.restore(masked, tokens, "t", ["id"])
    assert sorted(back.collect(), key=lambda r: r["id"]) == sorted(df.collect(), key=lambda r: r["id"])
    none = tokens.filter("false")
    kept = privacy.restore(masked, none, "t", ["id"])
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in masked.collect()}


def test_vault(make):
    tokens = make([("email", "{{REDACTED:email:1}}", "a@b.co")], "kind string, token string, value string")
    vault = privacy.encrypt_mapping(tokens, "0123456789abcdef", F.lit("2024-01-01").cast("timestamp"))
    again = privacy.decrypt_mapping(privacy.rekey(vault, "0123456789abcdef", "f" * 16), "f" * 16)
    assert again.first()["value"] == "a@b.co"
    assert privacy.purge(vault, 10, F.lit("2024-01-20").cast("timestamp")).count() == 0
    assert privacy.purge(vault, 30, F.lit("2024-01-20").cast("timestamp")).count() == 1


def test_sources(spark, make):
    base = scratch_path(spark, "sources")
    df = make([(1, "a;b", 2.5), (2, None, None)], "id int, s string, d double")
    for fmt in ("csv", "parquet", "jsonl"):
        sinks.write_table(df, f"{base}/{fmt}", fmt)
        back = readers.read_table(spark, f"{base}/{fmt}", fmt).select("id", "s", "d")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert readers.format_of("s3://b/x.PQ") == "parquet" and readers.resolve_uri("s3://b/x") == "s3a://b/x"
    assert readers.expand_paths("a, b;a\nc,") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        readers.format_of("x.xlsx")
    with pytest.raises(ValueError):
        readers.read_csv(spark, base, sep="#")
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "postgresql", "jdbc:postgresql://h/d", "")
    with pytest.raises(ValueError):
        query.sql(df, "DROP TABLE x")
    assert query.sql(df, "SELECT id FROM {data} WHERE id = ?", [2]).first()["id"] == 2


def test_profile(make):
    df = make([(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, None), (4, None, "b"), (None, 5.0, "c")], "id int, amount double, label string")
    rows = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert all(r["null_ratio"] == 0.2 for r in rows.values())
    assert rows["label"]["distinct_count"] == 3 and rows["amount"]["mean"] == pytest.approx(2.75)
    approx = {r["column_name"]: r["distinct_count"] for r in profile.profile(df, approx=True).collect()}
    assert approx == {c: r["distinct_count"] for c, r in rows.items()}
    nested = {r["column_name"]: r["top_categories"] for r in profile.nested_categories(profile.top_categories(df)).collect()}
    assert [tuple(x) for x in nested["label"]][0] == ("a", 2)
    with pytest.raises(ValueError):
        profile.rank_profile(profile.profile(df), "other")
