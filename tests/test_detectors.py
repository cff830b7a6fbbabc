"""Detectors on small tables, one positive and one negative case each."""

import random

import pytest
from conftest import told

from veritable.operators import categorical, completeness, cross, dates, model_outlier, numeric
from veritable.operators import text_format, uniqueness


def test_null_rate(make):
    df = make([(None, "x"), (None, "x"), (None, "x"), (None, "x"), (1, "x"), (2, "x")], "a int, b string")
    rows = completeness.excessive_null_rate(df).collect()
    assert [(r["columns"], r["affected_count"], r["severity"]) for r in rows] == [(["a"], 4, "high")]
    assert rows[0]["raw_score"] == pytest.approx(4 / 6)


def test_missing_tokens(make):
    df = make(["n/a", " N/A ", "-", "a", "b", None, "c"], "v string")
    assert told(completeness.suspicious_missing_token(df)) == {"v": 3}


def test_missing_together(make):
    df = make([(1, 1, 1)] * 100 + [(None, None, None)] * 10, "a int, b int, c int")
    assert told(completeness.correlated_missingness(df)) == {"a,b": 10, "a,c": 10, "b,c": 10}


def test_cascade(make):
    df = make([(1, 1)] * 90 + [(None, None)] * 10, "parent_id int, child_id int")
    assert told(completeness.conditional_missingness(df)) == {"parent_id,child_id": 10}


def test_grouped_missing(make):
    rows = [("shanghai", None)] * 30 + [("beijing", 1)] * 35 + [("xian", 2)] * 35
    df = make(rows, "city string, value int")
    assert told(completeness.group_missingness(df)) == {"value": 30}


def test_grouped_missing_needs_few_groups(make):
    rows = [(f"c{i}", None if i % 2 else 1) for i in range(60) for _ in range(10)]
    assert told(completeness.group_missingness(make(rows, "city string, value int"))) == {}


@pytest.mark.parametrize("kind", ["date", "string"])
def test_spike_day(make, kind):
    rows = [(f"2024-01-0{d}", 1) for d in range(1, 7) for _ in range(20)] + [("2024-01-05", None)] * 20
    df = make(rows, "event_date string, value int")
    df = df.withColumn("event_date", df["event_date"].cast(kind))
    (row,) = completeness.sudden_missingness(df).collect()
    assert row["affected_count"] == 20 and row["raw_score"] == 0.5
    assert '"bucket":"2024-01-05"' in row["evidence"]


def test_years_when_few_days(make):
    rows = [("2023-01-01", 1)] * 40 + [("2024-03-01", None)] * 10
    (row,) = completeness.sudden_missingness(make(rows, "event_date string, value int")).collect()
    assert row["affected_count"] == 10 and row["raw_score"] == 1.0
    assert '"bucket":"2024","granularity":"year"' in row["evidence"]


def test_duplicates(make):
    assert told(uniqueness.uniqueness_violation(make([1, 1, 2, 3, 3, 3], "id int"))) == {"id": 3}
    assert told(uniqueness.uniqueness_violation(make([1, 2, None, None], "id int"))) == {}


def test_duplicates_keep_true_total(make):
    df = make([i for i in range(30) for _ in range(2)], "id int")
    (row,) = uniqueness.uniqueness_violation(df).collect()
    assert row["affected_count"] == 30 and '"total_duplicates":30' in row["evidence"]


def test_negative_zero_is_zero(make):
    assert told(uniqueness.uniqueness_violation(make([0.0, -0.0, 1.0], "x double"))) == {"x": 1}


def test_fuzzy_duplicate(make):
    df = make([(1, "Alice"), (2, "alice"), (3, "BOB"), (4, "b-o b"), (5, "Eve")], "id int, name string")
    (row,) = uniqueness.fuzzy_duplicate(df).collect()
    assert row["affected_count"] == 2 and "alice" in row["evidence"]


def test_categories(make):
    assert told(categorical.suspicious_placeholder(make(["test", "FOO ", "a", "b"], "v string"))) == {"v": 2}
    rare = make(["a"] * 3000 + ["b"] * 3000 + ["odd"], "v string")
    assert told(categorical.rare_category(rare)) == {"v": 1}
    unique = make([(f"v{i}", f"u{i}") for i in range(50)], "v string, user_id string")
    assert told(categorical.category_explosion(unique)) == {"v": 50}
    cased = make(["California", "california", " CALIFORNIA", "Texas", "Texas"], "v string")
    assert told(categorical.inconsistent_case(cased)) == {"v": 3}


def test_text_formats(make):
    df = make(["a ", "b", " c", "d  e", "f\x01", "x" * 2000], "v string")
    assert told(text_format.leading_or_trailing_whitespace(df)) == {"v": 2}
    assert told(text_format.repeated_whitespace(df)) == {"v": 1}
    assert told(text_format.hidden_control_character(df)) == {"v": 1}
    assert told(text_format.unusual_length(df)) == {"v": 1}


@pytest.mark.parametrize(
    "detector, column, good, bad",
    [
        ("invalid_email", "email", ["a@b.co", " a.b@c.de "], ["x", "a@b", "a@b.co\n"]),
        ("invalid_phone", "phone", ["+86 138-0000-0000"], ["123", "1234567890123456"]),
        ("invalid_url", "website", ["http://a.b", "ftp://c"], ["a.b", "https://a b"]),
        ("invalid_ip", "ip_address", ["1.2.3.4", "255.255.255.255"], ["256.1.1.1", "1.2.3", "01.2.3.4"]),
        ("suspicious_formula_injection", "v", ["a=1"], ["=SUM(A1)", "+cmd", "-2", "@x", "\tx"]),
        ("fullwidth_character", "v", ["full1", "，"], ["full１", "Ａ"]),
        ("mojibake_character", "v", ["ok"], ["lost\ufffd"]),
    ],
)
def test_patterns(make, detector, column, good, bad):
    df = make([*good, *bad, None], f"{column} string")
    assert told(text_format.DETECTORS[detector](df)) == {column: len(bad)}
    assert told(text_format.DETECTORS[detector](make(good, f"{column} string"))) == {}


def test_invalid_numeric(make):
    df = make(["1,000", "-2.5", "abc", "def"], "price string")
    assert told(text_format.invalid_numeric(df)) == {"price": 2}
    assert told(text_format.invalid_numeric(make(["1", "abc"], "price string"))) == {}
    assert told(text_format.invalid_numeric(make(["x", "y"], "update_count string"))) == {}


def test_spelling_variants(make):
    rows = [f"A-1000{i}" for i in range(5) for _ in range(3)] + [f"A1000{i}" for i in range(5)] + ["z"] * 30
    assert told(text_format.spelling_variant(make(rows, "sku string"))) == {"sku": 20}


def test_outliers(make):
    df = make([*range(100), 100_000], "v int")
    assert told(numeric.iqr_outlier(df)) == {"v": 1}
    assert told(numeric.modified_zscore(df))["v"] >= 1
    assert told(numeric.tail_probability(make([1, -1, -2], "v int"))) == {"v": 2}
    assert told(numeric.histogram_rarity(df, min_ratio=0.05)) == {"v": 1}


def test_model_outlier(make):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(200)] + [50.0, -45.0, 40.0]
    df = make(values, "value double")
    for model in model_outlier.MODELS:
        (row,) = model_outlier.model_outlier(df, model=model).collect()
        assert 3 <= row["affected_count"] <= 6
        assert "50.0" in row["evidence"] and "-45.0" in row["evidence"]
    assert told(model_outlier.model_outlier(make([1.0] * 5, "value double"))) == {}


def test_dates(make):
    df = make(["2024-02-30", "2024-02-29", "x", "2023-02-29", None], "event_date string")
    assert told(dates.invalid_date(df)) == {"event_date": 1}
    assert told(dates.impossible_date(df)) == {"event_date": 2}
    times = make(["2020-01-01", "2024-01-10", "2030-01-01", None], "at string, hire string"[:9])
    times = times.withColumn("at", times["at"].cast("timestamp"))
    assert told(dates.future_date(times, as_of="2024-01-15")) == {"at": 1}
    assert told(dates.stale_date(times, as_of="2024-01-15")) == {"at": 1}
    mixed = make([f"2024-01-{i:02d}" for i in range(1, 11)] + ["1/2/2024", "3/4/2024"], "event_date string")
    assert told(dates.mixed_date_format(mixed)) == {"event_date": 2}


def test_duplicate_timestamp(make):
    df = make(["2024-01-01"] * 3 + ["2024-01-02"] * 2, "d string")
    assert told(dates.duplicate_timestamp(df.withColumn("d", df["d"].cast("date")))) == {"d": 2}


def test_ranges(make):
    df = make([(1, 2), (3, 1), (None, 1), (5, None)], "min_price int, max_price int")
    assert told(cross.cross_field_rule(df)) == {"min_price,max_price": 1}
    assert cross.range_pairs(make([(1, "a")], "min_x int, max_x string")) == []


def test_orphans(make):
    main = make([(1, 1), (2, 2), (3, 99), (4, None), (5, 99)], "order_id int, customer_id int")
    ref = make([(1, "a"), (2, "b")], "id int, name string")
    found = cross.foreign_key_violation(main, [cross.Reference("customers", ref, {"customer_id": "id"})])
    (row,) = found.collect()
    assert row["affected_count"] == 2 and row["raw_score"] == pytest.approx(50.0)


def test_empty_table_reports_nothing(make):
    df = make([], "a int, b string")
    assert told(completeness.excessive_null_rate(df)) == {}
    assert told(uniqueness.uniqueness_violation(df)) == {}
    assert told(numeric.iqr_outlier(df)) == {}
