"""Rule expressions against Python itself, rules that fail alone, and NULL pairs counted by masks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from veritable.functions.expressions import ExpressionError, compile_expression, names_in
from veritable.operators import completeness, rules
from veritable.operators.rules import Condition, Rule
from veritable.plans.scan import ScanConfig, scan

def narrow(f):
    """Whole numbers have 64 bits."""
    def run(*args):
        out = f(*args)
        if isinstance(out, int) and abs(out) >= 2**63:
            raise OverflowError
        return out

    return run


def short(x):
    """Floats are written out where all agree on how."""
    if isinstance(x, float) and x and not 1e-3 <= abs(x) < 1e7 and x == x:
        raise ValueError
    return str(x)


SAFE = {f.__name__: f for f in (abs, len, min, max, float, bool)} | {"str": short} | {"round": narrow(round), "int": narrow(int)}


def python(expression, row):
    try:
        return bool(eval(expression, {"__builtins__": {}, **SAFE}, row))
    except (TypeError, AttributeError, ZeroDivisionError, ValueError, OverflowError):
        return None


NUMBERS = [None, 0, 1, -7, 3, 10**12]
FLOATS = [None, 0.0, -2.5, 3.5, 1e300, float("nan")]
TEXTS = [None, "", "US", " us ", "12", "they're ok", "ÉA1", "4.5e1", "a²"]
FLAGS = [None, True, False]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    every = list(itertools.product(NUMBERS, NUMBERS[:5], FLOATS, TEXTS, FLAGS))
    return [dict(zip("abxsf", r)) for r in rng.sample(every, 400)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "i int, a bigint, b bigint, x double, s string, f boolean").persist()


EXPRESSIONS = [
    "a <= b", "a + b == 4", "a - b > 0", "a * b < 10", "a / b > 0.5", "a // b == -3", "a % b == 2", "x // b < 0", "x % 2 == 1.5", "a % x > 0",
    "(a is not None) and (b > 0)", "a is None or a / b > 0", "not a", "not (a > b)", 's == "US"', "s != 'US'", "a == s", "a != x", "a == None",
    "len(s) > 3", "s.strip().lower() == 'us'", "s.lstrip() == s.rstrip()", "s.strip('Us ') == ''", "a < b < 3", "1 < a <= x", "a == b == 0",
    "a in (1, 2, 3)", "a not in [1, None]", "x in (3.5, a)", "s in ('US', '12')", "'S' in s", "s not in 'aUSb'", "a in (1, b / a)", "a in {1: 2}",
    "min(a, b) >= 0", "max(a, b, 2) == 2", "max(a, x) > 0", "min(s, 'b') == 'US'", "min(a, s) == 1", "min((a, b)) < 0", "abs(a) > 5", "abs(x) == 2.5",
    "a if b else x", "a > 0 if f else b > 0", "1 / b > 0 if b else False", "f and a", "f or a", "a or b", "(a or 3) > 2", "(a and b) == 0", "f == 1", "f + 1 == 2",
    "round(x) == 4", "round(x, 1) == -2.5", "round(a, -1) == 0", "round(-2.5) == -2", "int(s) == 12", "int(x) == -2", "int(f) == 1", "float(s) > 20", "float(a) == 3.0", "bool(s)", "bool(None)",
    "str(a) == '3'", "str(f) == 'True'", "str(None) == str(s)", "str(x) == '3.5'", "s + 'x' == 'USx'", "s * 2 == 'USUS'", "s + a == 1", "-a > 0", "+x == 3.5", "-f == -1",
    "s.upper() == 'US'", "s.title() == \"They'Re Ok\"", "s.capitalize() == 'Éa1'", "s.isalpha()", "s.isdigit()", "s.isdecimal()", "s.isalnum()", "s.isspace()", "s.isnumeric()",
    "s.startswith('U')", "s.endswith(('S', '2'))", "a.lower() == 'x'", "s.startswith(a)", "True", "a", "s", "x", "None", "x == x", "x < 4", "x > 1e299", "a > '1'", "s < 'V'", "f < 2",
]


@pytest.mark.parametrize("part", range(4))
def test_expressions_equal_python(table, rows, part):
    told = EXPRESSIONS[part::4]
    got = table.select("i", *(compile_expression(table, e).alias(f"e{k}") for k, e in enumerate(told))).orderBy("i").collect()
    wrong = [(e, r, g[f"e{k}"], python(e, r)) for g, r in zip(got, rows) for k, e in enumerate(told) if g[f"e{k}"] is not python(e, r)]
    assert not wrong, (len(wrong), wrong[:5])


REFUSED = [
    "import os", "x = 1", "while True: pass", 'eval("1")', "__import__('os')", "getattr(s, 'y')", "map(str, a)", "s.__class__", "a.b.c",
    "s.strip().__class__", "a <= zzz", "lambda: 1", "[q for q in (1, 2)]", "a ** 2", "a is 1", "s % 2", "(a or s) > 1", "f'{a}'", "min(a)", "a[0]",
    "s.strip(s)", "len(s, s)", "s.lower(1)", "round(x, a)", "9" * 30, "a if", "abs", "~a", "a & b", "min(*s)", "str(object=a)",
]


@pytest.mark.parametrize("expression", REFUSED)
def test_refused(table, expression):
    with pytest.raises(ExpressionError):
        compile_expression(table, expression)


def test_whole_numbers_beyond_64_bits_do_not_apply(spark):
    df = spark.createDataFrame([(2**62, -(2**63)), (1, -1)], "a bigint, b bigint")
    tests = ["a + a > 0", "a * 4 > 0", "-b > 0", "abs(b) > 0", "b // -1 > 0", "b - 1 < 0"]
    got = df.select(*(compile_expression(df, t).alias(f"c{i}") for i, t in enumerate(tests))).collect()
    assert [tuple(r) for r in got] == [(None,) * 6, (True, True, True, True, True, True)]


def test_names():
    assert names_in("min(price, 2) > qty and len(name) > 0 or price") == ["price", "qty", "name"]


def test_dates_compare_with_dates_only(spark):
    df = spark.sql("SELECT DATE'2024-01-02' AS d, DATE'2024-01-03' AS e, TIMESTAMP'2024-01-02 00:00:00' AS t")
    tests = ["d < e", "d == d", "d < t", "d == t", "t >= t", "d > '2024-01-01'", "bool(d)", "d + 1 == e"]
    (row,) = df.select(*(compile_expression(df, t).alias(f"c{i}") for i, t in enumerate(tests))).collect()
    assert tuple(row) == (True, True, None, False, True, None, True, None)


# --- rules that fail

FAULTY = [
    Rule("good", Condition("v", "gte", 0), severity="high"),
    Rule("divides", columns=("v", "z"), expression="100 / z > 20"),
    Rule("wrong_type", Condition("v", "gt", "many")),
    Rule("pattern", Condition("s", "matches", "(")),
    Rule("total", predicate="100 / z > 20"),
    Rule("unknown", predicate="nowhere > 1"),
    Rule("no_grammar", predicate="v ** 2 > 1"),
    Rule("also_good", Condition("z", "not_null")),
]


@pytest.fixture(scope="module")
def faulty(spark):
    return spark.range(1000).selectExpr("id - 100 AS v", "id % 10 AS z", "CAST(id AS STRING) AS s")


def test_preflight_tells_faulty_rules_apart(faulty):
    got = {r["rule_id"]: r for r in rules.preflight(faulty, FAULTY).collect()}
    assert {k for k, r in got.items() if r["valid"]} == {"good", "also_good", "total"}
    assert got["good"]["failures"] == 100 and got["also_good"]["failures"] == 0
    # z in 5..9 gives at most 20; z = 0 does not apply.
    assert got["total"]["failures"] == 500 and got["total"]["rows_tested"] == 1000
    assert "DIVIDE_BY_ZERO" in got["divides"]["error"] and got["divides"]["schema_valid"]
    assert got["unknown"]["missing_columns"] == ["nowhere"] and not got["unknown"]["schema_valid"]
    assert "Pow" in got["no_grammar"]["error"]


def test_a_faulty_rule_fails_alone_in_a_scan(faulty):
    result = scan(faulty, ScanConfig(detectors=("excessive_null_rate",), rules=FAULTY))
    found = {r["issue_type"]: r["affected_count"] for r in result.candidates.collect()}
    assert found == {"rule:good": 100, "rule:total": 500}
    (run,) = [r for r in result.detector_runs.collect() if r["detector_id"] == "contract_rule"]
    assert run["status"] == "failed"
    for rule in ("divides", "wrong_type", "pattern", "unknown", "no_grammar"):
        assert f"{rule}: " in run["error"]
    assert result.scan_run.first()["status"] == "failed"
    result.release()
    assert {r["issue_type"] for r in rules.rules_in_scan(faulty, FAULTY).collect()} == {"rule:good", "rule:total"}


def test_good_rules_take_one_read(faulty, spark):
    good = [r for r in FAULTY if r.id in ("good", "total", "also_good")]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one_read", "")
    rules.preflight(faulty, good)
    spark.sparkContext.setJobGroup("other", "")
    # Partial counts and their sum: one job, or two where stages are planned one by one.
    assert len(jobs.getJobIdsForGroup("one_read")) <= 2


# --- NULL pairs

@pytest.fixture(scope="module")
def sparse(spark):
    parts = []
    for i in range(70):
        rate = 3 + i % 5
        source = "id" if i % 3 else "id DIV 2"
        parts.append(f"IF(pmod(xxhash64({source}, {i // 2 if i % 4 < 2 else i}), 10) < {rate}, NULL, {i}) AS c{i}")
    return spark.range(3000).selectExpr(*parts).persist()


def pair_rows(df):
    return sorted((*r["columns"], r["affected_count"], round(r["raw_score"], 9)) for r in df.collect())


def test_masks_count_like_checks(sparse, monkeypatch):
    known = completeness.null_counts(sparse, sparse.columns)
    rows, nulls = known
    names = completeness.sparse_columns(nulls, rows)
    table = sparse.toPandas().isna()
    want = {}
    for a, b in itertools.combinations(range(len(names)), 2):
        n = int((table[names[a]] & table[names[b]]).sum())
        if n:
            want[a, b] = n
    assert {(r["a"], r["b"]): r["n"] for r in completeness.null_pairs(sparse, names).collect()} == want
    monkeypatch.setattr(completeness, "PAIR_BLOCK", 16)
    assert {(r["a"], r["b"]): r["n"] for r in completeness.null_pairs(sparse, names).collect()} == want
    some = sparse.select(sparse.columns[16:32])
    for detector in (completeness.conditional_missingness, completeness.correlated_missingness):
        by_mask = pair_rows(detector(some))
        monkeypatch.setattr(completeness, "COUNTED_PAIRS", 10**6)
        assert by_mask == pair_rows(detector(some)) and by_mask
        monkeypatch.setattr(completeness, "COUNTED_PAIRS", 100)


def test_evidence_is_the_same_either_way(sparse, monkeypatch):
    import json

    few = sparse.select("c0", "c1", "c2", "c3")
    told = lambda df: {tuple(r["columns"]): json.loads(r["evidence"]) for r in df.collect()}
    for detector in (completeness.conditional_missingness, completeness.correlated_missingness):
        counted = told(detector(few))
        monkeypatch.setattr(completeness, "COUNTED_PAIRS", 0)
        assert counted == told(detector(few))
        monkeypatch.setattr(completeness, "COUNTED_PAIRS", 100)


def test_scan_of_many_sparse_columns(sparse):
    result = scan(sparse, ScanConfig(detectors=("conditional_missingness", "correlated_missingness"), fingerprint=False))
    found = sorted((r["detector_id"], *r["columns"], r["affected_count"]) for r in result.candidates.collect())
    want = [("conditional_missingness", *r[:3]) for r in pair_rows(completeness.conditional_missingness(sparse))]
    want += [("correlated_missingness", *r[:3]) for r in pair_rows(completeness.correlated_missingness(sparse))]
    assert found == sorted(want)
    result.release()


def test_no_sparse_columns(spark):
    df = spark.range(10)
    assert completeness.conditional_missingness(df).collect() == [] == completeness.correlated_missingness(df).collect()
    assert completeness.correlated_missingness(df.filter(F.lit(False))).collect() == []
