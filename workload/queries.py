"""The registered queries: one Spark callable and, where SQL can say it, one oracle each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.functions.columns import select_columns
from veritable.operators import (
    categorical,
    completeness,
    cross,
    dates,
    fusion,
    model_outlier,
    numeric,
    profile,
    quality,
    rules,
    text_format,
    uniqueness,
)
from veritable.operators.checks import run_checks
from veritable.operators.cross import Reference
from veritable.operators.rules import ColumnContract, Condition, Rule
from workload import detector_oracles as O
from workload.views import COLUMNS, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-15"


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return keep


def core(candidates: DataFrame, *more) -> DataFrame:
    return candidates.select(
        "issue_type",
        "detector_id",
        F.array_join("columns", ",").alias("column_names"),
        "affected_count",
        F.round("raw_score", 6).alias("raw_score"),
        "confidence",
        "fpr",
        "severity",
        *more,
    )


def told(name: str, kind: str = "string"):
    """A field of a candidate's evidence."""
    return F.get_json_object("evidence", f"$.{name}").cast(kind).alias(name)


# ---- detectors ---------------------------------------------------------------
_MODULES = (completeness, uniqueness, categorical, text_format, numeric, dates, cross, model_outlier)
DETECT = {k: f for m in _MODULES for k, f in m.DETECTORS.items()}

# number: (detector, tables it is registered on)
_PLAIN = {
    1: ("excessive_null_rate", ("dirty_orders", "dirty_customer")),
    2: ("suspicious_missing_token", ("dirty_orders",)),
    5: ("conditional_missingness", ("dirty_orders",)),
    6: ("correlated_missingness", ("dirty_orders",)),
    8: ("fuzzy_duplicate", ("dirty_orders", "documents")),
    9: ("suspicious_placeholder", ("dirty_customer",)),
    10: ("rare_category", ("dirty_orders",)),
    11: ("category_explosion", ("dirty_orders", "dirty_customer")),
    12: ("inconsistent_case", ("dirty_orders", "documents")),
    13: ("leading_or_trailing_whitespace", ("dirty_orders", "documents")),
    14: ("repeated_whitespace", ("dirty_customer", "documents")),
    15: ("hidden_control_character", ("dirty_customer", "documents")),
    16: ("unusual_length", ("dirty_customer", "documents")),
    17: ("invalid_email", ("dirty_customer",)),
    18: ("invalid_phone", ("dirty_customer",)),
    19: ("invalid_url", ("dirty_customer", "pages")),
    20: ("invalid_ip", ("dirty_customer",)),
    21: ("suspicious_formula_injection", ("dirty_customer", "documents")),
    22: ("spelling_variant", ("dirty_orders",)),
    23: ("fullwidth_character", ("dirty_customer", "documents")),
    24: ("mojibake_character", ("dirty_customer", "documents")),
    25: ("invalid_numeric", ("dirty_customer",)),
    27: ("percentile_outlier", ("dirty_orders", "lineitem")),
    28: ("modified_zscore", ("dirty_orders", "lineitem")),
    29: ("tail_probability", ("dirty_orders", "customer")),
    32: ("invalid_date", ("dirty_orders",)),
    33: ("impossible_date", ("dirty_orders",)),
    36: ("mixed_date_format", ("dirty_orders",)),
    37: ("duplicate_timestamp", ("dirty_orders", "lineitem")),
    38: ("cross_field_rule", ("dirty_orders",)),
}


def _plain(number: int, detector: str, t: str, first: bool):
    name = f"d{number:02d}_{detector}" + ("" if first else f"_{t}")
    register(name, getattr(O, f"d{number:02d}")(t))(lambda s, d: core(DETECT[detector](table(s, d, t))))


for _n, (_detector, _tables) in _PLAIN.items():
    for _t in _tables:
        _plain(_n, _detector, _t, _t == _tables[0])


@register("d03_sudden_missingness", O.d03("dirty_events", evidence=True))
def _(s, d):
    found = completeness.sudden_missingness(table(s, d, "dirty_events"))
    return core(found, told("time_column"), told("bucket"), told("granularity"), told("bucket_size", "bigint"))


@register("d03_sudden_missingness_text_dates", O.d03("dirty_orders", evidence=True))
def _(s, d):
    found = completeness.sudden_missingness(table(s, d, "dirty_orders"))
    return core(found, told("time_column"), told("bucket"), told("granularity"), told("bucket_size", "bigint"))


@register("d04_group_missingness", O.d04("dirty_customer", evidence=True))
def _(s, d):
    found = completeness.group_missingness(table(s, d, "dirty_customer"))
    return core(found, told("group_column"), told("group_value"), told("group_size", "bigint"))


@register("d07_uniqueness_violation", O.d07("dirty_orders", evidence=True))
def _(s, d):
    found = uniqueness.uniqueness_violation(table(s, d, "dirty_orders"))
    return core(found, told("total_duplicates", "bigint"))


@register("d07_uniqueness_violation_lineitem", O.d07("lineitem", evidence=True))
def _(s, d):
    return core(
        uniqueness.uniqueness_violation(table(s, d, "lineitem")), told("total_duplicates", "bigint")
    )


def _fences(found):
    lower = F.round(F.get_json_object("evidence", "$.lower").cast("double"), 6).alias("lower_bound")
    upper = F.round(F.get_json_object("evidence", "$.upper").cast("double"), 6).alias("upper_bound")
    return core(found, lower, upper)


@register("d26_iqr_outlier", O.d26("dirty_orders", evidence=True))
def _(s, d):
    return _fences(numeric.iqr_outlier(table(s, d, "dirty_orders")))


@register("d26_iqr_outlier_lineitem", O.d26("lineitem", evidence=True))
def _(s, d):
    return _fences(numeric.iqr_outlier(table(s, d, "lineitem")))


@register("d30_histogram_rarity", O.d30("lineitem", 0.01))
def _(s, d):
    return core(numeric.histogram_rarity(table(s, d, "lineitem"), min_ratio=0.01))


@register("d31_model_outlier_isolation_forest")
def _(s, d):
    return core(model_outlier.model_outlier(table(s, d, "dirty_orders")))


@register("d31_model_outlier_local_outlier_factor")
def _(s, d):
    found = model_outlier.model_outlier(table(s, d, "dirty_orders"), model="local_outlier_factor")
    return core(found)


@register("d34_future_date", O.d34("dirty_events", AS_OF))
def _(s, d):
    return core(dates.future_date(table(s, d, "dirty_events"), as_of=AS_OF))


@register("d35_stale_date", O.d35("dirty_orders", AS_OF))
def _(s, d):
    return core(dates.stale_date(table(s, d, "dirty_orders"), as_of=AS_OF))


@register(
    "d38_cross_field_rows",
    "SELECT 'min_qty <= max_qty' AS expression, order_id, CAST(min_qty AS VARCHAR) AS left_value, "
    "CAST(max_qty AS VARCHAR) AS right_value FROM dirty_orders WHERE min_qty > max_qty",
)
def _(s, d):
    return cross.cross_field_rows(table(s, d, "dirty_orders"), ["order_id"])


@register(
    "d39_foreign_key_violation", O.d39("dirty_orders", "customer_id", "customer", "c_custkey", True)
)
def _(s, d):
    ref = Reference("customer", table(s, d, "customer"), {"customer_id": "c_custkey"})
    found = cross.foreign_key_violation(table(s, d, "dirty_orders"), [ref])
    return core(found, told("main_total_non_null", "bigint"))


# ---- rules and contracts -----------------------------------------------------
RULES = [
    Rule("positive", Condition("total_price", "gte", 0), severity="high"),
    Rule("known_status", Condition("status", "in", ["F", "O", "P"])),
    Rule("qty_range", Condition("max_qty", "between", [0, 30])),
    Rule("qty_not_small", Condition("min_qty", "not_between", [0, 20])),
    Rule("has_date", Condition("order_date", "not_null"), severity="low"),
    Rule("iso_date", Condition("order_date", "matches", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$")),
    Rule("not_test", Condition("priority", "not_equals", "test")),
    Rule("only_f", Condition("status", "equals", "F")),
    Rule("small", Condition("min_qty", "lt", 25)),
    Rule("large", Condition("total_price", "gt", 1000)),
    Rule("cheap", Condition("total_price", "lte", 400000)),
    Rule("no_max", Condition("max_qty", "is_null")),
    Rule("not_op", Condition("status", "not_in", ["O", "P"])),
    Rule("no_column", Condition("nowhere", "gt", 1)),
]
_VIOLATION = {
    "positive": "total_price < 0",
    "known_status": "status NOT IN ('F', 'O', 'P')",
    "qty_range": "max_qty NOT BETWEEN 0 AND 30",
    "qty_not_small": "min_qty BETWEEN 0 AND 20",
    "has_date": "order_date IS NULL",
    "iso_date": "NOT regexp_matches(order_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')",
    "not_test": "priority = 'test'",
    "only_f": "status <> 'F'",
    "small": "min_qty >= 25",
    "large": "total_price <= 1000",
    "cheap": "total_price > 400000",
    "no_max": "max_qty IS NOT NULL",
    "not_op": "status IN ('O', 'P')",
}


def _rules_oracle(more: str = "") -> str:
    good = " UNION ALL ".join(
        f"SELECT '{k}' AS rule_id, true AS valid, count(*) AS rows_tested, count(*) FILTER (WHERE {v}) AS failures FROM dirty_orders"
        for k, v in _VIOLATION.items()
    )
    return (
        f"SELECT rule_id, valid, rows_tested, failures, round(CASE WHEN rows_tested > 0 THEN failures / CAST(rows_tested AS DOUBLE) ELSE 0 END, 6) "
        f"AS failure_ratio, failures > 0 AND failures > 0.5 * rows_tested AS dangerous{more} FROM ({good} UNION ALL "
        f"SELECT 'no_column', false, 0, 0)"
    )


@register("r01_rule_preflight", _rules_oracle())
def _(s, d):
    return rules.preflight(table(s, d, "dirty_orders"), RULES).select(
        "rule_id", "valid", "rows_tested", "failures", F.round("failure_ratio", 6).alias("failure_ratio"), "dangerous"
    )


@register("r06_rule_approval", _rules_oracle(", valid AND NOT (failures > 0 AND failures > 0.5 * rows_tested) AS approved"))
def _(s, d):
    return rules.approve(table(s, d, "dirty_orders"), RULES).select(
        "rule_id",
        "valid",
        "rows_tested",
        "failures",
        F.round("failure_ratio", 6).alias("failure_ratio"),
        "dangerous",
        "approved",
    )


_SEVERITY = {r.id: r.severity for r in RULES}


@register(
    "r02_rules_in_scan",
    " UNION ALL ".join(
        f"SELECT {O.row('contract_rule', repr(next(r.when.column for r in RULES if r.id == k)), 'n', O.RATIO, 0.95, 0.1, repr(_SEVERITY[k]), issue='rule:' + k)} "
        f"FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {v}) AS n FROM dirty_orders) WHERE n > 0"
        for k, v in _VIOLATION.items()
    ),
)
def _(s, d):
    return core(rules.rules_in_scan(table(s, d, "dirty_orders"), RULES))


@register(
    "r03_expression_rule",
    "SELECT 'unit_price' AS rule_id, count(*) AS rows_tested, count(*) FILTER (WHERE min_qty <> 0 AND NOT "
    "(total_price / min_qty > 5000)) AS failures FROM dirty_orders UNION ALL SELECT 'either', count(*), count(*) "
    "FILTER (WHERE NOT (CASE WHEN status = 'F' THEN min_qty <= max_qty ELSE length(priority) >= 5 END)) FROM dirty_orders",
)
def _(s, d):
    told_rules = [
        Rule("unit_price", columns=("total_price", "min_qty"), expression="try_divide(total_price, min_qty) > 5000"),
        Rule(
            "either",
            columns=("status", "min_qty", "max_qty", "priority"),
            expression="if(status = 'F', min_qty <= max_qty, length(priority) >= 5)",
        ),
    ]
    return rules.preflight(table(s, d, "dirty_orders"), told_rules).select("rule_id", "rows_tested", "failures")


@register(
    "r01_rule_examples",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{k}' AS rule_id, order_id FROM dirty_orders WHERE {v} ORDER BY order_id LIMIT 5)"
        for k, v in _VIOLATION.items()
    ),
)
def _(s, d):
    found = rules.example_rows(table(s, d, "dirty_orders"), RULES, ["order_id"], limit=5)
    return found.select("rule_id", F.get_json_object("row", "$.order_id").cast("bigint").alias("order_id"))


@register(
    "r01_rule_violations",
    " UNION ALL ".join(f"SELECT '{k}' AS rule_id, order_id FROM dirty_orders WHERE {v}" for k, v in _VIOLATION.items()),
)
def _(s, d):
    found = rules.example_rows(table(s, d, "dirty_orders"), RULES, ["order_id"])
    return found.select("rule_id", F.get_json_object("row", "$.order_id").cast("bigint").alias("order_id"))


CONTRACT = {
    "order_id": ColumnContract(type="integer", nullable=False, unique=True, min=0),
    "total_price": ColumnContract(type="float", min=0, max=400000),
    "status": ColumnContract(type="string", nullable=False, allowed_values=["F", "O", "P"]),
    "order_date": ColumnContract(
        type="date", checks=[{"type": "regex", "pattern": r"[0-9]{4}-[0-9]{2}-[0-9]{2}"}, {"type": "not_null"}]
    ),
    "min_qty": ColumnContract(type="integer", checks=[{"type": "unique"}, {"type": "range", "max": 20}]),
    "absent": ColumnContract(type="string"),
}


def _contract_oracle() -> str:
    checks = [
        ("order_id", "type", "0"),
        ("order_id", "min", "count(*) FILTER (WHERE order_id < 0)"),
        ("order_id", "not_null", "count(*) FILTER (WHERE order_id IS NULL)"),
        ("order_id", "unique", "count(order_id) - count(DISTINCT order_id)"),
        ("total_price", "type", "0"),
        ("total_price", "min", "count(*) FILTER (WHERE total_price < 0)"),
        ("total_price", "max", "count(*) FILTER (WHERE total_price > 400000)"),
        ("status", "type", "0"),
        ("status", "not_null", "count(*) FILTER (WHERE status IS NULL)"),
        ("status", "allowed_values", "count(*) FILTER (WHERE status NOT IN ('F', 'O', 'P'))"),
        ("order_date", "type", "1"),
        ("order_date", "regex", "count(*) FILTER (WHERE NOT regexp_matches(order_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'))"),
        ("order_date", "not_null", "count(*) FILTER (WHERE order_date IS NULL)"),
        ("min_qty", "type", "0"),
        ("min_qty", "unique", "count(min_qty) - count(DISTINCT min_qty)"),
        ("min_qty", "max", "count(*) FILTER (WHERE min_qty > 20)"),
        ("absent", "present", "1"),
    ]
    parts = [
        f"SELECT '{c}' AS column_name, '{k}' AS check_name, CAST({e} AS BIGINT) AS violations FROM "
        + ("dirty_orders" if "count" in e else "(SELECT 1)")
        for c, k, e in checks
    ]
    return f"SELECT *, violations = 0 AS passed FROM ({' UNION ALL '.join(parts)})"


@register("r04_column_contract", _contract_oracle())
def _(s, d):
    return rules.check_contract(table(s, d, "dirty_orders"), CONTRACT).select(
        F.col("column").alias("column_name"), F.col("check").alias("check_name"), "violations", "passed"
    )


@register(
    "r05_reference_list",
    " UNION ALL ".join(
        O.d39("lineitem", c, t, r)
        for c, t, r in (
            ("l_orderkey", "dirty_orders", "min_qty"),
            ("l_partkey", "part", "p_partkey"),
            ("l_suppkey", "nation", "n_nationkey"),
        )
    ),
)
def _(s, d):
    refs = [
        Reference("orders", table(s, d, "dirty_orders"), {"l_orderkey": "min_qty"}),
        Reference("part", table(s, d, "part"), {"l_partkey": "p_partkey"}),
        Reference("nation", table(s, d, "nation"), {"l_suppkey": "n_nationkey"}),
    ]
    return core(cross.foreign_key_violation(table(s, d, "lineitem"), refs))


# ---- profile -----------------------------------------------------------------
def _profile_oracle(t: str, names=None) -> str:
    parts = []
    for i, (c, kind) in enumerate(COLUMNS[t].items()):
        if names is not None and c not in names:
            continue
        nums = (
            f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25, "
            f"round(CAST(median({c}) AS DOUBLE), 4) AS median, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75"
            if kind == "num"
            else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS q25, "
            "CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q75"
        )
        parts.append(
            f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, count(*) AS row_count, "
            f"round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_ratio, "
            f"round(count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE), 6) AS unique_ratio, count(DISTINCT {c}) AS distinct_count, "
            f"CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, {nums} FROM {t}"
        )
    return " UNION ALL ".join(parts)


def _profile_cols(p: DataFrame) -> DataFrame:
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "median", "q75")]
    kept = "column_name ordinal row_count null_ratio unique_ratio distinct_count min max".split()
    return p.select(*kept, *rounded)


@register("p01_profile_lineitem", _profile_oracle("lineitem"))
def _(s, d):
    return _profile_cols(profile.profile(table(s, d, "lineitem")))


@register("p01_profile_customer", _profile_oracle("customer"))
def _(s, d):
    return _profile_cols(profile.profile(table(s, d, "customer")))


def _top_oracle(t: str, value="CAST({c} AS VARCHAR)") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(k AS BIGINT) AS rank, {value.format(c='v')} AS value, n FROM (SELECT v, n, row_number() OVER "
        f"(ORDER BY n DESC, CAST(v AS VARCHAR) NULLS FIRST) AS k FROM (SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY {c})) "
        f"WHERE k <= 10 AND (SELECT count(DISTINCT {c}) FROM {t}) BETWEEN 2 AND 1000"
        for c, kind in COLUMNS[t].items()
    )


@register("p02_top_categories", _top_oracle("dirty_orders"))
def _(s, d):
    return profile.top_categories(table(s, d, "dirty_orders")).withColumn("rank", F.col("rank").cast("bigint"))


@register("p03_profile_reuse", _profile_oracle("orders"))
def _(s, d):
    df = table(s, d, "orders")
    before = profile.profile(df.drop("o_totalprice", "o_orderpriority"))
    return _profile_cols(profile.profile_incremental(df, before))


@register(
    "p04_profile_ranking",
    f"SELECT column_name, null_ratio, CAST(row_number() OVER (ORDER BY null_ratio DESC, ordinal) AS BIGINT) AS place "
    f"FROM ({_profile_oracle('dirty_orders')})",
)
def _(s, d):
    from pyspark.sql import Window

    ranked = profile.rank_profile(profile.profile(table(s, d, "dirty_orders")), "null")
    # One row per column of the profile.
    w = Window.orderBy(F.desc("null_ratio"), "ordinal")
    place = F.row_number().over(w).cast("bigint").alias("place")
    return ranked.select("column_name", "null_ratio", place)


@register(
    "p05_masked_categories",
    _top_oracle(
        "dirty_customer",
        r"regexp_replace(CAST({c} AS VARCHAR), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}|([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}|https?://[^\s]+', '[REDACTED]', 'g')",
    ),
)
def _(s, d):
    df = table(s, d, "dirty_customer")
    top = profile.mask_categories(profile.top_categories(df))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "p06_column_examples",
    "SELECT column_name, examples FROM (WITH drawn AS (SELECT * FROM customer ORDER BY md5('42' || chr(31) || "
    "CAST(c_custkey AS VARCHAR)) LIMIT 5) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)))[1:3], ' | ') AS examples FROM drawn"
        for c in COLUMNS["customer"]
    )
    + ")",
)
def _(s, d):
    found = profile.column_examples(table(s, d, "customer"), ["c_custkey"])
    return found.select("column_name", F.array_join("examples", " | ").alias("examples"))


# ---- fusion, scores, gates ---------------------------------------------------
# Counted detectors on the customer view: one aggregate feeds all of these.
_G_DETECTORS = {
    1: "excessive_null_rate",
    9: "suspicious_placeholder",
    14: "repeated_whitespace",
    15: "hidden_control_character",
    16: "unusual_length",
    17: "invalid_email",
    18: "invalid_phone",
    19: "invalid_url",
    20: "invalid_ip",
    21: "suspicious_formula_injection",
    23: "fullwidth_character",
    24: "mojibake_character",
    25: "invalid_numeric",
    29: "tail_probability",
}


def _g_candidates(s, d) -> DataFrame:
    df = table(s, d, "dirty_customer")
    checks = completeness.null_rate_checks(df) + categorical.placeholder_checks(df)
    for name in _G_DETECTORS.values():
        if name in text_format.COUNTED:
            checks += text_format.text_checks(name, df)
    return run_checks(df, checks + numeric.tail_checks(df))


def _g_issues(s, d) -> DataFrame:
    df = table(s, d, "dirty_customer")
    return fusion.score(fusion.fuse(_g_candidates(s, d), "run", df.count()))


_CANDIDATES = " UNION ALL ".join(getattr(O, f"d{n:02d}")("dirty_customer") for n in _G_DETECTORS)
_FAMILY = "CASE " + " ".join(
    f"WHEN issue_type = '{t}' THEN '{f}'" for t, f in fusion.FAMILY_OF.items()
) + " ELSE issue_type END"
_DIMENSION = "CASE " + " ".join(
    f"WHEN family = '{f}' THEN '{dim}'" for f, dim in fusion.FAMILY_DIMENSION.items()
) + " ELSE 'validity' END"
_WEIGHT = (
    "CASE severity WHEN 'info' THEN 0.1 WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 "
    "WHEN 'high' THEN 0.75 ELSE 1.0 END"
)
_RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


def fused_oracle(candidates: str, t: str) -> str:
    """Issues with priority from candidate rows."""
    names = "array_to_string(list_sort(string_split(column_names, ',')), ',')"
    return (
        f"SELECT *, round(10 * {_WEIGHT} + 25 * confidence + 15 * least(1.0, affected_ratio / 0.05) + 10 * 0.4 + 5 + "
        f"15 * least(1.0, detectors / 3.0) + 10 + 10 * 0.5, 2) AS priority_score FROM (SELECT family AS issue_type, "
        f"{_DIMENSION} AS dimension, column_names, arg_max(severity, {_RANK}) AS severity, "
        f"round(1 - product(1 - confidence), 6) AS confidence, CASE WHEN max(fpr) < 0.3 THEN 'low' WHEN max(fpr) < 0.6 THEN 'medium' "
        f"ELSE 'high' END AS false_positive_risk, max(affected_count) AS affected_count, "
        f"round(least(1.0, max(affected_count) / CAST((SELECT count(*) FROM {t}) AS DOUBLE)), 6) AS affected_ratio, "
        f"count(*) AS detectors FROM (SELECT *, {_FAMILY} AS family FROM (SELECT * REPLACE ({names} AS column_names) FROM ({candidates}))) "
        f"GROUP BY family, column_names)"
    )


def issue_rows(issues: DataFrame) -> DataFrame:
    return issues.select(
        "issue_type",
        F.col("quality_dimensions")[0].alias("dimension"),
        F.array_join("columns", ",").alias("column_names"),
        "severity",
        "confidence",
        "false_positive_risk",
        "affected_count",
        "affected_ratio",
        F.size("detector_ids").cast("bigint").alias("detectors"),
        "priority_score",
    )


_ISSUES = fused_oracle(_CANDIDATES, "dirty_customer")


@register(
    "g01_issue_family",
    f"SELECT issue_type, column_names, family, {_DIMENSION} AS dimension FROM (SELECT *, {_FAMILY} AS family FROM ({_CANDIDATES}))",
)
def _(s, d):
    found = fusion.with_family(_g_candidates(s, d))
    return found.select("issue_type", F.array_join("columns", ",").alias("column_names"), "family", "dimension")


@register("g02_g03_fused_scored_issues", _ISSUES)
def _(s, d):
    return issue_rows(_g_issues(s, d))


_QUALITY = (
    "SELECT dimension, score, round(CASE WHEN score IS NOT NULL THEN w / sum(w) FILTER (WHERE score IS NOT NULL) OVER () END, 6) AS weight, "
    "issues, round(sum(CASE WHEN score IS NOT NULL THEN w * score END) OVER () / sum(CASE WHEN score IS NOT NULL THEN w END) OVER (), 1) AS overall "
    "FROM (SELECT c.dimension, w, coalesce(n, 0) AS issues, CASE WHEN c.ran THEN coalesce(round(greatest(0, least(100, 100 * (1 - impact / (n * 1.6)))), 1), 100.0) END AS score "
    "FROM (VALUES ('completeness', 0.20::DOUBLE, true), ('validity', 0.20::DOUBLE, true), ('uniqueness', 0.15::DOUBLE, true), "
    "('consistency', 0.20::DOUBLE, false), ('integrity', 0.15::DOUBLE, true), ('timeliness', 0.10::DOUBLE, false)) c(dimension, w, ran) "
    f"LEFT JOIN (SELECT dimension, count(*) AS n, sum(confidence * {_WEIGHT} * affected_ratio) AS impact FROM ({{issues}}) GROUP BY dimension) i "
    "ON i.dimension = c.dimension)"
)
_RAN = ["completeness", "validity", "uniqueness", "distribution_stability"]
_NOT_RAN = ("consistency", "timeliness")


@register("g04_quality_score", _QUALITY.replace("{issues}", _ISSUES))
def _(s, d):
    return quality.quality(_g_issues(s, d), _RAN).select("dimension", "score", "weight", "issues", "overall")


@register(
    "g05_severity_counts",
    f"SELECT s.severity, coalesce(n, 0) AS issues FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) "
    f"LEFT JOIN (SELECT severity, count(*) AS n FROM ({_ISSUES}) GROUP BY severity) i ON i.severity = s.severity",
)
def _(s, d):
    return quality.severity_counts(_g_issues(s, d)).select("severity", "issues")


@register(
    "g06_quality_gate",
    f"SELECT NOT (worst > 0.05) AND NOT (low > 3) AS passed, CAST(CASE WHEN worst > 0.05 THEN severe ELSE 0 END + "
    f"CASE WHEN low > 3 THEN low ELSE 0 END AS INTEGER) AS failed_count FROM (SELECT max(affected_ratio) FILTER (WHERE severity IN ('medium', 'high')) AS worst, "
    f"count(*) FILTER (WHERE severity IN ('medium', 'high')) AS severe, count(*) FILTER (WHERE severity = 'low') AS low FROM ({_ISSUES}))",
)
def _(s, d):
    found = quality.gate(_g_issues(s, d), ("medium", "high"), 0.05, {"low": 3})
    return found.select("passed", "failed_count")


@register(
    "g07_score_gate",
    "SELECT scan_run_id, overall, coalesce(overall >= 70, false) AS passed FROM run_log",
)
def _(s, d):
    return quality.score_gate(table(s, d, "run_log"), 70).select("scan_run_id", "overall", "passed")


@register(
    "g08_top_findings",
    f"SELECT issue_type, severity, priority_score FROM ({_ISSUES}) ORDER BY {_RANK} DESC, priority_score DESC LIMIT 5",
)
def _(s, d):
    return quality.top_findings(_g_issues(s, d)).select("issue_type", "severity", "priority_score")


@register(
    "f05_issue_filter",
    f"SELECT issue_type, column_names, severity FROM ({_ISSUES}) WHERE severity = 'low' AND dimension = 'validity' "
    f"AND (column_names LIKE '%e%')",
)
def _(s, d):
    found = quality.filter_issues(_g_issues(s, d), severity="low", dimension="validity")
    by_column = F.exists("columns", lambda c: c.contains("e"))
    return found.filter(by_column).select(
        "issue_type", F.array_join("columns", ",").alias("column_names"), "severity"
    )


@register(
    "f05_issue_search",
    f"SELECT issue_type, column_names FROM ({_ISSUES}) WHERE column_names LIKE '%phone%'",
)
def _(s, d):
    found = quality.filter_issues(_g_issues(s, d), search="  in PHONE ")
    return found.select("issue_type", F.array_join("columns", ",").alias("column_names"))


@register(
    "f06_severity_floor",
    f"SELECT issue_type, column_names, severity FROM ({_ISSUES}) WHERE severity IN ('medium', 'high', 'critical')",
)
def _(s, d):
    return quality.severity_floor(_g_issues(s, d), "medium").select(
        "issue_type", F.array_join("columns", ",").alias("column_names"), "severity"
    )


# ---- column selection and predicates ----------------------------------------
@register(
    "f01_f02_column_selection",
    "SELECT ordinal, name, family, hints, n AS non_null FROM (VALUES (0, 'order_id', 'numeric', 'identifier'), (1, 'customer_id', 'numeric', 'identifier'), "
    "(2, 'total_price', 'numeric', 'numeric'), (3, 'priority', 'string', ''), (4, 'status', 'string', ''), "
    "(5, 'ordered_at', 'temporal', 'time'), (6, 'order_date', 'string', 'date,time'), (7, 'min_qty', 'numeric', 'numeric'), "
    "(8, 'max_qty', 'numeric', 'numeric')) t(ordinal, name, family, hints) JOIN ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS n FROM dirty_orders" for c in COLUMNS["dirty_orders"])
    + ") ON c = name",
)
def _(s, d):
    df = table(s, d, "dirty_orders")
    cells = [F.struct(F.lit(c).alias("name"), F.count(c).alias("non_null")) for c in df.columns]
    counts = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    found = select_columns(df).withColumn("hints", F.array_join("hints", ","))
    return found.join(counts, "name").select("ordinal", "name", "family", "hints", "non_null")


@register(
    "f03_rule_predicates",
    "SELECT order_id, status FROM dirty_orders WHERE status NOT IN ('F', 'O') AND max_qty NOT BETWEEN 3 AND 30",
)
def _(s, d):
    df = table(s, d, "dirty_orders")
    a = rules.violation(df, Condition("status", "in", ["F", "O"]))
    b = rules.violation(df, Condition("max_qty", "between", [3, 30]))
    return df.filter(a & b).select("order_id", "status")


@register(
    "f04_change_predicate",
    "SELECT order_id, priority FROM dirty_orders WHERE priority IS DISTINCT FROM upper(trim(priority)) OR order_date IS DISTINCT FROM nullif(order_date, 'not-a-date')",
)
def _(s, d):
    from veritable.functions.predicates import changes

    df = table(s, d, "dirty_orders")
    first = changes(F.col("priority"), F.upper(F.trim("priority")))
    second = changes(F.col("order_date"), F.nullif(F.col("order_date"), F.lit("not-a-date")))
    return df.filter(first | second).select("order_id", "priority")
