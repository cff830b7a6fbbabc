"""Queries of rules that fail, of the expression language, of many files, and of wide tables with many sparse columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.operators import completeness, rules
from veritable.operators.rules import Condition, Rule
from veritable.plans.files import scan_files
from veritable.plans.scan import ScanConfig, scan
from veritable.session import scratch_path
from workload.queries import register
from workload.views import table

# rule: (expression, SQL that is true where the rule is broken)
GRAMMAR = {
    "ordered": ("min_qty <= max_qty", "min_qty > max_qty"),
    "sum": ("min_qty + max_qty == 40", "min_qty + max_qty <> 40"),
    "present": ("(total_price is not None) and (total_price > 0)", "total_price IS NULL OR total_price <= 0"),
    "same": ('status == "F"', "status IS DISTINCT FROM 'F'"),
    "length": ("len(priority) > 5", "length(priority) <= 5"),
    "method": ("priority.strip().lower() != 'n/a'", "lower(trim(priority)) = 'n/a'"),
    "chain": ("5 <= min_qty < max_qty", "min_qty < 5 OR min_qty >= max_qty"),
    "member": ("min_qty in (1, 2, 3, None)", "min_qty NOT IN (1, 2, 3)"),
    "least": ("min(min_qty, max_qty) >= 3", "least(min_qty, max_qty) < 3 AND max_qty IS NOT NULL"),
    "either": ("min_qty > 10 if status == 'F' else max_qty > 10", "CASE WHEN status = 'F' THEN min_qty <= 10 ELSE max_qty <= 10 END"),
    "divided": ("total_price / min_qty > 5000", "min_qty <> 0 AND total_price / min_qty <= 5000"),
    "floored": ("-7 // (min_qty - 10) < 0", "min_qty < 10"),
    "rest": ("(min_qty - 20) % 7 == 1", "((min_qty - 20) % 7 + 7) % 7 <> 1"),
    "or_missing": ("max_qty is None or max_qty % 2 == 0", "max_qty % 2 <> 0"),
    "wrong_type": ("priority > 3", "false"),
    "number_of_text": ("int(order_date) > 0 or True", "false"),
    "written": ("str(max_qty) != 'None'", "max_qty IS NULL"),
    "edge": ("order_date.startswith(('19', '20'))", "NOT (order_date LIKE '19%' OR order_date LIKE '20%')"),
}


@register(
    "r03_expression_grammar",
    " UNION ALL ".join(
        f"SELECT '{k}' AS rule_id, true AS valid, count(*) AS rows_tested, count(*) FILTER (WHERE {v}) AS failures FROM dirty_orders"
        for k, (_, v) in GRAMMAR.items()
    )
    + " UNION ALL SELECT 'refused', false, 0, 0",
)
def _(s: SparkSession, d: str) -> DataFrame:
    told = [Rule(k, predicate=e) for k, (e, _) in GRAMMAR.items()] + [Rule("refused", predicate="__import__('os')")]
    return rules.preflight(table(s, d, "dirty_orders"), told).select("rule_id", "valid", "rows_tested", "failures")


FAULTY = [
    Rule("positive", Condition("total_price", "gte", 0), severity="high"),
    Rule("divides", columns=("total_price", "min_qty"), expression="total_price / min_qty > 5000"),
    Rule("wrong_type", Condition("min_qty", "gt", "many")),
    Rule("total", predicate="total_price / min_qty > 5000"),
]


@register(
    "r02_faulty_rule",
    "SELECT 'rule:positive' AS name, count(*) FILTER (WHERE total_price < 0) AS n FROM dirty_orders UNION ALL "
    "SELECT 'rule:total', count(*) FILTER (WHERE min_qty <> 0 AND total_price / min_qty <= 5000) FROM dirty_orders UNION ALL "
    "SELECT 'contract_rule failed', 2 UNION ALL SELECT 'scan failed', 1",
)
def _(s: SparkSession, d: str) -> DataFrame:
    result = scan(table(s, d, "dirty_orders"), ScanConfig(detectors=("excessive_null_rate",), rules=FAULTY, fingerprint=False))
    found = result.candidates.filter("detector_id = 'contract_rule'").select(F.col("issue_type").alias("name"), F.col("affected_count").alias("n"))
    run = result.detector_runs.filter("detector_id = 'contract_rule'").select(
        F.concat(F.lit("contract_rule "), "status").alias("name"), F.size(F.split("error", "; ")).cast("bigint").alias("n")
    )
    return found.unionByName(run).unionByName(result.scan_run.select(F.concat(F.lit("scan "), "status"), F.lit(1).cast("bigint")).toDF("name", "n"))


# ---- many sparse columns -----------------------------------------------------
N_SPARSE = 60


def _missing(i: int) -> str:
    """Where column ``i`` is NULL; the last twenty columns are NULL where the first twenty are."""
    k = i % 40
    return f"(o_orderkey + {k * k}) % {5 + k % 11} = 0"


def wide(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    return orders.selectExpr(*(f"IF({_missing(i)}, NULL, o_orderkey + {i}) AS c{i}" for i in range(N_SPARSE)))


def _pairs(tail: str) -> str:
    cells = ", ".join(f"CASE WHEN {_missing(i)} THEN {i} END" for i in range(N_SPARSE))
    return (
        f"WITH missing AS (SELECT o_orderkey, unnest([{cells}]) AS c FROM orders), "
        "known AS (SELECT * FROM missing WHERE c IS NOT NULL), "
        "nulls AS (SELECT c, count(*) AS n FROM known GROUP BY c HAVING count(*) >= 0.02 * (SELECT count(*) FROM orders)), "
        "pairs AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM known a JOIN known b USING (o_orderkey) GROUP BY a.c, b.c), "
        "sized AS (SELECT 'c' || a || ',c' || b AS column_names, p.n AS affected_count, x.n AS na, y.n AS nb FROM pairs p "
        "JOIN nulls x ON x.c = a JOIN nulls y ON y.c = b WHERE x.n > y.n OR (x.n = y.n AND a < b)) " + tail
    )


@register(
    "d05_conditional_missingness_wide",
    _pairs(
        "SELECT column_names, affected_count, round(affected_count / CAST(na AS DOUBLE), 6) AS raw_score FROM sized "
        "WHERE na >= 10 AND affected_count / CAST(na AS DOUBLE) >= 0.8"
    ),
)
def _(s: SparkSession, d: str) -> DataFrame:
    return _found(completeness.conditional_missingness(wide(s, d)))


@register(
    "d06_correlated_missingness_wide",
    _pairs(
        "SELECT column_names, affected_count, round(affected_count / CAST(nb AS DOUBLE), 6) AS raw_score FROM sized "
        "WHERE affected_count >= 5 AND affected_count / CAST(nb AS DOUBLE) >= 0.5"
    ),
)
def _(s: SparkSession, d: str) -> DataFrame:
    return _found(completeness.correlated_missingness(wide(s, d)))


def _found(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.array_join("columns", ",").alias("column_names"), "affected_count", F.round("raw_score", 6).alias("raw_score"))


# ---- many files --------------------------------------------------------------
N_FILES = 12
_RULE = Rule("positive", Condition("total_price", "gte", 0), severity="high")


@register(
    "s06_file_summary",
    f"""
    WITH files AS (SELECT *, CAST(order_id % {N_FILES} AS BIGINT) AS part FROM dirty_orders),
    counted AS (SELECT part, count(*) AS row_count, count(*) FILTER (WHERE total_price < 0) AS negative,
        {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in ("customer_id", "total_price", "priority", "status", "ordered_at", "order_date", "min_qty", "max_qty"))}
        FROM files GROUP BY part)
    SELECT part, 'completed' AS status, row_count,
        CAST(CASE WHEN negative > 0 THEN 1 ELSE 0 END + {" + ".join(f"CASE WHEN null_{c} > 0.05 * row_count THEN 1 ELSE 0 END" for c in ("customer_id", "total_price", "priority", "status", "ordered_at", "order_date", "min_qty", "max_qty"))} AS BIGINT) AS findings,
        NOT (negative > 0.01 * row_count OR {" OR ".join(f"null_{c} > 0.3 * row_count" for c in ("total_price", "order_date", "max_qty"))}) AS passed
    FROM counted UNION ALL SELECT -1, 'failed', NULL, NULL, false
    """,
)
def _(s: SparkSession, d: str) -> DataFrame:
    path, bad = scratch_path(s, "orders"), scratch_path(s, "broken")
    df = table(s, d, "dirty_orders").withColumn("part", F.col("order_id") % N_FILES)
    df.repartition(N_FILES, "part").write.partitionBy("part").parquet(path)
    s.range(1).selectExpr("'this is no parquet file, and long enough to look at' AS value").coalesce(1).write.text(bad)
    config = ScanConfig(detectors=("excessive_null_rate",), rules=[_RULE])
    result = scan_files(s, f"{path}/part=*/*.parquet, {bad}/*.txt", config, fail_on=("high", "critical"))
    part = F.coalesce(F.regexp_extract("file_path", "part=([0-9]+)", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
    return result.summary.select(part.alias("part"), "status", "row_count", "findings", "passed")
