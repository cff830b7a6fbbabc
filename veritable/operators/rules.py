"""Rules and column contracts (R01-R06), all counted in one aggregate.

A rule that fails while the rows are read fails alone: the rules are then counted in halves, and halves of
halves, until the faulty ones are apart, which takes a few reads for each of them and none when all is well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions import expressions
from veritable.functions.columns import col
from veritable.operators.checks import ROWS, Check, Target, empty, report, target
from veritable.operators.frequency import value_counts

# ---- fixed values -----------------------------------------------------------
OPERATORS = (
    "equals",
    "not_equals",
    "gt",
    "gte",
    "lt",
    "lte",
    "not_null",
    "is_null",
    "matches",
    "between",
    "not_between",
    "in",
    "not_in",
)
DANGEROUS_RATIO = 0.5
RULE_CONFIDENCE = 0.95
CONTRACT_TYPES = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
    "datetime": (T.TimestampType, T.TimestampNTZType),
}
# ---- end of fixed values ----------------------------------------------------

PREFLIGHT = {
    "rule_id": "string",
    "valid": "boolean",
    "schema_valid": "boolean",
    "missing_columns": "array<string>",
    "rows_tested": "bigint",
    "failures": "bigint",
    "failure_ratio": "double",
    "dangerous": "boolean",
    "error": "string",
}


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: object = None


@dataclass(frozen=True)
class Rule:
    """What is expected of the data; rows breaking the expectation are violations.

    Instead of ``when``, ``predicate`` is an expression of ``veritable.functions.expressions``, which is total: a row
    on which it fails is not a violation.  ``expression`` is a boolean Spark SQL expression; a row for which it is NULL
    is not a violation, and one on which it raises an error makes the rule fail.
    """

    id: str
    when: Condition | None = None
    columns: tuple[str, ...] = ()
    severity: str = "medium"
    version: str = "1"
    description: str = ""
    expression: str | None = None
    predicate: str | None = None


def _literal(df: DataFrame, name: str, value: object) -> Column:
    """Rule values arrive as JSON; compare them in the type of the column."""
    return F.lit(value).cast(df.schema[name].dataType)


def violation(df: DataFrame, condition: Condition) -> Column:
    """true where the expectation is broken (NULL cells break only ``not_null``)."""
    c, op, value = col(condition.column), condition.operator, condition.value
    if op == "not_null":
        return c.isNull()
    if op == "is_null":
        return c.isNotNull()
    if op == "matches":
        return ~c.cast("string").rlike(str(value))
    if op in ("in", "not_in", "between", "not_between"):
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError(f"{op} needs a list of values")
        items = [_literal(df, condition.column, v) for v in value]
        if op in ("between", "not_between"):
            if len(items) != 2:
                raise ValueError(f"{op} needs exactly two values")
            within = c.between(*items)
            return ~within if op == "between" else within
        member = c.isin(*items)
        return ~member if op == "in" else member
    v = _literal(df, condition.column, value)
    broken = {
        "equals": lambda: c != v,
        "not_equals": lambda: c == v,
        "gt": lambda: c <= v,
        "gte": lambda: c < v,
        "lt": lambda: c >= v,
        "lte": lambda: c > v,
    }
    if op not in broken:
        raise ValueError(f"unsupported operator: {op}")
    return broken[op]()


def expression_violation(expression: str) -> Column:
    """A boolean SQL expression that must not be false."""
    return ~F.coalesce(F.expr(expression).cast("boolean"), F.lit(True))


def rule_violation(df: DataFrame, rule: Rule) -> Column:
    if rule.predicate is not None:
        return ~F.coalesce(expressions.compile_expression(df, rule.predicate), F.lit(True))
    if rule.expression is not None:
        return expression_violation(rule.expression)
    if rule.when is None:
        raise ValueError(f"rule {rule.id} has no condition")
    return violation(df, rule.when)


def _missing(df: DataFrame, rule: Rule) -> list[str]:
    needed = set(rule.columns) | ({rule.when.column} if rule.when else set())
    if rule.predicate is not None:
        needed |= set(expressions.names_in(rule.predicate))
    return sorted(needed - set(df.columns))


def _declared_missing(df: DataFrame, rule: Rule) -> list[str]:
    try:
        return _missing(df, rule)
    except expressions.ExpressionError:
        return []


def split_rules(df: DataFrame, rules: Sequence[Rule]):
    """Usable rules with their violation predicate, and a reason for each unusable one."""
    usable: list[tuple[Rule, Column]] = []
    broken: dict[str, str] = {}
    for rule in rules:
        try:
            missing = _missing(df, rule)
            if missing:
                broken[rule.id] = "missing columns: " + ", ".join(missing)
                continue
            predicate = rule_violation(df, rule)
            df.select(predicate)  # analysed here so that a bad expression fails only its own rule
        except Exception as exc:
            broken[rule.id] = f"invalid expression: {exc}"
            continue
        usable.append((rule, predicate))
    return usable, broken


def counted_apart(df: DataFrame, parts: Sequence[tuple[object, Sequence[Column]]], head: Sequence[Column] = ()):
    """Values of aggregates that may fail while rows are read: ``(head values, {key: values}, {key: error})``.

    ``parts`` are keys with the aggregates of each.  All are computed in one read; if that fails, each half by
    itself, down to single parts.
    """
    names = [f"a{i}" for i in range(sum(len(columns) for _, columns in parts))]
    flat = [c for _, columns in parts for c in columns]
    try:
        row = df.agg(F.count(F.lit(1)).alias(ROWS), *head, *(c.alias(n) for c, n in zip(flat, names))).first()
    except Exception as exc:
        if not parts:
            raise
        if len(parts) == 1:
            # What does not belong to the part must stand without it.
            top, _, _ = counted_apart(df, (), head)
            return top, {}, {parts[0][0]: f"{type(exc).__name__}: {exc}"[:500]}
        middle = len(parts) // 2
        top, values, errors = counted_apart(df, parts[:middle], head)
        _, more, faults = counted_apart(df, parts[middle:])
        return top, values | more, errors | faults
    values, at = {}, 0
    for key, columns in parts:
        values[key] = [row[n] for n in names[at : at + len(columns)]]
        at += len(columns)
    top = {k: v for k, v in row.asDict().items() if k not in set(names)}
    return top, values, {}


def preflight(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations of every rule, from one aggregate; one row a rule."""
    usable, broken = split_rules(df, rules)
    # Rules are told apart by their place: two may share an id.
    place = {id(r): i for i, r in enumerate(rules)}
    top, counts, errors = counted_apart(df, [(place[id(r)], [F.count_if(p)]) for r, p in usable])
    rows, entries = top[ROWS], []
    for i, rule in enumerate(rules):
        if i in counts:
            (n,) = counts[i]
            ratio = n / rows if rows else 0.0
            entries.append((rule.id, True, True, [], rows, n, ratio, n > 0 and ratio > DANGEROUS_RATIO, None))
            continue
        missing = [] if i in errors else _declared_missing(df, rule)
        entries.append((rule.id, False, not missing, missing, 0, 0, 0.0, False, errors.get(i) or broken[rule.id]))
    schema = ", ".join(f"{name} {kind}" for name, kind in PREFLIGHT.items())
    return df.sparkSession.createDataFrame(entries, schema)


def approve(df: DataFrame, rules: Sequence[Rule], force: bool = False) -> DataFrame:
    """Run the rules again on the target data; dangerous ones need ``force``."""
    return preflight(df, rules).withColumn(
        "approved", F.col("valid") & (~F.col("dangerous") | F.lit(force))
    )


def example_rows(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], limit: int | None = None):
    """The violating rows of every rule as JSON, from one read; with ``limit``, the first of each rule by key."""
    usable, _ = split_rules(df, rules)
    broken_by = F.array_compact(F.array(*[F.when(p, F.lit(r.id)) for r, p in usable]))
    rows = df.select(
        F.explode(broken_by).alias("rule_id"),
        F.to_json(F.struct("*")).alias("row"),
        *[col(k).alias(f"__key{i}") for i, k in enumerate(keys)],
    )
    if limit is not None:
        w = Window.partitionBy("rule_id").orderBy(*[f"__key{i}" for i in range(len(keys))])
        rows = rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= limit)
    return rows.select("rule_id", "row")


def rule_checks(df: DataFrame, rules: Sequence[Rule]) -> tuple[list[Check], dict[str, str]]:
    """Rules as checks of a scan, plus the rules that could not be run."""
    usable, broken = split_rules(df, rules)
    checks = [
        Check(
            "contract_rule",
            (r.when.column,) if r.when else tuple(r.columns or expressions.names_in(r.predicate or "None")),
            p,
            confidence=RULE_CONFIDENCE,
            severity=r.severity,
            score_ratio=True,
            issue_type=f"rule:{r.id}",
            evidence={"rule_id": r.id, "rule_version": r.version},
            evidence_type="rule_violation",
            version=r.version,
        )
        for r, p in usable
    ]
    return checks, broken


def rules_in_scan(df: DataFrame | Target, rules: Sequence[Rule]) -> DataFrame:
    """Candidates of the rules that could be run."""
    at = target(df)
    checks, _ = rule_checks(at.df, rules)
    if not checks:
        return empty(at.spark)
    top, counts, _ = counted_apart(at.df, [(i, [F.count_if(c.hit)]) for i, c in enumerate(checks)])
    ran = sorted(counts)
    row = [top[ROWS], *(counts[i][0] for i in ran)]
    names = [ROWS, *(f"hit{k}" for k in range(len(ran)))]
    one = at.spark.createDataFrame([tuple(row)], ", ".join(f"{n} bigint" for n in names))
    return report(at, one, [checks[i] for i in ran])


@dataclass(frozen=True)
class ColumnContract:
    """What a column must satisfy; ``checks`` lists further regex / range /
    allowed_values / not_null / unique checks as dicts."""

    type: str | None = None
    nullable: bool = True
    unique: bool = False
    min: float | None = None
    max: float | None = None
    allowed_values: Sequence[str] | None = None
    regex: str | None = None
    checks: Sequence[Mapping] = field(default_factory=tuple)


def _value_checks(name: str, contract: ColumnContract, df: DataFrame) -> list[tuple[str, Column]]:
    c = col(name)
    found: list[tuple[str, Column]] = []
    declared = [
        {"type": "range", "min": contract.min, "max": contract.max},
        {"type": "allowed_values", "allowed_values": contract.allowed_values},
        {"type": "regex", "pattern": contract.regex},
        *([{"type": "not_null"}] if not contract.nullable else []),
        *contract.checks,
    ]
    for check in declared:
        kind = check["type"]
        if kind == "range":
            for bound, bad in (("min", "lt"), ("max", "gt")):
                if check.get(bound) is not None:
                    limit = F.lit(float(check[bound]))
                    found.append((bound, c < limit if bad == "lt" else c > limit))
        elif kind == "allowed_values" and check.get("allowed_values") is not None:
            members = [_literal(df, name, v) for v in check["allowed_values"]]
            found.append((kind, ~c.isin(*members)))
        elif kind == "regex" and check.get("pattern"):
            # Contract patterns are anchored at the start of the value.
            found.append((kind, ~c.cast("string").rlike("^(?:" + check["pattern"] + ")")))
        elif kind == "not_null":
            found.append((kind, c.isNull()))
    return found


def check_contract(df: DataFrame, contract: Mapping[str, ColumnContract]) -> DataFrame:
    """One row per declared column check with its violations.

    Value checks share one aggregate; uniqueness comes from the frequency table
    (redundant rows); type and presence are read off the schema.
    """
    spark = df.sparkSession
    present = {n: c for n, c in contract.items() if n in df.columns}
    counted = [(n, kind, p) for n, c in present.items() for kind, p in _value_checks(n, c, df)]
    entries = [
        F.struct(
            F.lit(n).alias("column"), F.lit(kind).alias("check"), F.col(f"v{i}").alias("violations")
        )
        for i, (n, kind, _) in enumerate(counted)
    ]
    static = []
    for n, c in contract.items():
        if n not in df.columns:
            static.append((n, "present", 1))
        elif c.type in CONTRACT_TYPES:
            right = isinstance(df.schema[n].dataType, CONTRACT_TYPES[c.type])
            static.append((n, "type", 0 if right else 1))
    parts = [spark.createDataFrame(static, "column string, check string, violations bigint")]
    if counted:
        row = df.agg(*[F.count_if(p).alias(f"v{i}") for i, (_, _, p) in enumerate(counted)])
        parts.append(row.select(F.inline(F.array(*entries))))
    unique = [
        n
        for n, c in present.items()
        if c.unique or any(k["type"] == "unique" for k in c.checks)
    ]
    if unique:
        totals = value_counts(df, unique).groupBy("column").agg(
            F.sum(F.col("n") - 1).alias("violations")
        )
        names = spark.createDataFrame([(n,) for n in unique], "column string")
        parts.append(
            names.join(totals, "column", "left").select(
                "column", F.lit("unique").alias("check"), F.coalesce("violations", F.lit(0)).alias("violations")
            )
        )
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)
