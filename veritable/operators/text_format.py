"""Text format detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.functions import predicates as P
from veritable.functions.columns import (
    EMAIL_HINTS,
    NUMERIC_EXEMPT_HINTS,
    NUMERIC_HINTS,
    PHONE_HINTS,
    URL_HINTS,
    col,
    hinted,
    ip_columns,
    string_columns,
    unhinted,
)
from veritable.operators.checks import Check, Target, candidate, evidence_json, run_checks, target
from veritable.operators.frequency import top_per_column, value_counts

# ---- fixed values: thresholds ----------------------------------------------
VARIANT_RATE, VARIANT_KEYS = 0.001, 2
NOT_NUMERIC_COUNT, NOT_NUMERIC_RATE = 2, 0.01
# ---- end of fixed values ----------------------------------------------------

_SAMPLE_KEYS = 10


def _names(hints) -> Callable:
    return lambda names: hinted(names, hints)


def _numeric_names(names):
    return unhinted(hinted(names, NUMERIC_HINTS), NUMERIC_EXEMPT_HINTS)


# detector: (predicate, which string columns, confidence, further Check fields)
_COUNTED = {
    "leading_or_trailing_whitespace": (P.has_outer_space, None, 0.98, {}),
    "repeated_whitespace": (P.has_repeated_space, None, 0.95, {}),
    "hidden_control_character": (P.has_control_character, None, 0.98, {"severity": "medium"}),
    "unusual_length": (P.is_long, None, 0.9, {}),
    "invalid_email": (P.is_bad_email, _names(EMAIL_HINTS), 0.85, {}),
    "invalid_phone": (P.is_bad_phone, _names(PHONE_HINTS), 0.9, {}),
    "invalid_url": (P.is_bad_url, _names(URL_HINTS), 0.9, {}),
    "invalid_ip": (P.is_bad_ipv4, ip_columns, 0.95, {}),
    "suspicious_formula_injection": (P.has_formula_prefix, None, 0.95, {}),
    "fullwidth_character": (P.has_fullwidth, None, 0.9, {}),
    "mojibake_character": (P.has_replacement_character, None, 0.95, {"fpr": 0.05}),
    "invalid_numeric": (
        P.is_not_numeric_text,
        _numeric_names,
        0.85,
        {
            "severity": "medium",
            "fpr": 0.15,
            "min_count": NOT_NUMERIC_COUNT,
            "at_least": NOT_NUMERIC_RATE,
            "score_ratio": True,
        },
    ),
}


def text_checks(detector_id: str, df: DataFrame, cols=None) -> list[Check]:
    predicate, choose, confidence, more = _COUNTED[detector_id]
    names = string_columns(df, cols)
    names = choose(names) if choose else names
    fields = {"severity": "low", **more}
    return [
        Check(detector_id, (c,), predicate(col(c)), confidence=confidence, **fields) for c in names
    ]


def _counted(detector_id: str):
    def detect(df: DataFrame | Target, cols=None) -> DataFrame:
        at = target(df)
        return run_checks(at, text_checks(detector_id, at.df, cols))

    detect.__name__ = detector_id
    return detect


leading_or_trailing_whitespace = _counted("leading_or_trailing_whitespace")
repeated_whitespace = _counted("repeated_whitespace")
hidden_control_character = _counted("hidden_control_character")
unusual_length = _counted("unusual_length")
invalid_email = _counted("invalid_email")
invalid_phone = _counted("invalid_phone")
invalid_url = _counted("invalid_url")
invalid_ip = _counted("invalid_ip")
suspicious_formula_injection = _counted("suspicious_formula_injection")
fullwidth_character = _counted("fullwidth_character")
mojibake_character = _counted("mojibake_character")
invalid_numeric = _counted("invalid_numeric")


def spelling_variant(df: DataFrame | Target, cols=None, freq=None, rows: int | None = None):
    """Values that differ only in separators or case, over all distinct values."""
    at = target(df)
    names = string_columns(at.df, cols)
    freq = freq if freq is not None else value_counts(at.df, names)
    rows = at.df.count() if rows is None else rows
    keys = (
        freq.filter(F.col("column").isin(names))
        .withColumn("key", P.variant_key(F.col("value")))
        .filter("key <> ''")
        .groupBy("column", "key")
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("spellings"))
        .filter("spellings >= 2")
    )
    frequent = F.col("rows") / F.lit(float(rows or 1)) >= VARIANT_RATE
    per_column = (
        keys.groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("keys"),
            F.sum(F.when(frequent, F.col("rows"))).alias("affected"),
            F.count_if(frequent).alias("flagged"),
        )
        .filter((F.col("keys") >= VARIANT_KEYS) & (F.col("flagged") > 0))
    )
    shown = (
        top_per_column(keys.filter(frequent), _SAMPLE_KEYS, F.desc("rows"), F.asc("key"))
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "key", "rows", "spellings"))).alias("top"))
    )
    # One row per column on both sides.
    return per_column.join(F.broadcast(shown), "column").select(
        *candidate(
            at,
            issue_type="spelling_variant",
            detector_id="spelling_variant",
            columns=F.array("column"),
            affected=F.col("affected"),
            raw=F.col("affected") / F.lit(float(rows or 1)),
            confidence=0.8,
            fpr=0.2,
            severity="low",
            evidence=evidence_json(
                "pattern_match", {"flagged_keys": F.col("flagged"), "variants": F.col("top")}
            ),
        )
    )


COUNTED = tuple(_COUNTED)
DETECTORS = {
    "leading_or_trailing_whitespace": leading_or_trailing_whitespace,
    "repeated_whitespace": repeated_whitespace,
    "hidden_control_character": hidden_control_character,
    "unusual_length": unusual_length,
    "invalid_email": invalid_email,
    "invalid_phone": invalid_phone,
    "invalid_url": invalid_url,
    "invalid_ip": invalid_ip,
    "suspicious_formula_injection": suspicious_formula_injection,
    "spelling_variant": spelling_variant,
    "fullwidth_character": fullwidth_character,
    "mojibake_character": mojibake_character,
    "invalid_numeric": invalid_numeric,
}
