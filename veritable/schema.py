"""Row shapes of the result tables and the fixed values behind scoring."""

from __future__ import annotations

from pyspark.sql import types as T

CANDIDATE = T.StructType(
    [
        T.StructField("issue_type", T.StringType()),
        T.StructField("detector_id", T.StringType()),
        T.StructField("detector_version", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("affected_count", T.LongType()),
        T.StructField("affected_rows", T.ArrayType(T.StringType())),
        T.StructField("raw_score", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("fpr", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("evidence", T.StringType()),
    ]
)

DETECTOR_RUN = T.StructType(
    [
        T.StructField("scan_run_id", T.StringType()),
        T.StructField("detector_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rows_scanned", T.LongType()),
        T.StructField("rows_total", T.LongType()),
        T.StructField("sampled", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

SCAN_RUN = T.StructType(
    [
        T.StructField("scan_run_id", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("rows_scanned", T.LongType()),
        T.StructField("schema_hash", T.StringType()),
        T.StructField("statistics_fingerprint", T.StringType()),
        T.StructField("content_fingerprint", T.StringType()),
        T.StructField(
            "column_signature",
            T.ArrayType(
                T.StructType(
                    [T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]
                )
            ),
        ),
        T.StructField("issues_count", T.MapType(T.StringType(), T.LongType())),
        T.StructField("overall", T.DoubleType()),
        T.StructField("dimensions", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("config", T.StringType()),
    ]
)

# ---- fixed values: severities, weights, families, dimensions ----------------
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_WEIGHT = {"info": 0.1, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
CRITICALITY_WEIGHT = {"informational": 0.6, "normal": 1.0, "important": 1.3, "critical": 1.6}
PRIORITY_WEIGHT = {
    "severity": 10.0,
    "confidence": 25.0,
    "affected_scope": 15.0,
    "criticality": 10.0,
    "reproducibility": 5.0,
    "agreement": 15.0,
    "novelty": 10.0,
    "repairability": 10.0,
}
DIMENSION_WEIGHT = {
    "completeness": 0.20,
    "validity": 0.20,
    "uniqueness": 0.15,
    "consistency": 0.20,
    "integrity": 0.15,
    "timeliness": 0.10,
}
DIMENSION_FOLD = {"accuracy_proxy": "validity", "distribution_stability": "integrity"}
FAMILY_MEMBERS = {
    "missingness": (
        "excessive_null_rate",
        "suspicious_missing_token",
        "sudden_missingness",
        "group_missingness",
        "conditional_missingness",
        "correlated_missingness",
    ),
    "uniqueness": ("uniqueness_violation", "fuzzy_duplicate"),
    "categorical_anomaly": (
        "suspicious_placeholder",
        "rare_category",
        "category_explosion",
        "inconsistent_case",
    ),
    "string_format": (
        "leading_or_trailing_whitespace",
        "repeated_whitespace",
        "hidden_control_character",
        "unusual_length",
        "invalid_email",
        "invalid_phone",
        "invalid_url",
        "invalid_ip",
        "suspicious_formula_injection",
        "spelling_variant",
        "fullwidth_character",
        "mojibake_character",
        "invalid_numeric",
    ),
    "numeric_outlier": (
        "iqr_outlier",
        "percentile_outlier",
        "modified_zscore",
        "tail_probability",
        "histogram_rarity",
    ),
    "datetime_anomaly": (
        "invalid_date",
        "impossible_date",
        "future_date",
        "stale_date",
        "mixed_date_format",
        "duplicate_timestamp",
    ),
    "cross_field_constraint": ("cross_field_violation",),
    "integrity_constraint": ("foreign_key_violation",),
    "distribution_anomaly": ("model_outlier",),
}
FAMILY_DIMENSION = {
    "missingness": "completeness",
    "uniqueness": "uniqueness",
    "categorical_anomaly": "validity",
    "string_format": "validity",
    "numeric_outlier": "validity",
    "datetime_anomaly": "validity",
    "cross_field_constraint": "validity",
    "integrity_constraint": "integrity",
    "distribution_anomaly": "distribution_stability",
}
# ---- end of fixed values ----------------------------------------------------

FAMILY_OF = {member: family for family, members in FAMILY_MEMBERS.items() for member in members}

# How an issue of each family is headed.
FAMILY_TITLE = {
    "missingness": "Gaps",
    "uniqueness": "Repeated values",
    "categorical_anomaly": "Odd categories",
    "string_format": "Malformed text",
    "numeric_outlier": "Unusual numbers",
    "datetime_anomaly": "Doubtful dates",
    "cross_field_constraint": "Columns at odds with each other",
    "integrity_constraint": "Broken references",
    "distribution_anomaly": "Values far from the rest",
}
