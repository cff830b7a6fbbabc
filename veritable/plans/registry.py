"""Detector registry (E02) and user detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from veritable.operators import (
    categorical,
    completeness,
    cross,
    dates,
    model_outlier,
    numeric,
    text_format,
    uniqueness,
)
from veritable.operators.checks import Check, Target

# ---- fixed values: registration order and declared dimension ----------------
ORDER = (
    "excessive_null_rate",
    "suspicious_missing_token",
    "sudden_missingness",
    "group_missingness",
    "conditional_missingness",
    "correlated_missingness",
    "uniqueness_violation",
    "fuzzy_duplicate",
    "suspicious_placeholder",
    "rare_category",
    "category_explosion",
    "inconsistent_case",
    "leading_or_trailing_whitespace",
    "repeated_whitespace",
    "hidden_control_character",
    "unusual_length",
    "invalid_email",
    "invalid_phone",
    "invalid_url",
    "invalid_ip",
    "iqr_outlier",
    "percentile_outlier",
    "modified_zscore",
    "tail_probability",
    "histogram_rarity",
    "suspicious_formula_injection",
    "cross_field_rule",
    "invalid_date",
    "impossible_date",
    "future_date",
    "stale_date",
    "mixed_date_format",
    "duplicate_timestamp",
    "spelling_variant",
    "fullwidth_character",
    "mojibake_character",
    "invalid_numeric",
    "foreign_key_violation",
    "model_outlier",
)
DIMENSIONS = {
    "completeness": ORDER[:6],
    "uniqueness": ORDER[6:8],
    "integrity": ("foreign_key_violation",),
    "distribution_stability": ("model_outlier",),
}
NOT_SAMPLED = ("foreign_key_violation",)
# ---- end of fixed values ----------------------------------------------------

_BUILT_IN = {
    name: fn
    for module in (
        completeness,
        uniqueness,
        categorical,
        text_format,
        numeric,
        dates,
        cross,
        model_outlier,
    )
    for name, fn in module.DETECTORS.items()
}


@dataclass(frozen=True)
class Detector:
    """A detector: either ``detect(target) -> candidates`` or declarative ``checks``.

    ``checks(df)`` returns counted predicates, which join the shared aggregate of a
    scan; ``detect`` is any function from the table to candidate rows.
    """

    detector_id: str
    dimension: str = "validity"
    detect: Callable[[Target], DataFrame] | None = None
    checks: Callable[[DataFrame], Sequence[Check]] | None = None
    supports: Callable[[DataFrame], bool] = lambda df: bool(df.columns)
    supports_sampling: bool = True
    enabled: bool = True


def counted(
    detector_id: str,
    choose: Callable[[DataFrame], Iterable[str]],
    predicate: Callable[[Column], Column],
    *,
    confidence: float = 0.9,
    severity: str = "low",
    dimension: str = "validity",
) -> Detector:
    """A user detector from a column selector and a row predicate."""
    from veritable.functions.columns import col

    def checks(df: DataFrame) -> list[Check]:
        return [
            Check(detector_id, (c,), predicate(col(c)), confidence=confidence, severity=severity)
            for c in choose(df)
        ]

    return Detector(detector_id, dimension, checks=checks, supports=lambda df: bool(list(choose(df))))


def _dimension(detector_id: str) -> str:
    for dimension, members in DIMENSIONS.items():
        if detector_id in members:
            return dimension
    return "validity"


@dataclass
class Registry:
    detectors: dict[str, Detector] = field(default_factory=dict)

    def register(self, detector: Detector) -> None:
        if detector.detector_id in self.detectors:
            raise ValueError(f"duplicate detector id: {detector.detector_id}")
        self.detectors[detector.detector_id] = detector

    def get(self, detector_id: str) -> Detector:
        return self.detectors[detector_id]

    def list(
        self,
        only: Sequence[str] | None = None,
        supports_sampling: bool | None = None,
    ) -> list[Detector]:
        """Enabled detectors in registration order, by whitelist and capability."""
        return [
            d
            for d in self.detectors.values()
            if d.enabled
            and (only is None or d.detector_id in only)
            and (supports_sampling is None or d.supports_sampling == supports_sampling)
        ]

    def table(self, spark) -> DataFrame:
        rows = [
            (i, d.detector_id, d.dimension, d.supports_sampling, d.enabled)
            for i, d in enumerate(self.detectors.values())
        ]
        return spark.createDataFrame(
            rows,
            "ordinal int, detector_id string, dimension string, supports_sampling boolean, enabled boolean",
        )


def default_registry() -> Registry:
    registry = Registry()
    for name in ORDER:
        registry.register(
            Detector(
                name,
                _dimension(name),
                detect=_BUILT_IN[name],
                supports_sampling=name not in NOT_SAMPLED,
            )
        )
    return registry
