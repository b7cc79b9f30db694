"""The plain data that the engine passes around: semantic types, profiles, log entries, settings, results."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import TYPE_CHECKING, Any

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .plans.model import PrepModel
    from .report import Report

STAGES = ("profiler", "cleaner", "engineer")
SEVERITIES = ("critical", "warning", "info")
INTERACTION_TYPES = ("ratio", "product", "difference")


class SemanticType(Enum):
    NUMERIC_FEATURE = "numeric_feature"
    NUMERIC_ID = "numeric_id"
    CATEGORICAL_LOW = "categorical_low"
    CATEGORICAL_HIGH = "categorical_high"
    DATETIME_STRING = "datetime_string"
    DATETIME_NATIVE = "datetime_native"
    BOOLEAN = "boolean"
    CONSTANT = "constant"
    TEXT = "text"


@dataclass
class ColumnProfile:
    """What is known of a column; None means that it was not computed."""

    name: str
    semantic_type: SemanticType
    missing_rate: float
    dtype: str
    outlier_rate: float | None = None
    cardinality: int | None = None
    rare_categories: list[str] | None = None
    vif_score: float | None = None
    correlation_with_target: float | None = None
    mutual_info_with_target: float | None = None
    is_leakage_suspect: bool = False
    text_avg_length: float | None = None
    text_avg_word_count: float | None = None
    text_missing_rate: float | None = None


@dataclass
class ReportEntry:
    """One decision."""

    stage: str
    column: str
    action: str
    rationale: str
    severity: str
    before_stats: dict[str, Any] = field(default_factory=dict)
    after_stats: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.stage not in STAGES:
            raise ValueError(f"stage must be one of {STAGES}, got {self.stage!r}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}, got {self.severity!r}")


@dataclass(frozen=True)
class FeatureConfig:
    """Which features to add; all are off unless asked for."""

    interactions: bool = False
    interaction_top_k: int = 5
    interaction_types: list[str] = field(default_factory=lambda: ["ratio", "product"])
    datetime_cyclical: bool = False
    datetime_deltas: bool = False
    datetime_reference_col: str | None = None
    clustering: bool = False
    cluster_k: int | str = "auto"
    cluster_features: str | list[str] = "numeric_only"
    text_features: bool = False
    text_tfidf: bool = False
    text_tfidf_top_k: int = 20

    def __post_init__(self):
        for name in ("interaction_top_k", "text_tfidf_top_k"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a whole number of at least 1, got {value!r}")
        if wrong := [t for t in self.interaction_types if t not in INTERACTION_TYPES]:
            raise ValueError(f"interaction_types may hold {INTERACTION_TYPES}, got {wrong}")
        k = self.cluster_k
        if k != "auto" and (isinstance(k, bool) or not isinstance(k, int) or k < 1):
            raise ValueError(f"cluster_k must be 'auto' or a positive whole number, got {k!r}")
        named = self.cluster_features
        if named != "numeric_only" and not (isinstance(named, list) and all(isinstance(x, str) for x in named)):
            raise ValueError(f"cluster_features must be 'numeric_only' or a list of column names, got {named!r}")

    @property
    def active(self) -> bool:
        return any(
            (
                self.interactions, self.datetime_cyclical, self.datetime_deltas, self.datetime_reference_col,
                self.clustering, self.text_features, self.text_tfidf,
            )
        )


@dataclass
class PrepResult:
    df: DataFrame
    pipeline: PrepModel | None = None
    report: Report | None = None


PRESETS: dict[str, dict[str, Any]] = {
    "fast": {
        "drop_threshold": 0.8,
        "outlier_method": "zscore",
        "cardinality_threshold": 50,
        "feature_config": None,
    },
    "thorough": {
        "drop_threshold": 0.2,
        "outlier_method": "iqr",
        "cardinality_threshold": 20,
        "feature_config": FeatureConfig(
            interactions=True,
            datetime_cyclical=True,
            datetime_deltas=True,
            clustering=True,
            text_features=True,
            text_tfidf=True,
        ),
    },
}
