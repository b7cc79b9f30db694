"""Spark-first table preparation: profile, clean, engineer, and replay frozen decisions."""

from .api import add_features, clean, compare, engineer, prepare, profile, run_engineer
from .compare_report import save_compare_pdf
from .operators.cleaning import run_cleaner
from .operators.profiling import run_profiler
from .plans.model import NotFittedError, PrepModel
from .report import Report
from .types import PRESETS, ColumnProfile, FeatureConfig, PrepResult, ReportEntry, SemanticType

__version__ = "0.1.0"
__all__ = [
    "PRESETS", "ColumnProfile", "FeatureConfig", "NotFittedError", "PrepModel", "PrepResult", "Report", "ReportEntry",
    "SemanticType", "add_features", "clean", "compare", "engineer", "prepare", "profile", "run_cleaner", "run_engineer",
    "run_profiler", "save_compare_pdf",
]
