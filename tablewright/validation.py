"""Checks at the entrance, in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import columns as fc
from .types import SemanticType

MOST_CLASSES, CLASS_SHARE = 20, 0.05


def as_spark(df):
    """A pandas table as a Spark table of the active session; anything else as it is."""
    if type(df).__module__.split(".")[0] != "pandas" or type(df).__name__ != "DataFrame":
        return df
    if df.columns.duplicated().any():
        raise ValueError("The DataFrame has duplicate column names; each name may stand once.")
    if df.empty:
        raise ValueError("The DataFrame is empty; it needs one row and one column at least.")
    import pandas as pd
    from pyspark.sql import SparkSession

    out = df.reset_index(drop=True).copy()
    out.columns = out.columns.map(str)
    for c in out.columns:
        if isinstance(out[c].dtype, pd.CategoricalDtype):
            out[c] = out[c].astype(object)
        if out[c].dtype == object:
            present = out[c].dropna()
            kinds = {type(x) for x in present}
            if kinds - {bool} or not kinds:  # texts, and what is mixed or missing altogether
                out[c] = out[c].map(str, na_action="ignore").astype(object).where(out[c].notna(), None)
    spark = SparkSession.builder.getOrCreate()
    types = {c: "string" for c in out.columns if out[c].dtype == object and out[c].isna().all()}
    for c in types:
        out[c] = ""
    made = spark.createDataFrame(out)
    return made.withColumns({c: F.lit(None).cast("string") for c in types}) if types else made


def check_inputs(
    df: DataFrame,
    target: str,
    task: str,
    model_hint: str | None = None,
    column_types: dict[str, SemanticType] | None = None,
) -> str | None:
    """Raises on what cannot be worked with; returns a warning if the target looks odd for the task."""
    if not isinstance(df, DataFrame):
        raise TypeError("The first argument must be a Spark DataFrame.")
    if df.isEmpty():
        raise ValueError("The DataFrame is empty; it needs one row at least.")
    if target not in df.columns:
        raise ValueError(f"The target column '{target}' does not exist in the DataFrame.")
    if len(df.columns) < 2:
        raise ValueError("The DataFrame has only one column; it needs a feature besides the target.")
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("The DataFrame has duplicate column names; each name may stand once.")
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true" and len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("Column names differ only in case; rename them, or set spark.sql.caseSensitive to true.")
    if task not in ("classification", "regression"):
        raise ValueError(f"The task must be 'classification' or 'regression', not '{task}'.")
    if model_hint is not None and model_hint not in ("tree", "linear"):
        raise ValueError(f"The model_hint must be 'tree' or 'linear', not '{model_hint}'.")
    warning = check_target(df, target, task)
    for name, kind in (column_types or {}).items():
        if name == target:
            raise ValueError(f"The type of the target column '{name}' cannot be set.")
        if name not in df.columns:
            raise ValueError(f"A type was given for the column '{name}', which does not exist.")
        if not isinstance(kind, SemanticType):
            raise ValueError(f"The type given for '{name}' is none of {', '.join(t.name for t in SemanticType)}.")
    return warning


def target_counts(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, and distinct values of the target."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(fc.named(target)).alias("n_unique"))


def check_target(df: DataFrame, target: str, task: str) -> str | None:
    kind = df.schema[target].dataType
    numeric = fc.is_numeric(kind) or fc.is_bool(kind)
    rows, unique = target_counts(df, target).first()
    if task == "classification":
        if numeric and unique > MOST_CLASSES and unique > CLASS_SHARE * rows:
            raise ValueError(
                f"The target column '{target}' looks continuous ({unique} unique values); "
                "for a number the task is 'regression'."
            )
        return None
    if not numeric:
        return f"The target '{target}' has the non-numeric type {kind.simpleString()}, but the task is regression."
    if unique <= MOST_CLASSES:
        return f"The target '{target}' has only {unique} unique values, but the task is regression."
    return None
