"""Encoders and scalers. Each is a pair: a fit that gives plain data, and a column made from that data."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc

FOLDS, WEIGHT = 5, 10.0
SKEWED = 1.0
#: Up to so many entries a mapping is part of the projection; beyond, it is joined.
LITERAL_ENTRIES = 200


def distinct_values(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """The sorted values of columns of few values, all in one pass."""
    if not columns:
        return {}
    row = df.agg(*(F.sort_array(F.collect_set(fc.named(c))).alias(f"v{i}") for i, c in enumerate(columns))).first()
    return {c: list(row[i]) for i, c in enumerate(columns)}


def ordinal(c: Column, values: list) -> Column:
    """The place among the sorted values, -1 for others and for NULL."""
    if not values:
        return F.lit(-1)
    table = F.create_map(*(x for i, v in enumerate(values) for x in (F.lit(str(v)), F.lit(i))))
    return F.coalesce(F.try_element_at(table, c.cast("string")), F.lit(-1))


def one_hot(c: Column, name: str, values: list) -> list[Column]:
    """A boolean column for each value, in order of their names; all are False for NULL and for other values."""
    return [
        F.coalesce(c.cast("string") == F.lit(str(v)), F.lit(False)).alias(f"{name}_{v}")
        for v in sorted(values, key=lambda v: f"{name}_{v}")
    ]


def target_sums(df: DataFrame, category: Column, target: Column, fold: Column | None = None) -> DataFrame:
    """(category, fold, n, total): aggregated before anything is shuffled, so a frequent category costs nothing."""
    keys = [category.alias("category")] + ([fold.alias("fold")] if fold is not None else [])
    return df.where(category.isNotNull() & target.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fc.number(target)).alias("total")
    )


def cross_fit(
    df: DataFrame, columns: list[str], target: Column, fold: Column, weight: float = WEIGHT
) -> DataFrame:
    """Each of the columns becomes the smoothed mean of the target over the rows of its category in the other folds.

    Sums by category and fold are a small table next to the rows; what a row needs is its category's total less that of
    its own fold. Categories seen in one fold only, and NULL, get the overall mean of the whole table.
    """
    names = df.columns
    overall = df.agg(F.avg(fc.number(target))).first()[0]
    mean = F.lit(0.0 if overall is None else float(overall))
    rows = df.withColumn("__fold", fold)
    for i, c in enumerate(columns):
        by_fold = target_sums(rows, fc.named(c), target, F.col("__fold"))
        whole = by_fold.groupBy("category").agg(F.sum("n").alias("all_n"), F.sum("total").alias("all_total"))
        others = by_fold.join(whole, "category").select(
            F.col("category").alias(f"__c{i}"),
            F.col("fold").alias(f"__f{i}"),
            fc.smoothed_mean(
                F.col("all_n") - F.col("n"), F.col("all_total") - F.col("total"), mean, weight
            ).alias(f"__e{i}"),
        )
        rows = rows.join(others, (fc.named(c) == others[f"__c{i}"]) & (rows["__fold"] == others[f"__f{i}"]), "left")
    encoded = {c: F.coalesce(F.col(f"__e{i}"), mean) for i, c in enumerate(columns)}
    return rows.select(*(encoded.get(c, fc.named(c)).alias(c) for c in names))


def target_mapping(df: DataFrame, column: str, target: Column, weight: float = WEIGHT) -> tuple[DataFrame, float]:
    """(category, value) over the whole table, and the overall mean."""
    overall = df.agg(F.avg(fc.number(target))).first()[0] or 0.0
    value = fc.smoothed_mean(F.col("n"), F.col("total"), F.lit(float(overall)), weight)
    return target_sums(df, fc.named(column), target).select("category", value.alias("value")), float(overall)


def mapped(df: DataFrame, column: str, mapping: DataFrame, default: float) -> DataFrame:
    """A column through a table (category, value) by a left join; Spark broadcasts the table if it is small."""
    table = mapping.select(F.col("category").cast("string").alias("__category"), F.col("value").alias("__value"))
    joined = df.join(table, fc.named(column).cast("string") == F.col("__category"), "left")
    value = F.coalesce(F.col("__value"), F.lit(float(default)))
    return joined.select(*((value if c == column else fc.named(c)).alias(c) for c in df.columns))


def label_index(values: list) -> dict[str, int]:
    """Numbers for the classes of a target that is no number, in sorted order."""
    return {str(v): i for i, v in enumerate(sorted(values, key=str))}


def indexed(c: Column, index: dict[str, int]) -> Column:
    table = F.create_map(*(x for v, i in index.items() for x in (F.lit(v), F.lit(float(i)))))
    return F.try_element_at(table, c.cast("string"))


def fit_linear(df: DataFrame, columns: list[str]) -> dict[str, dict[str, Any]]:
    """For each number: whether it is to be taken the logarithm of, and its mean and deviation after that."""
    if not columns:
        return {}
    asked = []
    for i, c in enumerate(columns):
        x = fc.number(fc.named(c))
        logged = F.when(x > -1, F.log1p(x))
        asked += [
            F.min(x).alias(f"l{i}"), skewness(x).alias(f"k{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
            F.avg(logged).alias(f"n{i}"), F.stddev_samp(logged).alias(f"t{i}"),
        ]
    row = df.agg(*asked).first()
    out = {}
    for i, c in enumerate(columns):
        low, skew, mean, std, log_mean, log_std = (row[f"{k}{i}"] for k in "lkmsnt")
        log = skew is not None and abs(skew) > SKEWED and low > -1
        mean, std = (log_mean, log_std) if log else (mean, std)
        out[c] = {"log1p": bool(log), "mean": mean if std else 0.0, "std": std or 1.0, "skewness": skew}
    return out


def skewness(x: Column) -> Column:
    """Population skewness; NULL where nothing varies."""
    return F.when(F.stddev_pop(x) > 0, F.skewness(x))


def linear(c: Column, fitted: dict[str, Any]) -> Column:
    x = fc.number(c)
    if fitted["log1p"]:
        x = F.when(x > -1, F.log1p(x))
    return (x - F.lit(float(fitted["mean"]))) / F.lit(float(fitted["std"]))


def date_parts(c: Column, name: str) -> list[Column]:
    day = F.weekday(c)
    hour = F.hour(c.cast("timestamp"))
    parts = {
        "year": F.year(c), "month": F.month(c), "day": F.day(c), "dayofweek": day, "hour": hour, "is_weekend": day >= 5,
    }
    return [x.alias(f"{name}_{k}") for k, x in parts.items()]
