"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one of so many rows: there are at most so many heavy keys, whatever the data.
SHARE = 1000
#: So many rows of one key are no burden to a task.
LIGHT = 256


def heavy_keys(counts: DataFrame, keys: list[str], n: str, parts: int) -> DataFrame | None:
    """(*keys, __parts) for the heavy keys of a table of (*keys, n), one row a key: into how many parts each is to be
    split so that no part exceeds the usual task's share. At most ``SHARE`` rows, which bounds what is broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(LIGHT, total // SHARE)
    found = counts.where(F.col(n) > least).select(
        *keys, F.least(F.lit(parts), F.ceil(F.col(n) * parts / F.lit(max(1, total))) + 1).cast("int").alias("__parts")
    )
    rows = found.limit(SHARE).collect()  # by arithmetic there cannot be more
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def skewed_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, n: str = "count"
) -> DataFrame:
    """``left.join(right, keys, how)`` for inner and left joins in which few keys may hold most of ``left``, and
    ``right`` has few rows a key. Rows of heavy keys are dealt out over several tasks by a hash of the whole row, and
    right's rows of those keys are copied to each. ``counts`` (*keys, n) saves counting left's keys."""
    spark = left.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = counts if counts is not None else left.groupBy(*keys).count()
    heavy = heavy_keys(counted, keys, n, parts)
    if heavy is None:
        return left.join(right, keys, how)
    heavy = F.broadcast(heavy)
    names = [c for c in left.columns if c not in keys]
    own = F.xxhash64(*(F.col(f"`{c}`") for c in names)) if names else F.monotonically_increasing_id()
    missing = reduce(or_, (F.col(f"`{k}`").isNull() for k in keys))  # such rows meet nothing, wherever they are
    dealt = left.join(heavy, keys, "left").withColumn(
        "__salt", F.pmod(own, F.when(missing, F.lit(parts)).otherwise(F.coalesce("__parts", F.lit(1)))).cast("int")
    ).drop("__parts")
    copied = right.join(heavy, keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))
    ).drop("__parts")
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")
