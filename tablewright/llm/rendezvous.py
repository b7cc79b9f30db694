"""Weighted rendezvous sharding with DataFrame functions alone.

Every (key, shard) pair gets a uniform number u from a hash of the key and the shard, and a row goes to the shard of
largest ``weight / -ln(u)``. A new shard competes with scores of its own and changes nobody else's, so it only takes
rows into itself, on average its share by weight. The choice is a projection: no shuffle and no state.

Places inside shards (``slot``, the key's rank) are numbered in small cells, ranges of keys, and shifted
(``ranked_within``), so a shard with any share of the rows is never sorted in one task.

Defined results: a null key is a key like any other (the text "null" is not it); a null text has size 1 and the crc32
of no bytes; repeated rows get the same shard and different slots; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions, ranked_within

#: Hex digits of the hash that make u: 52 bits, which a double holds exactly.
DIGITS = 13


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide, the same in every engine with md5."""
    digest = F.md5(F.concat(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")), F.lit(f":{shard}")))
    number = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return (number + 0.5) / float(16**DIGITS)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the best score; of equal scores the first one."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    scored = [
        F.struct((F.log(uniform(key, i)) / float(w)).alias("score"), F.lit(-i).alias("at"))
        for i, w in enumerate(weights)
    ]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["at"]).cast("int")


def rendezvous_shards(
    df: DataFrame, key: str, weights: list[float], grown: list[float] | None = None, carry: tuple[Column, ...] = ()
) -> DataFrame:
    """One row for each row of df: key, ``carry``, ``shard``, ``slot`` and, with ``grown`` weights, ``grown_shard``."""
    out = df.select(
        F.col(key),
        *carry,
        shard_of(F.col(key), weights).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    # by ranges of the key, so that a slot is the key's rank in its shard; the tag splits a key with very many rows
    ranged = out.withColumn("__tag", F.monotonically_increasing_id()).repartitionByRange(
        partitions(df.sparkSession), key, "__tag"
    )
    return ranked_within(checkpointed(ranged), ["shard"], "slot", [key, "__tag"]).drop("__tag")
