"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import skewed_join
from .common import checkpointed

#: Up to so many different edges (measured) a graph is finished by one task instead of in rounds of shuffles.
ONE_TASK = 1_000_000


def _least(pairs: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the least of u and all its v. A node with very many neighbours is aggregated before it is
    shuffled, and its rows are dealt out over several tasks for the join."""
    found = checkpointed(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    return skewed_join(pairs, found.select("u", F.least("u", "m").alias("m")), ["u"], counts=found, n="n")


def _at_once(edges: DataFrame) -> DataFrame:
    """A graph of at most ``ONE_TASK`` edges, as (node, component): labels sink along edges and their own pointers."""
    kind = edges.schema["u"].dataType
    ddl = f"node {kind.simpleString()}, component {kind.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = list(batches)
        if not sum(len(b) for b in held):
            return
        held = pa.Table.from_batches(held)
        ends = pa.concat_arrays([*held.column(0).chunks, *held.column(1).chunks])
        order = ends.unique().sort()
        codes = pc.index_in(ends, order).to_numpy(zero_copy_only=False).astype(np.int64)
        u, v = codes[: len(held)], codes[len(held) :]
        label = np.arange(len(order))
        while True:
            before = label.copy()
            least = np.minimum(label[u], label[v])
            for end in (u, v):
                np.minimum.at(label, label[end], least)
            label = np.minimum(label, label[label])
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays([order, order.take(pa.array(label))], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, ddl)


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), the component being its least node.

    Large-star and small-star steps in turn: each node's neighbours are hung onto the least of them, larger ones first,
    until nothing changes. A round is two aggregations and joins over at most as many edges as there were, and rounds
    grow with the logarithm of the longest path. What is left of a small graph is finished in one task.
    """
    own = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(own)
    if now.count() <= one_task:
        return checkpointed(_at_once(now))
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = checkpointed(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _least(large)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        now = checkpointed(hung.where("u <> v").distinct())
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
