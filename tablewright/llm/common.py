"""Helpers that several operators share: reading tables, scratch tables, global offsets."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text handed to one Python step at most; bounds the memory of a worker whatever Arrow's batch size
#: and however long its texts are.
STEP_ROWS, STEP_BYTES = 512, 4 << 20
#: A table is broadcast only if its measured size in bytes is below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; where it is unset (tests), one under the
    warehouse. Also makes ``checkpoint()`` usable."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here, and a lost executor costs
    no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager ``checkpoint()`` in the shared folder; keeps the partitions and their order."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def as_table(df: DataFrame) -> DataFrame:
    """df if it is a projection of files, which are read in the same order each time; else df written and read again.
    Only then may rows be numbered in two passes."""
    if not df._jdf.queryExecution().optimizedPlan().deterministic():
        return stored(df, "input")
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        if not below and not df.inputFiles() or plan.nodeName() not in ("Project", "Filter", "LogicalRelation") and below:
            return stored(df, "input")
        todo += below
    return df


def drop_stored(*frames: DataFrame) -> None:
    """Removes the files of ``stored`` tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = scratch_root(spark)
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 1)[0].rstrip("/").endswith(root.rsplit("/", 1)[-1]):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that shuffle files nobody needs any more leave the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Gives the system what this process has freed. Workers are kept between tasks, and the C library and Arrow keep
    for them what a task took at its most, which counts as the executor's all the same."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # a system without glibc
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession, times: int = 1) -> int:
    """The cluster's own setting for shuffles: it grows with the input, and so does all that is dealt by it."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def extended(df: DataFrame, *fields: tuple[str, T.DataType | str]) -> T.StructType:
    """df's schema with more fields (df.schema itself is shared, so it must not be added to)."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        out.add(name, kind)
    return out


def ranked_within(df: DataFrame, group: list[str], rank: str, order: list[str]) -> DataFrame:
    """Adds a gapless rank from 0 within each group, however large a group is.

    Rows are numbered inside small cells (group x the partition they came from) and every cell is shifted by the
    rows of the cells before it. No task sees more of a group than one input partition holds, so a group with a third
    of all rows costs as little as any other. df's partitions must be stable: pass a checkpointed frame.
    """
    cell = [*group, "__pid"]
    rows = df.withColumn("__pid", F.spark_partition_id())
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*cell).orderBy(*order)
    numbered = rows.withColumn("__in", F.row_number().over(inside) - 1)
    same = [numbered[c].eqNullSafe(bases[c]) if c != "__pid" else numbered[c] == bases[c] for c in cell]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    kept = [numbered[c] for c in df.columns]
    return numbered.join(bases, condition).select(*kept, (F.col("__base") + F.col("__in")).cast("long").alias(rank))


def others(df: DataFrame, *replaced: str | None) -> list[str]:
    """df's columns but for those that a result replaces; names that differ in case only are one name to Spark."""
    gone = {c.lower() for c in replaced if c}
    return [c for c in df.columns if c.lower() not in gone]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_steps(
    batch: pa.RecordBatch, column: int, most_bytes: int = STEP_BYTES, most_rows: int = STEP_ROWS
) -> Iterator[pa.RecordBatch]:
    """A batch cut where so many rows or bytes of a text column are reached; one long text is a step of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (total + n > most_bytes or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def sorted_with_offsets(df: DataFrame, order: list[str], size: str, start: str) -> tuple[DataFrame, int]:
    """df range-partitioned and sorted by ``order``, with the running sum of ``size`` before each row.

    Only one total for each partition reaches the driver; the running sums are made partition by partition.
    """
    spark = df.sparkSession
    n = partitions(spark)
    ranged = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    totals = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(size).alias("s")).collect()
    base, total = {}, 0
    for p, s in sorted((r["p"], int(r["s"] or 0)) for r in totals):
        base[p], total = total, total + s
    schema = extended(ranged, (start, "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        at = base.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + at
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends - sizes)], names=[*batch.schema.names, start]
            )
            at = int(ends[-1])

    return ranged.mapInArrow(run, schema), total
