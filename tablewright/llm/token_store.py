"""A content-addressed store of token ids.

Every document is encoded, closed with an end id, and cut into chunks where a rolling hash of the last ids says so;
equal passages are therefore cut alike wherever they stand. A chunk's address is the SHA-256 of its bytes, and each
address is stored once. Below ``path`` the store holds three Parquet tables:

``chunks``    chunk_id, n_ids, payload (the ids, little-endian, 16 bits each if the vocabulary allows it, else 32)
``recipes``   in ascending doc_id order: doc_id, start, n_tokens, the document's chunk ids, their sizes, Merkle root
``manifest``  one row for each partition of recipes: Merkle root over its documents (a tree over the trees of blocks of
              documents), number of documents and tokens
``layout``    into how many buckets by chunk_id the files of chunks are dealt: a reader who knows it need not move a
              payload to find it; without this table the store reads the same, at the price of one more shuffle

Reading verifies: every payload must hash to its address, every recipe (chunk ids and sizes) to its root, every partition
(roots, starts, numbers of tokens) to the manifest; every chunk that a recipe names must be there once and as long as the
recipe says, and the sizes must add up to the document's tokens. Whatever does not hold raises an error.

Defined results: a null or empty text is the end id alone; repeated rows get a recipe each, rows with one doc_id or none
stand together in any order; an empty table gives an empty store; extra columns are ignored, whatever their names. A
chunk is never longer than ``MOST`` ids, a recipe is as long as its document needs.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import heavy_keys, skewed_join
from . import tokens
from .common import checkpointed, drop_stored, extended, partitions, release, sorted_with_offsets, stored, text_steps

#: Ids under the rolling window, and the least, usual and largest number of ids in a chunk.
WINDOW, LEAST, MASK, MOST = 16, 128, 511, 2048
#: Documents that are hashed at a time: few enough for their ids to stay in a processor's cache.
GROUP = 64
#: Addresses that a task remembers.
MET = 200_000


def gear(vocabulary: int):
    """A 32-bit number for each id: what the rolling hash adds up (the finalizer of a 32-bit murmur hash)."""
    import numpy as np

    x = np.arange(vocabulary, dtype=np.uint32) + np.uint32(0x9E3779B9)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def marks(ids, table):
    """Places after which a chunk may end: where a rolling hash of the last WINDOW ids has its top bits clear."""
    import numpy as np

    rolled, span = table[ids], 1
    while span < min(WINDOW, len(ids)):  # from windows of a span to windows of twice the span
        twice = rolled.copy()
        twice[span:] += rolled[:-span] << np.uint32(span)
        rolled, span = twice, 2 * span
    return np.flatnonzero(rolled < np.uint32(2**32 // (MASK + 1))) + 1


def cuts(n: int, places: list[int]) -> list[int]:
    """Where the chunks of n ids end, the last one at n, from the places that may end one. The first LEAST ids of a
    chunk are never cut, so a window reaches back into what stands before the ids at no cut."""
    out, last = [], 0
    for place in [*places, n]:
        while place - last > MOST:
            last += MOST
            out.append(last)
        if place - last >= LEAST or place == n and place > last:
            last = place
            out.append(last)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; leaves and inner nodes are told apart by their first byte."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def recipe_root(names: list[bytes], sizes: list[int]) -> bytes:
    """The root of a document, over the addresses and sizes of its chunks."""
    return merkle_root([name + size.to_bytes(4, "little") for name, size in zip(names, sizes, strict=True)])


def _encoded(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """A recipe for each document, with the bytes of those of its chunks that its task has not met lately: however
    many copies a chunk has, a task sends it on about once."""
    end, kind = tokens.end_bytes(end_id), f"<u{width}"
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunk_ids", pa.list_(pa.binary())),
            ("sizes", pa.list_(pa.int32())), ("root", pa.binary()),
            ("fresh", pa.list_(pa.struct([("chunk_id", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = tokens.encoder(path)
        table = gear(max(encoder.model.get_vocab_size(), end_id + 1))
        met: set[bytes] = set()

        def encoded_groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
            for step in text_steps(batch, 1, tokens.STEP_BYTES, tokens.STEP_ROWS):
                found = encoder.encode(step.column(1).cast(pa.binary()).to_pylist())
                for at in range(0, step.num_rows, GROUP):
                    yield step.slice(at, GROUP), [raw + end for raw in found[at : at + GROUP]]

        for batch in batches:
            for part, raws in encoded_groups(batch):
                rows = []
                ids = np.frombuffer(b"".join(raws), "<u4")
                stops = np.cumsum([len(raw) // 4 for raw in raws]).tolist()
                payloads, places, seen = ids.astype(kind).tobytes(), marks(ids, table), 0
                bounds = np.searchsorted(places, stops, side="right").tolist()
                places, first = places.tolist(), 0
                for doc_id, stop, bound in zip(part.column(0).to_pylist(), stops, bounds):
                    begin, names, sizes, fresh = first, [], [], []
                    for here in cuts(stop - first, [p - first for p in places[seen:bound]]):
                        payload = payloads[begin * width : (first + here) * width]
                        names.append(name := hashlib.sha256(payload).digest())
                        sizes.append(first + here - begin)
                        if name not in met:
                            met.add(name)
                            fresh.append((name, sizes[-1], payload))
                        begin = first + here
                    rows.append((doc_id, stop - first, names, sizes, recipe_root(names, sizes), fresh))
                    first, seen = stop, bound
                if len(met) > MET:
                    met.clear()
                if rows:
                    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, n_tokens long, chunk_ids array<binary>, sizes array<int>, root binary, " \
        "fresh array<struct<chunk_id:binary,n_ids:int,payload:binary>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal addresses hold equal bytes and stand in one partition: the first of each stays."""
    met: set[bytes] = set()
    for batch in batches:
        new = []
        for name in batch.column(0).to_pylist():
            new.append(name not in met)
            met.add(name)
        yield batch.filter(pa.array(new, pa.bool_()))


def _write_buckets(chunks: DataFrame, path: str, buckets: int) -> None:
    """Files by the hash of chunk_id, as Spark deals them out for a shuffle. Only the session's own catalogue knows the
    table, under a name that goes again at once."""
    name, spark = f"chunks_{uuid.uuid4().hex}", chunks.sparkSession
    rows = chunks.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("path", path)
    rows.format("parquet").bucketBy(buckets, "chunk_id").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, n_ids, payload, known to Spark as dealt out by chunk_id if the store says so."""
    plain = spark.read.schema("chunk_id binary, n_ids int, payload binary").parquet(f"{path}/chunks")
    try:
        buckets = spark.read.parquet(f"{path}/layout").first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return plain
    name, quoted = f"chunks_{uuid.uuid4().hex}", f"{path}/chunks".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} (chunk_id BINARY, n_ids INT, payload BINARY) USING parquet "
        f"CLUSTERED BY (chunk_id) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    out = spark.table(name)
    out.columns  # resolved from here on
    spark.sql(f"DROP TABLE {name}")
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> int:
    """Encodes ``doc_id, text`` and writes the store at ``path``, where nothing may be yet. Returns the ids written."""
    tokenizer = tokenizer or tokens.default_path()
    width = 2 if tokens.encoder(tokenizer).model.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    encoded = stored(_encoded(docs, tokenizer, end_id, width), "encoded", "zstd")
    buckets = partitions(docs.sparkSession)
    parts = encoded.select(F.inline("fresh")).repartition(buckets, "chunk_id")
    unique = parts.mapInArrow(_first_of_each, parts.schema)
    _write_buckets(unique, f"{path}/chunks", buckets)
    docs.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")
    release(docs.sparkSession)
    recipes, total = sorted_with_offsets(encoded.drop("fresh"), ["doc_id"], "n_tokens", "start")
    recipes = recipes.withColumn("part", F.spark_partition_id())
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(docs.sparkSession, path).write.parquet(f"{path}/manifest")
    drop_stored(encoded)
    return total


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A Merkle root for each partition of the recipes, over its documents' roots, starts and tokens by start: computed in blocks of
    documents whose roots are then joined, so no task holds more than one block of them."""
    recipes = spark.read.parquet(f"{path}/recipes")

    def roots(rows: pa.Table) -> pa.Table:
        listed = sorted(zip(*(rows[c].to_pylist() for c in ("start", "root", "n_tokens"))))
        leaves = [r + start.to_bytes(8, "little") + n.to_bytes(8, "little") for start, r, n in listed]
        return pa.table(
            {
                "part": rows["part"][:1], "block": rows["block"][:1], "root": pa.array([merkle_root(leaves)], pa.binary()),
                "n_docs": pa.array([len(leaves)], pa.int64()),
                "n_tokens": pa.array([sum(rows["n_tokens"].to_pylist())], pa.int64()),
            }
        )

    # documents hold a token or more each, so a block of starts has at most this many of them
    blocks = recipes.select("part", F.shiftright("start", 20).alias("block"), "start", "root", "n_tokens")
    found = blocks.groupBy("part", "block").applyInArrow(
        roots, "part int, block long, root binary, n_docs long, n_tokens long"
    )
    def tree(rows: pa.Table) -> pa.Table:
        listed = sorted(zip(*(rows[c].to_pylist() for c in ("block", "root"))))
        totals = {c: pa.array([sum(rows[c].to_pylist())], pa.int64()) for c in ("n_docs", "n_tokens")}
        root = merkle_root([r for _, r in listed])
        return pa.table({"part": rows["part"][:1], "root": pa.array([root], pa.binary()), **totals})

    return found.groupBy("part").applyInArrow(tree, "part int, root binary, n_docs long, n_tokens long")


def _fail(message: str):
    return F.raise_error(F.lit(message))


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes; one whose chunk list does not give its root raises an error, and so does a partition that the
    manifest does not know in this form."""
    known = spark.read.parquet(f"{path}/manifest").select("part", "root", "n_docs", "n_tokens").collect()
    if sorted(known) != sorted(manifest(spark, path).collect()):  # a row for each partition of the recipes
        raise ValueError(f"the recipes at {path} do not match the manifest")

    recipes = spark.read.parquet(f"{path}/recipes")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = zip(*(batch.column(c).to_pylist() for c in ("chunk_ids", "sizes", "root", "n_tokens")))
            for names, sizes, root, n in listed:
                if len(names) != len(sizes) or not names or sum(sizes) != n or recipe_root(names, sizes) != root:
                    raise ValueError("a recipe does not match its root")
            yield batch

    return recipes.mapInArrow(check, recipes.schema)


def _contents(spark: SparkSession, path: str, result, ddl: str) -> DataFrame:
    """(root, *result) for each different document, put together from its chunks: ``result`` makes of its ids (their
    bytes as stored, and how many there are) what ``ddl`` names. Equal documents have one root and are put together once; chunks that very many
    documents share are known to every task."""
    release(spark)  # of what wrote the store nothing is needed any more
    kinds = extended(spark.createDataFrame([], "root binary"), *((x.split()[0], x.split()[1]) for x in ddl.split(", ")))
    recipes = verified_recipes(spark, path).select("root", "chunk_ids", "sizes").dropDuplicates(["root"])
    parts = recipes.select("root", F.posexplode(F.arrays_zip("chunk_ids", "sizes"))).select(
        "root", "pos", F.col("col.chunk_ids").alias("chunk_id"), F.col("col.sizes").alias("n")
    )
    # counted over all recipes as they are: this only decides how the join is dealt out
    listed = spark.read.parquet(f"{path}/recipes").select(F.explode("chunk_ids").alias("chunk_id"))
    uses = checkpointed(listed.groupBy("chunk_id").count())
    chunks = _chunks(spark, path)
    # chunks of very many documents (a bounded number, by arithmetic) go to every task; the others' payloads stay where they lie
    heavy = heavy_keys(uses, ["chunk_id"], "count", partitions(spark))
    if heavy is None:
        joined = parts.join(chunks, "chunk_id", "left")
    else:
        often = F.broadcast(heavy.select("chunk_id"))
        shared = F.broadcast(chunks.join(often, "chunk_id", "left_semi"))
        joined = parts.join(often, "chunk_id", "left_anti").join(chunks, "chunk_id", "left").unionByName(
            parts.join(often, "chunk_id", "left_semi").join(shared, "chunk_id", "left")
        )
    whole = joined.groupBy("root").agg(F.collect_list(F.struct("pos", "chunk_id", "n", "n_ids", "payload")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part, values = batch.slice(at, GROUP), []
                for rows in part.column(1):
                    rows = sorted(zip(*(rows.values.field(k).to_pylist() for k in range(5))))
                    body = []
                    for _, name, n, n_ids, ids in rows:
                        if ids is None:
                            raise ValueError("a chunk is missing")
                        if n != n_ids or len(ids) not in (2 * n, 4 * n):
                            raise ValueError("a chunk is not as long as its recipe says")
                        if hashlib.sha256(ids).digest() != name:
                            raise ValueError("a chunk does not match its address")
                        body.append(ids)
                    values.append(result(b"".join(body), sum(r[2] for r in rows)))
                columns = [pa.array(c) for c in zip(*values)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=kinds.names)

    return whole.mapInArrow(run, kinds)


def _of_documents(spark: SparkSession, path: str, contents: DataFrame, column: str) -> DataFrame:
    """doc_id, start, n_tokens of every document with a column of its contents."""
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "root")
    rows = skewed_join(recipes, contents, ["root"], "left", checkpointed(recipes.groupBy("root").count()))
    kind = rows.schema[column].dataType
    right = F.when(F.col("n").eqNullSafe(F.col("n_tokens")), F.col(column))
    return rows.select(
        "doc_id", "start", "n_tokens",
        right.otherwise(_fail("chunks do not add up to their document").cast(kind)).alias(column),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reconstructs every document: doc_id, start, n_tokens, ids (little-endian, as wide as stored)."""
    contents = _contents(spark, path, lambda ids, n: (ids, n), "ids binary, n long")
    return _of_documents(spark, path, contents, "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: each different document is put together
    from its chunks, and the crc32 is that of its ids as little-endian unsigned 32-bit integers."""

    def crc(ids: bytes, n: int) -> tuple[int, int]:
        import numpy as np

        return zlib.crc32(ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4")), n

    return _of_documents(spark, path, _contents(spark, path, crc, "ids_crc32 long, n long"), "ids_crc32")
