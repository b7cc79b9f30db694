"""Exact Jaccard self-join of documents on word shingles, as a blocked sparse matrix product.

The matrix has a row for each different shingle set and a column for each shingle. Its columns are dealt out in blocks
by hash, so that a block holds all rows of its columns and counts exactly in how many sets a shingle stands. A shingle
of a single set cannot overlap with anything: only the others travel back to their sets. From there on

* a set with too few shared shingles for any partner of its size is discarded (the size-derived bound),
* the rest is ordered by (number of sets, shingle), and two sets that are similar enough must meet in a column of
  their short prefixes of this order (prefix filter with the bounds of their sizes),
* overlaps of the pairs that meet are counted over the whole rows and held against the exact bound.

Groups of near copies are not multiplied out. First every set is paired only with the most central set of the columns
it stands in; the links found join most sets into components. After that a column matters only where it holds sets of
different components, and only pairs across components are left to count. Both steps are exact for components: every
pair within the bound is either counted or already connected.

Columns that hold the same sets lead to the same pairs, so of those one is enough: a passage that many documents share
is one column, not one for each of its shingles. Pairs that many columns lead to are made distinct before they meet the
rows, and a column, set or component that holds a large share of all rows is dealt out over several tasks.

Equal sets are one row from the start (their 128-bit digests name it), so copies cost nothing. Between blocks only as
many bytes of a digest travel as tell that many sets apart (``name_width``); should two sets agree in them all the same,
which is looked for, everything is done again with whole digests. Shingles are 64-bit
hashes within a document; between documents 40 bits and the block's number tell them apart: a wrong overlap needs two of
the few hundred shingles of one candidate pair to agree by chance. The number of blocks follows the measured bytes of
text (``BLOCK_BYTES``), so a block is held by a task at any size of the corpus.

Defined results: a text without words (null, empty, blank) has no shingles, links with nothing and is its own
component; a text of fewer words than a shingle has one, its whole sequence; a very long text is hashed by itself;
repeated rows are in one component; of several rows with the least key of a component the first one read is its head;
the least key names a component, rows with a null key do not name one; an empty table gives an empty result; extra
columns are ignored by ``similar_components`` and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import skewed_join
from .common import BROADCAST_BYTES, as_table, checkpointed, drop_stored, give_back, partitions, release, stored, text_steps
from .graph import connected_components

#: Words in a shingle; the least similarity, in hundredths.
WORDS, PERCENT = 5, 75
#: Documents and bytes of text hashed at a time.
SLICE, SLICE_BYTES = 2048, 4 << 20
#: Bytes of text whose shingles one block may hold.
BLOCK_BYTES = 64 << 20
KEY_BITS = 40
#: Bytes that the number of a set takes where every task knows it.
END_BYTES = 32
#: Bytes of a whole digest.
WHOLE = 16
#: Rows of a column that meet in one task at most on either side.
SQUARE = 1000

SCATTERED = (
    "block int, row long, doc_id long, n long, sig binary, sigs binary, counts binary, low binary, high binary"
)
GATHERED = "row long, doc_id long, n long, sig binary, cells binary"
#: What a block sends back to a set: a cell for the block's number (in ``low``), then one for each shared shingle.
CELL = [("low", "<u4"), ("high", "u1"), ("held", "u1")]
CELL_BYTES = 6


def mixed(x):
    """The finalizer of splitmix64, on arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS):
    """The sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased, words end at ASCII white space."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mixed(out + hashes[i : i + n] * np.uint64(2 * i + 1)) if i else out * np.uint64(31) + hashes[:n]
    return np.unique(out)


def name_width(n: int) -> int:
    """Bytes of a digest by which n sets are all different but for a chance of 1 in 2000 at most."""
    return min(WHOLE, -(-(2 * max(1, n).bit_length() + 10) // 8))


def scatter(docs: DataFrame, blocks: int, size: int, width: int) -> DataFrame:
    """Rows of two kinds: (block, row, doc_id, n, sig) for each document, and for each slice of documents and block the
    shingles of that block: the first ``width`` bytes of the sets' digests, how many each has, and the shingles' 32 low and 8 high bits."""
    names = [x.split()[0] for x in SCATTERED.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 5]
    schema = pa.schema(list(zip(names, kinds)))

    def rows_of(rows: list, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sets, sigs, seen, first = [], [], set(), []
        for text in texts:
            found = shingles(text, size)
            sig = hashlib.blake2b(found.tobytes(), digest_size=WHOLE).digest() if len(found) else None
            sigs.append(sig)
            sets.append(len(found))
            if sig and sig not in seen:  # of equal sets in a slice one is enough
                seen.add(sig)
                first.append((sig, found))
        home = [int.from_bytes(s[:8], "little") % blocks if s else r % blocks for s, r in zip(sigs, rows)]
        empty = [None] * len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip((home, rows, ids, sets, sigs, *[empty] * 4), kinds)], schema=schema
        )
        if not first:
            return
        tokens = np.concatenate([t for _, t in first])
        owner = np.repeat(np.arange(len(first), dtype=np.int64), [len(t) for _, t in first])
        block = ((tokens >> np.uint64(KEY_BITS)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        tokens, owner = tokens[order], owner[order]
        low = (tokens & np.uint64(0xFFFFFFFF)).astype("<u4")
        high = ((tokens >> np.uint64(32)) & np.uint64(0xFF)).astype("u1")
        ends = np.cumsum(np.bincount(block, minlength=blocks))
        digests = np.frombuffer(b"".join(s[:width] for s, _ in first), f"V{width}")
        columns: list[list] = [[], [], [], [], []]
        begin = 0
        for b, end in enumerate(ends.tolist()):
            if end > begin:
                held, counts = np.unique(owner[begin:end], return_counts=True)
                counts = counts.astype("u1" if counts.max() < 256 else "<u4")
                parts = (digests[held].tobytes(), counts.tobytes(), low[begin:end].tobytes(), high[begin:end].tobytes())
                for column, value in zip(columns, (b, *parts)):
                    column.append(value)
            begin = end
        none = [None] * len(columns[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip((columns[0], *[none] * 4, *columns[1:]), kinds)], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, 2, SLICE_BYTES, SLICE):
                yield from rows_of(*(part.column(i).to_pylist() for i in range(3)))
        give_back()

    return docs.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(run, SCATTERED)


def shared_cells(key, row, packed: bool | None = None):
    """The distinct (column, row) of a block that stand in columns of several rows, with the number of rows of their
    column; in order of row and column. Keys have ``KEY_BITS`` bits. Where key and row fit into 64 bits they are sorted
    as one number."""
    import numpy as np

    bits = max(1, int(row.max(initial=0)).bit_length())
    if bits <= 64 - KEY_BITS if packed is None else packed:
        cell = key << np.uint64(bits)
        cell |= row.astype(np.uint64, copy=False)
        del key, row  # a block's columns are large: what is done with goes at once
        cell.sort()
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        cell = cell[new]  # a set counts once in a column
        key, row = cell >> np.uint64(bits), cell
        row &= np.uint64((1 << bits) - 1)
        row = row.view(np.int64)
        del cell
    else:
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        key, row = key[new], row[new]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    last = np.ones(len(key), bool)
    last[:-1] = new[1:]
    shared = ~(new & last)
    key, row, new = key[shared], row[shared], new[shared]
    starts = np.flatnonzero(new)
    held = np.diff(np.append(starts, len(key)))
    held = np.repeat(np.minimum(held, 2**32 - 1).astype("<u4"), held)
    order = np.argsort(row, kind="stable")
    return key[order], row[order], held[order]


def in_a_byte(held):
    """Numbers of sets in one byte each, in the same order: exact up to 64, then six steps to each doubling, which is
    enough to put columns in order; the same for every set that stands in a column."""
    import numpy as np

    steps = 64 + np.floor(6 * np.log2(np.maximum(held, 64) / 64.0))
    return np.where(held <= 64, held, np.minimum(steps, 255)).astype("u1")


def gather(scattered: DataFrame, width: int) -> DataFrame:
    """Block by block: documents pass through, and each set gets back its shingles that other sets hold as well, with
    the number of sets that hold them (``in_a_byte``)."""
    names = [x.split()[0] for x in GATHERED.split(", ")]

    def joined(column: pa.ChunkedArray, kind: str):
        import numpy as np

        return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])

    def keys(rows: pa.Table):
        import numpy as np

        key = joined(rows["high"], "u1").astype(np.uint64)
        key <<= np.uint64(32)
        key |= joined(rows["low"], "<u4")
        return key

    def sets_of(rows: pa.Table):
        import numpy as np

        cut_names = joined(rows["sigs"], "u1").reshape(-1, width)
        sigs = np.zeros((len(cut_names), WHOLE), "u1")
        sigs[:, :width] = cut_names
        sigs = sigs.view("<u8")
        counts = np.concatenate(
            [
                np.frombuffer(c.as_buffer(), "u1" if len(c.as_buffer()) == len(s.as_buffer()) // width else "<u4").astype(np.int64)
                for c, s in zip(rows["counts"], rows["sigs"])
            ]
        )
        order = np.lexsort((sigs[:, 1], sigs[:, 0]))
        sigs = sigs[order]
        new = np.concatenate([[True], (sigs[1:] != sigs[:-1]).any(axis=1)])
        number = np.empty(len(order), np.uint64)
        number[order] = np.cumsum(new) - 1
        return sigs[new], number, counts

    def found_in(rows: pa.Table) -> pa.Table:
        import numpy as np

        sets, number, counts = sets_of(rows)
        # as arguments only, so that they can go when they are packed
        key, row, held = shared_cells(keys(rows), np.repeat(number, counts))
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
        cells = np.zeros(len(row), CELL)
        cells["low"], cells["high"] = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32)
        cells["held"] = in_a_byte(held)
        head = np.zeros(1, CELL)
        head["low"] = rows["block"][0].as_py()
        cells = np.insert(cells, begin, head)
        offsets = (np.append(begin, len(row)) + np.arange(len(begin) + 1)) * CELL_BYTES
        n = len(begin)
        sent = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(cells.tobytes())]
        ).cast(pa.binary())
        owners = pa.array([x.tobytes()[:width] for x in sets[row[begin]]], pa.binary())
        return pa.table([*[pa.nulls(n, pa.int64())] * 3, owners, sent], names=names)

    def block_of(table: pa.Table) -> pa.Table:
        is_doc = pc.is_null(table["low"])
        docs, rows = table.filter(is_doc), table.filter(pc.invert(is_doc))
        none = pa.nulls(len(docs))
        out = pa.table([*(docs[c] for c in names[:4]), none.cast(pa.binary())], names=names)
        if len(rows):
            out = pa.concat_tables([out, found_in(rows)])
        del rows
        give_back()
        return out

    return scattered.groupBy("block").applyInArrow(block_of, GATHERED)


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest overlap of sets of n and m shingles that are similar enough."""
    return -(-percent * (n + m) // (100 + percent))


def rows_of_interest(gathered: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """(set, n, unique, tokens): the sets (by their number in ``classes``) that share enough shingles with others for
    some partner, their shared shingles in the common order. The block's number stands in the bits above a shingle's
    own."""
    parts = gathered.where("cells IS NOT NULL").groupBy("sig").agg(
        F.sum(F.expr(f"octet_length(cells) div {CELL_BYTES} - 1")).alias("shared"), F.collect_list("cells").alias("parts")
    )
    enough = parts.join(classes.select(F.substring("sig", 1, width).alias("sig"), "set", "n"), "sig").where(F.col("shared") * 100 >= F.col("n") * percent)
    kinds = [("set", pa.int64()), ("n", pa.int64()), ("unique", pa.int64()), ("tokens", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                tokens, unique = [], []
                for n, parts in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                    parts = [np.frombuffer(p, CELL) for p in parts]
                    block = np.repeat([int(p["low"][0]) for p in parts], [len(p) - 1 for p in parts])
                    cells = np.concatenate([p[1:] for p in parts])
                    values = cells["low"].astype(np.int64) | cells["high"].astype(np.int64) << 32 | block << KEY_BITS
                    held = cells["held"]
                    tokens.append(values[np.lexsort((values, held))])
                    unique.append(n - len(values))
                columns = (piece.column(0), piece.column(1), pa.array(unique, pa.int64()), pa.array(tokens, kinds[3][1]))
                yield pa.RecordBatch.from_arrays(list(columns), names=[k for k, _ in kinds])
        give_back()

    return enough.select("set", "n", "parts").mapInArrow(run, "set long, n long, unique long, tokens array<long>")


def linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose rows overlap enough, counted in full. A set that stands in very many pairs is
    copied to several tasks, each with a part of its pairs. Rows that stand in no pair stay where they are, if those
    that do are few enough (measured) for every task to know their numbers."""
    ends = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("set")).distinct())
    if ends.count() * END_BYTES <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(ends), "set", "left_semi")
    left = rows.select(F.col("set").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    right = rows.select(F.col("set").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    popular = checkpointed(pairs.groupBy("v").count())
    both = skewed_join(skewed_join(pairs, left, ["u"]), right, ["v"], counts=popular)
    overlap = F.size(F.array_intersect("tu", "tv"))
    return both.where(overlap * (100 + percent) >= percent * (F.col("nu") + F.col("nv"))).select("u", "v")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ``row``, a number of its own for every row. What is no table of files is made one first, so that a
    second pass gives the same numbers."""
    return as_table(docs).withColumn("row", F.monotonically_increasing_id())


def similar_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text), and whether it is the ``first``
    of its component (one row of each is: that of the least doc_id)."""
    return _components(numbered(docs.select("doc_id", "text")), size, percent).drop("row")


def deduplicate(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The first document of each component, with docs' own columns. Only the numbers of rows to leave out meet the
    texts again."""
    docs = as_table(docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = numbered(docs.select(F.struct(*own).alias("kept"), "doc_id", "text"))
    out = _components(rows.select("row", "doc_id", "text"), size, percent).where("NOT first").select("row")
    release(docs.sparkSession)
    return rows.join(out, "row", "left_anti").select("kept.*")


def _across(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``a`` with every row of ``b`` in the same column. A wide column is cut into squares of
    ``SQUARE`` by ``SQUARE`` rows, so that no task multiplies out a whole one."""
    cuts = F.ceil(F.col("width") / F.lit(SQUARE)).cast("int")
    every = F.explode(F.sequence(F.lit(0), cuts - 1))
    a = a.withColumn("r", F.pmod(F.xxhash64("u"), cuts).cast("int")).select("*", every.alias("c")).drop("width")
    b = b.withColumn("c", F.pmod(F.xxhash64("v"), cuts).cast("int")).select("*", every.alias("r")).drop("width")
    return a.join(b, ["token", "r", "c"])


def _components(docs: DataFrame, size: int, percent: int, width: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    n, bytes_ = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks, width = max(partitions(spark), -(-(bytes_ or 0) // BLOCK_BYTES)), width or name_width(n)
    gathered = stored(gather(scatter(docs, blocks, size, width), width), "shingles")
    release(spark)
    named = gathered.where("cells IS NULL").select("row", "doc_id", "n", "sig")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = checkpointed(
        named.where("sig IS NOT NULL").groupBy("sig").agg(
            F.min(rank).alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")
        ).withColumn("set", F.monotonically_increasing_id())
    )
    if width < WHOLE and classes.groupBy(F.substring("sig", 1, width)).count().where("count > 1").head(1):
        drop_stored(gathered)
        return _components(docs, size, percent, WHOLE)
    rows = stored(rows_of_interest(gathered, classes, percent, width), "rows")
    named = checkpointed(named)
    drop_stored(gathered)
    release(spark)

    # prefixes: ``at`` is a shingle's place in the whole order, ``most`` the overlap that is still possible from there
    own = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    prefix = F.greatest(F.lit(0), own - F.col("unique")).cast("int")
    cells = rows.select("set", "n", "unique", F.posexplode(F.slice("tokens", 1, prefix))).select(
        F.col("col").alias("token"), "set", "n", "unique", (F.col("n") - F.col("unique") - F.col("pos")).alias("most")
    )
    cells = stored(cells, "cells")

    # 1. every set with the most central set of its columns: the one with the fewest shingles of its own
    centre = cells.groupBy("token").agg(
        F.min(F.struct((F.col("unique") / F.col("n")).alias("r"), "set", "n", "most")).alias("c"),
        F.count(F.lit(1)).alias("width"),
    ).where("width > 1")
    bound = F.col("most") * (100 + percent) >= percent * (F.col("n") + F.col("c.n"))
    widths = checkpointed(centre)
    met = skewed_join(cells, widths.drop("width"), ["token"], counts=widths, n="width").where(
        (F.col("set") != F.col("c.set")) & bound
    )
    votes = met.groupBy("set", F.col("c.set").alias("centre")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("set").agg(F.max(F.struct("votes", "centre")).alias("b"))
    nearest = checkpointed(best.select(F.col("set").alias("u"), F.col("b.centre").alias("v")))
    release(spark)
    first = checkpointed(linked(nearest, rows, percent))
    release(spark)
    group = connected_components(first)

    # 2. pairs across components that meet in a column, the largest component of a column on one side only
    labelled = cells.join(group.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "component", F.coalesce("component", "set")
    )
    per = labelled.groupBy("token", "component").agg(
        F.count(F.lit(1)).alias("here"), F.sum("most").alias("most"),
        *(F.bit_xor(F.xxhash64("set", F.lit(i))).alias(f"h{i}") for i in range(2)),
    )
    columns = per.groupBy("token").agg(
        F.count(F.lit(1)).alias("components"), F.max(F.struct("here", "component")).alias("top"),
        F.sum("here").alias("width"), F.sum("most").alias("most"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"),
    ).where("components > 1")
    # of columns that hold the same sets (two sums of 64-bit hashes, without carry, agree) the first in the common order finds all pairs
    distinct = columns.groupBy("width", "h0", "h1").agg(
        F.max_by(F.struct("token", "top", "width"), "most").alias("c")
    ).select("c.token", F.col("c.top.component").alias("top"), "c.width")
    wide = checkpointed(distinct)
    alive = checkpointed(
        skewed_join(labelled, wide, ["token"], counts=wide, n="width").select(
            "token", "set", "n", "most", "component", "width", (F.col("component") == F.col("top")).alias("in_top")
        )
    )
    drop_stored(cells)
    release(spark)
    a = alive.where("NOT in_top").select(
        "token", "width", F.col("set").alias("u"), F.col("n").alias("nu"), F.col("most").alias("mu"),
        F.col("component").alias("cu"),
    )
    b = alive.select(
        "token", "width", F.col("set").alias("v"), F.col("n").alias("nv"), F.col("most").alias("mv"),
        F.col("component").alias("cv"), "in_top",
    )
    need = percent * (F.col("nu") + F.col("nv"))
    across = _across(a, b).where(
        (F.col("cu") != F.col("cv"))
        & (F.col("in_top") | (F.col("u") < F.col("v")))
        & (F.least("mu", "mv") * (100 + percent) >= need)
    )
    second = linked(checkpointed(across.select("u", "v").distinct()), rows, percent)
    edges = checkpointed(first.unionByName(second))
    component = connected_components(edges)

    heads = (
        component.join(classes, component["node"] == classes["set"]).groupBy("component").agg(F.min("least").alias("head"))
    )
    headed = skewed_join(component, heads, ["component"]).select(F.col("node").alias("set"), "head")
    of_class = classes.join(headed, "set", "left").select("sig", F.coalesce("head", "least").alias("head"))
    joined = skewed_join(named, of_class, ["sig"], "left", classes.select("sig", "copies"), "copies")
    out = joined.select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)).alias("first"),
    )
    out = checkpointed(out)
    drop_stored(rows)
    return out
