"""Best-fit decreasing packing of token sequences, exact and global, without moving a token.

Best-fit decreasing only looks at lengths, and there are at most ``capacity`` different ones. So the driver packs the
*histogram* of lengths: bins with equal remaining room form one group, a segment tree over remaining capacities finds
the tightest group that still takes a length in logarithmic time, and a whole group is filled at once. The plan is a
list of runs "the pieces of this length with these ranks go to these bins at this offset"; its size is bounded by the
capacity, not by the corpus. Executors then rank pieces within their length and look their place up.

Defined results: a null or empty text is one piece holding the end id alone; ties (equal lengths) are told apart by
rank; repeated rows are packed one by one; an empty table gives an empty result; a key of null is carried along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import STEP_ROWS, checkpointed, extended, ranked_within


class RoomTree:
    """A segment tree over remaining capacities 0..capacity: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, value: bool) -> None:
        at = room + self.size
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open room of at least ``least``."""
        at = least + self.size
        if self.open[at]:
            return at - self.size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Runs for each length, as (first rank, first bin, offset) in order of rank, and the number of bins."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first bin, bins)
    tree, bins = RoomTree(capacity), 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            groups[room].append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = groups[room].pop()
                tree.set(room, bool(groups[room]))
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for i in range(each if full else 0):
                runs[length].append((rank, first, capacity - room + i * length))
                rank += full
            for i in range(rest):
                runs[length].append((rank, first + full, capacity - room + i * length))
                rank += 1
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            left -= full * each + rest
    return dict(runs), bins


def token_pieces(docs: DataFrame, capacity: int, path: str, end_id: int, ids: bool = False) -> DataFrame:
    """Encodes ``doc_id, text`` and cuts documents longer than ``capacity``: one row for each piece, with the ids
    themselves (little-endian unsigned 32-bit) if asked for."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
            ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if ids else []),
        ]
    )
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    end = tokens.end_bytes(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                rows = []
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).cast(pa.binary()).to_pylist())):
                    raw += end
                    for k, begin in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[begin : begin + 4 * capacity]
                        row = (doc_id, k, begin // 4, len(piece) // 4, tokens.crc(piece))
                        rows.append((*row, piece) if ids else row)
                if rows:
                    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def place(pieces: DataFrame, capacity: int, length: str, order: list[str]) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a checkpointed frame of pieces of 1 to ``capacity`` tokens."""
    counted = pieces.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    runs, _ = plan({int(r[length]): int(r["n"]) for r in counted}, capacity)
    ranked = ranked_within(pieces, [length], "__rank", order)
    names = [c for c in ranked.columns if c != "__rank"]
    schema = extended(ranked.select(*names), ("sequence_id", "long"), ("offset", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lookup = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(names.index(length)).to_numpy(zero_copy_only=False)
            ranks = batch.column(len(names)).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for value in np.unique(lengths):
                here = np.flatnonzero(lengths == value)
                ranks_of, bins_of, offsets_of = lookup[int(value)]
                k = np.searchsorted(ranks_of, ranks[here], side="right") - 1
                sequence[here] = bins_of[k] + ranks[here] - ranks_of[k]
                offset[here] = offsets_of[k]
            columns = [*(batch.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, ids: bool = False
) -> DataFrame:
    """Tokenizes ``doc_id, text`` and packs every piece; with ``ids`` the pieces carry their tokens."""
    pieces = checkpointed(token_pieces(docs, capacity, path or tokens.default_path(), end_id, ids))
    return place(pieces, capacity, "length", ["doc_id", "piece"])


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences themselves, from pieces that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("parts"),
    )
