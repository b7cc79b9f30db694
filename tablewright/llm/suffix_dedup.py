"""Exact removal of repeated strings by distributed suffix sorting.

Wanted are the bytes covered by a string of ``LENGTH`` bytes that also starts earlier, in the same document or in one
before it. Strings meet where they can be equal, in blocks:

1. Anchors. Every window of LENGTH bytes has an anchor, the least hash of the GRAM-byte strings inside it, so equal
   windows have equal anchors at equal places. A count over the whole corpus tells which anchors stand more than once;
   windows around all others cannot repeat and are settled.
2. Segments. The bytes of neighbouring windows with one common, repeated anchor form a segment. Equal segments are one
   row with its earliest place; the block of a segment is that of its anchor, so all windows that could be equal are in
   one block, and a segment that a third of the corpus shares still is one row there. Where the text is periodic, a
   segment that equals the one right before it repeats as a whole and is settled at once. Where more than ``HOT``
   places have the same anchor, their windows are told apart by 128-bit digests, one row for each different window,
   instead of meeting in one task.
3. Suffix sort. In every block the segments form one text whose suffixes are sorted by the difference-cover algorithm
   (``suffix_sort``): sampled triples, recursion on their names, a merge of the rest. Neighbours in that order that agree
   in LENGTH bytes are the equal strings; all but the earliest of them repeat. The number of blocks follows the
   measured bytes of the segments.
4. Documents. Repeats become intervals of their documents, and what is left is hashed.

A suffix order of the whole corpus would shuffle each byte many times; an order within blocks that hold every
candidate tells the same equalities. Apart from HOT anchors nothing is decided by hashes but which strings meet:
equality is that of bytes (documents and segments that are equal as a whole are recognised by 128-bit digests).

Defined results: a null text is empty; a document of less than LENGTH bytes loses nothing; a very long text is worked
on in overlapping pieces of ``SLICE_BYTES``; of repeated rows with one doc_id the first one read keeps its bytes; null
doc_ids come last; an empty table gives an empty result; extra columns are ignored, whatever their names. What is no
table of files is written first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import skewed_join
from .common import checkpointed, drop_stored, partitions, release, stored, text_steps
from .ngram_join import mixed, numbered
from .suffix_sort import suffix_array

#: Bytes of a repeated string, of the strings that anchors are chosen among, and the places a window has for them.
LENGTH, GRAM = 100, 48
PLACES = LENGTH - GRAM + 1
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 20
LAST = 2**63 - 1
#: Places of one anchor from which on their windows are told apart by digests.
HOT = 2000
#: Segments handed on at a time.
STEP_SEGMENTS = 100_000
#: Bytes of segments that one block may hold.
BLOCK_BYTES = 4 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on (48 = 32 + 16, by doubling)."""
    h = mixed(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    span, half = 1, h
    while span < 32:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 * (2 * span + 1) % 2**64 | 1) + h[span:]
        span *= 2
        half = h if span == 16 else half
    return mixed(h[:n] * np.uint64(0xD1342543DE82EF95) + half[32 : 32 + n])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of the width."""
    span, out = 1, values
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """All documents of a slice at once, as one string: the hashes at all places, the least hash of each window (0 for
    windows that reach from one document into the next), the places of anchors, which are the least hash of some
    window, and where the documents begin."""
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    hashes = gram_hashes(np.frombuffer(b"".join(raws), np.uint8))
    if len(hashes) < PLACES:
        return hashes, np.empty(0, np.uint64), np.empty(0, np.int64), ends - sizes
    np.maximum(hashes, np.uint64(1), out=hashes)
    least = sliding(hashes, PLACES, np.minimum).copy()
    for end in ends.tolist():
        least[max(0, end - LENGTH + 1) : end] = 0
    edge = np.zeros(PLACES - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), PLACES, np.maximum)
    return hashes, least, np.flatnonzero(most == hashes), ends - sizes


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where SLICE_BYTES of text are reached; one long text is a slice of its own."""
    for batch in batches:
        yield from text_steps(batch, column, SLICE_BYTES, batch.num_rows)


def pieces_of(raws: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Numbers of documents, offsets in them, and bytes, about SLICE_BYTES at a time. A longer document is cut into
    pieces that overlap by a window less one byte, so each window is in one piece."""
    group: tuple[list, list, list] = ([], [], [])
    for i, raw in enumerate(raws):
        if len(raw) <= 2 * SLICE_BYTES:
            for column, value in zip(group, (i, 0, raw)):
                column.append(value)
            continue
        for at in range(0, len(raw) - LENGTH + 1, SLICE_BYTES):
            yield [i], [at], [raw[at : at + SLICE_BYTES + LENGTH - 1]]
    if group[0]:
        yield group


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


MARKS = "block int, row long, doc_id long, digest binary, bytes long, digests binary, counts binary, hashes binary, places binary"


def scatter_anchors(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows of two kinds: (row, doc_id, digest, bytes) for each document, and for each slice of documents and block the
    anchors there: digests of the documents, how many each has, 40 bits of their hashes, and their places."""
    names = [x.split()[0] for x in MARKS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 4]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 2):
            raws = [(t or "").encode() for t in part.column(2).to_pylist()]
            digests = [_digest(r) for r in raws]
            home = [int.from_bytes(d[:4], "little") % blocks for d in digests]
            empty = [None] * len(raws)
            columns = (home, part.column(0), part.column(1), digests, [len(r) for r in raws], *[empty] * 4)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema
            )
            once = {d: r for d, r in zip(digests, raws) if len(r) >= LENGTH}  # of equal documents one is enough
            if not once:
                continue
            names_of = np.frombuffer(b"".join(once), "V16")
            for group in pieces_of(list(once.values())):
                yield marks_of(group, names_of)

    def marks_of(group: tuple[list[int], list[int], list[bytes]], names_of: np.ndarray) -> pa.RecordBatch:
        index, offsets = (np.array(x, np.int64) for x in group[:2])
        hashes, _, places, begins = anchors(group[2])
        found = hashes[places]
        piece = np.searchsorted(begins, places, side="right") - 1
        owner, places = index[piece], places - begins[piece] + offsets[piece]
        # two places tell that a document has an anchor more than once, however often it does
        order = np.lexsort((places, owner, found))
        found, places, owner = found[order], places[order], owner[order]
        third = np.zeros(len(found), bool)
        third[2:] = (found[2:] == found[:-2]) & (owner[2:] == owner[:-2])
        found, places, owner = found[~third], places[~third], owner[~third]
        block = ((found >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((owner, block))
        found, places, owner = found[order], places[order].astype("<u4"), owner[order]
        low = np.ascontiguousarray(found.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        ends = np.cumsum(np.bincount(block, minlength=blocks))
        rows: list[tuple] = []
        begin = 0
        for b, end in enumerate(ends.tolist()):
            if end > begin:
                held, counts = np.unique(owner[begin:end], return_counts=True)
                parts = (names_of[held], counts.astype("<u4"), low[begin:end], places[begin:end])
                rows.append((b, *(p.tobytes() for p in parts)))
            begin = end
        columns = list(zip(*rows)) or [()] * 5
        none = [None] * len(rows)
        columns = [columns[0], *[none] * 4, *columns[1:]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)

    return docs.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(run, MARKS)


GATHERED = "row long, doc_id long, digest binary, bytes long, anchors binary, hot binary"


def gather_anchors(scattered: DataFrame) -> DataFrame:
    """Documents pass through; each digest gets back (the low 40 bits of) its anchors that stand elsewhere as well, and
    which of them stand in more than HOT places."""
    names = [x.split()[0] for x in GATHERED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def block_of(table: pa.Table) -> pa.Table:
        is_doc = pc.is_null(table["hashes"])
        docs, rows = table.filter(is_doc), table.filter(pc.invert(is_doc))
        none = pa.nulls(len(docs), pa.binary())
        out = pa.table([*(docs[c] for c in names[:4]), none, none], names=names)
        if not len(rows):
            return out
        joined = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in rows[c]), kind)
        digests, counts, places = joined("digests", "V16"), joined("counts", "<u4"), joined("places", "<u4")
        low = np.zeros((len(places), 8), np.uint8)
        low[:, :5] = joined("hashes", np.uint8).reshape(-1, 5)
        hashes = low.view("<u8")[:, 0]
        documents, number = np.unique(digests.view([("a", "<u8"), ("b", "<u8")]), return_inverse=True)
        owner = np.repeat(number, counts).astype(np.int64)
        order = np.lexsort((places, owner, hashes))
        hashes, owner, places = hashes[order], owner[order], places[order]
        # a document that came in two slices stands here twice: the same anchor at the same place is one
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]) | (places[1:] != places[:-1])
        hashes, owner, places = hashes[new], owner[new], places[new]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        width = np.diff(np.concatenate([starts, [len(hashes)]]))
        width = np.repeat(width, width)
        shared = width > 1
        owner, hashes, hot = owner[shared], hashes[shared], width[shared] > HOT
        order = np.argsort(owner, kind="stable")
        owner, hashes, hot = owner[order], hashes[order], hot[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes, hot = owner[new], hashes[new], hot[new]
        low = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
        ends = [*begin[1:], len(owner)] if len(owner) else []
        found = [
            [None] * len(ends), [None] * len(ends), [documents[owner[b]].tobytes() for b in begin], [None] * len(ends),
            [low[b:e].tobytes() for b, e in zip(begin, ends)],
            [np.packbits(hot[b:e]).tobytes() for b, e in zip(begin, ends)],
        ]
        return pa.concat_tables([out, pa.table([pa.array(c, k) for c, k in zip(found, kinds)], names=names)])

    return scattered.groupBy("block").applyInArrow(block_of, GATHERED)


SEGMENTS = "anchor long, digest binary, row long, doc_id long, at long, starts int, bytes binary"


def runs_of_windows(
    raws: list[bytes], index: np.ndarray, wanted: np.ndarray, hot: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash, whether it is hot, number of the document) for each run of windows with
    one of the ``wanted`` anchors in common: sorted numbers of 24 bits of its document and 40 of its hash. ``index``
    holds the documents' numbers."""
    hashes, least, places, begins = anchors(raws)
    windows = np.flatnonzero(least)
    if not len(windows) or not len(wanted):
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, bool), np.empty(0, np.int64))
    # the first anchor in a window that is its least hash
    k, found, least = np.searchsorted(places, windows), hashes[places], least[windows]
    wrong = np.flatnonzero(found[k] != least)
    while len(wrong):
        k[wrong] += 1
        wrong = wrong[found[k[wrong]] != least[wrong]]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(k)]]))
    own, start = k[first], windows[first]
    piece = np.searchsorted(begins, start, side="right") - 1
    key = index[piece].astype(np.uint64) << np.uint64(40) | found[own] & np.uint64((1 << 40) - 1)
    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    kept = wanted[at] == key
    own, start, n, at, piece = own[kept], start[kept], n[kept], at[kept], piece[kept]
    return start, n, found[own].astype(np.int64), hot[at], piece


def periodic(text: np.ndarray, start: np.ndarray, n: np.ndarray, hashes: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Which runs of windows equal the one right before them, byte for byte, so that all their windows also start
    earlier. Such runs follow each other where a text has a period; each stretch of them is compared once."""
    out = np.zeros(len(start), bool)
    like = np.zeros(len(start), bool)
    like[1:] = (start[1:] == start[:-1] + n[:-1]) & (n[1:] == n[:-1]) & (hashes[1:] == hashes[:-1]) & (piece[1:] == piece[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], like.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        period, low, high = int(n[a]), int(start[a]), int(start[b - 1] + n[b - 1]) + LENGTH - 1
        wrong = np.flatnonzero(text[low:high] != text[low - period : high - period]) + low
        # the first difference at or after a run's begin must lie behind its last window
        next_ = np.concatenate([wrong, [high]])[np.searchsorted(wrong, start[a:b])]
        out[a:b] = next_ >= start[a:b] + n[a:b] + LENGTH - 1
    return out


def segments(rows: DataFrame) -> DataFrame:
    """From (row, doc_id, text, parts), parts being lists of anchors with their hot flags, one row for each run
    of windows that have such an anchor in common. Runs that repeat the one before are one row for all of a stretch,
    without digest; windows of hot anchors have a row each, without anchor and bytes."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def group_rows(group, wanted, hot, rows, doc_ids) -> Iterator[tuple]:
        index, offsets, raws = group
        begins = np.cumsum([0, *map(len, raws)])
        start, n, hashes, is_hot, piece = runs_of_windows(raws, np.array(index, np.int64), wanted, hot)
        if not len(start):
            return
        whole = b"".join(raws)
        settled = periodic(np.frombuffer(whole, np.uint8), start, n, hashes, piece)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], settled.astype(np.int8), [0]])))
        stretches = [(int(start[a]), int(start[b - 1] + n[b - 1] - start[a]), piece[a]) for a, b in zip(edges[::2], edges[1::2])]
        place = lambda s, p: int(s) - int(begins[p]) + offsets[p]
        for s, count, p in stretches:
            yield None, None, rows[index[p]], doc_ids[index[p]], place(s, p), count, None
        left = ~settled
        columns = (x[left].tolist() for x in (start, n, hashes, is_hot, piece))
        for s, count, h, heavy, p in zip(*columns):
            r, d = rows[index[p]], doc_ids[index[p]]
            if heavy:
                for w in range(s, s + count):
                    yield None, _digest(whole[w : w + LENGTH]), r, d, place(w, p), 1, None
            else:
                body = whole[s : s + count + LENGTH - 1]
                yield h, _digest(body), r, d, place(s, p), count, body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 2):
            rows, doc_ids, texts, parts = (part.column(i).to_pylist() for i in range(4))
            raws = [t.encode() for t in texts]
            wanted, flags = [], []
            for i, ps in enumerate(parts):
                low = np.frombuffer(b"".join(p["anchors"] for p in ps), np.uint8).reshape(-1, 5)
                own = np.zeros((len(low), 8), np.uint8)
                own[:, :5] = low
                wanted.append(own.view("<u8")[:, 0] | np.uint64(i << 40))
                flags += [np.unpackbits(np.frombuffer(p["hot"], np.uint8), count=len(p["anchors"]) // 5) for p in ps]
            wanted, flags = np.concatenate(wanted), np.concatenate(flags).astype(bool)
            order = np.argsort(wanted)
            wanted, flags = wanted[order], flags[order]
            for group in pieces_of(raws):
                listed = group_rows(group, wanted, flags, rows, doc_ids)
                while some := list(islice(listed, STEP_SEGMENTS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)

    return rows.mapInArrow(run, SEGMENTS)


def repeats_in(bodies: list[bytes], order: list[tuple]) -> list[bytes]:
    """For every different segment, which of its windows also start earlier, as a bit map; ``order`` holds the place of
    the earliest window of each segment."""
    lengths = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    text = np.zeros(int(ends[-1]), np.int64)
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    text[:] = raw
    text += len(bodies)
    text[ends - 1] = np.arange(len(bodies))  # each segment ends with a symbol of its own
    of = np.repeat(np.arange(len(bodies)), lengths + 1)
    sorted_ = suffix_array(text)
    left = ends[of[sorted_]] - 1 - sorted_
    sorted_ = sorted_[left >= LENGTH]
    views = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    equal = np.zeros(len(sorted_), bool)
    for at in range(1, len(sorted_), 1 << 16):
        here = slice(at, min(at + (1 << 16), len(sorted_)))
        before = slice(here.start - 1, here.stop - 1)
        equal[here] = (views[sorted_[here]] == views[sorted_[before]]).all(axis=1)
    group = np.cumsum(~equal) - 1
    keys = np.array(order, np.int64)  # doc_id, row, place
    owner = of[sorted_]
    place = keys[owner, 2] + (sorted_ - begins[owner])
    by = np.lexsort((place, keys[owner, 1], keys[owner, 0], group))
    earliest = np.zeros(len(sorted_), bool)
    grouped = group[by]
    earliest[by[np.concatenate([[True], grouped[1:] != grouped[:-1]])]] = True
    flags = np.zeros(len(text), bool)
    flags[sorted_] = ~earliest
    return [
        np.packbits(flags[b : b + n - LENGTH + 1]).tobytes() for b, n in zip(begins.tolist(), lengths.tolist())
    ]


SORTED = "digest binary, row long, doc_id long, at long, n long, repeats binary"


def sorted_blocks(distinct: DataFrame, blocks: int) -> DataFrame:
    """``distinct``: (anchor, digest, bytes, doc_id, row, at, n), the earliest place of every different segment.

    Windows of one segment are never equal, for their common anchor stands at another place in each. So a segment that
    shares its anchor with no other has no repeats to look for (NULL), and all others of a block are sorted together."""

    def block_of(table: pa.Table) -> pa.Table:
        anchor = table["anchor"].to_numpy()
        _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(size[group] > 1)
        out: list[bytes | None] = [None] * len(anchor)
        if len(chosen):
            some = table.take(pa.array(chosen))
            places = zip(*(some[c].to_pylist() for c in ("doc_id", "row", "at")))
            keys = [(LAST if d is None else d, r, a) for d, r, a in places]
            for i, bits in zip(chosen.tolist(), repeats_in(some["bytes"].to_pylist(), keys)):
                out[i] = bits
        return pa.table(
            [*(table[c] for c in ("digest", "row", "doc_id", "at", "n")), pa.array(out, pa.binary())],
            names=[x.split()[0] for x in SORTED.split(", ")],
        )

    block = F.pmod("anchor", F.lit(blocks)).cast("int")
    return distinct.withColumn("block", block).groupBy("block").applyInArrow(block_of, SORTED)


def covered(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that intervals cover together."""
    if not len(begins):
        return []
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    gap = np.flatnonzero(begins[1:] > ends[:-1])
    return list(zip(begins[np.concatenate([[0], gap + 1])].tolist(), ends[np.concatenate([gap, [len(ends) - 1]])].tolist()))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, parts) for every document that is the first of its kind and has repeats, parts being (at, bit map) of its
    windows; and (row, doc_id, bytes, copy) for all documents. docs: row, doc_id, text."""
    spark = docs.sparkSession
    blocks = partitions(spark)
    gathered = stored(gather_anchors(scatter_anchors(docs, blocks)), "anchors")
    release(spark)
    rows = gathered.where("anchors IS NULL").select("row", "doc_id", "digest", "bytes")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = checkpointed(rows.groupBy("digest").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("copies")))
    named = checkpointed(
        skewed_join(rows, heads, ["digest"], counts=heads, n="copies").select(
            "row", "doc_id", "bytes", (F.col("least.row") != F.col("row")).alias("copy")
        )
    )
    marked = gathered.where("anchors IS NOT NULL").groupBy("digest").agg(
        F.collect_list(F.struct("anchors", "hot")).alias("parts")
    )
    wanted = marked.join(heads, "digest").select(F.col("least.row").alias("row"), "parts")
    texts = docs.select("row", F.col("doc_id").cast("long"), "text").join(wanted, "row")
    pieces = stored(segments(texts.select("row", "doc_id", "text", "parts")), "segments", "zstd")
    drop_stored(gathered)
    del texts, wanted, marked
    release(spark)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")).alias("f")
    n = F.count(F.lit(1)).alias("n")
    held = pieces.where("bytes IS NOT NULL")
    size = held.agg(F.sum(F.col("starts") + (LENGTH - 1))).first()[0] or 0
    distinct = held.groupBy("digest").agg(
        F.first("anchor").alias("anchor"), F.first("bytes").alias("bytes"), first, n
    ).select("anchor", "digest", "bytes", "f.doc_id", "f.row", "f.at", "n")
    sorted_ = sorted_blocks(distinct, max(blocks * 4, -(-size // BLOCK_BYTES)))
    single = pieces.where("digest IS NOT NULL AND bytes IS NULL").groupBy("digest").agg(first, n)
    alone = single.select("digest", "f.row", "f.doc_id", "f.at", "n", F.lit(None).cast("binary").alias("repeats"))
    found = stored(sorted_.unionByName(alone), "repeats")
    release(spark)
    judged = found.select("digest", F.col("row").alias("row0"), F.col("at").alias("at0"), "repeats")
    head = (F.col("row") == F.col("row0")) & (F.col("at") == F.col("at0"))
    # every segment but the earliest of its kind repeats as a whole (no bit map)
    known = pieces.where("digest IS NOT NULL").select("digest", "row", "at", "starts")
    hits = skewed_join(known, judged, ["digest"], counts=found.select("digest", "n"), n="n").where(
        ~head | F.col("repeats").isNotNull()
    ).select("row", F.struct("at", "starts", F.when(head, F.col("repeats")).alias("repeats")).alias("p"))
    settled = pieces.where("digest IS NULL").select(
        "row", F.struct("at", "starts", F.lit(None).cast("binary").alias("repeats")).alias("p")
    )
    parts = stored(hits.unionByName(settled).groupBy("row").agg(F.collect_list("p").alias("parts")), "parts", "zstd")
    drop_stored(pieces, found)
    release(spark)
    return parts, named


def intervals(at: np.ndarray, starts: np.ndarray, repeats: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that repeated windows cover, as intervals. A part without a bit map repeats as a whole."""
    begins, ends = [], []
    whole = np.array([r is None for r in repeats], bool)
    begins.append(at[whole])
    ends.append(at[whole] + starts[whole] + LENGTH - 1)
    for i in np.flatnonzero(~whole).tolist():
        bits = np.unpackbits(np.frombuffer(repeats[i], np.uint8), count=int(starts[i])).astype(np.int8)
        edges = np.diff(np.concatenate([[0], bits, [0]]))
        begins.append(at[i] + np.flatnonzero(edges == 1))
        ends.append(at[i] + np.flatnonzero(edges == -1) + LENGTH - 1)
    return np.concatenate(begins), np.concatenate(ends)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, n_bytes, spans (begin, end of the removed runs of bytes), and
    kept, the remaining bytes."""
    rows = numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    parts, named = repeated_spans(rows)
    wide = rows.select("row", "text").join(named.join(parts, "row", "left"), "row").select(
        "doc_id", "copy", "text", "parts"
    )
    ddl = "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 2):
            sizes, spans, kept = [], [], []
            parts = part.column(3)
            offsets = np.asarray(parts.offsets, np.int64).tolist()
            at_, starts = (np.asarray(parts.values.field(k)).astype(np.int64) for k in (0, 1))
            repeats = parts.values.field(2)
            for i, (copy, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                raw = (text or "").encode()
                here = slice(offsets[i], offsets[i + 1])
                if copy and len(raw) >= LENGTH:
                    runs = [(0, len(raw))]
                elif here.start == here.stop:
                    runs = []
                else:
                    bits = repeats.slice(here.start, here.stop - here.start).to_pylist()
                    runs = covered(*intervals(at_[here], starts[here], bits))
                at, rest = 0, []
                for begin, end in runs:
                    rest.append(raw[at:begin])
                    at = end
                sizes.append(len(raw))
                spans.append([{"begin": b, "end": e} for b, e in runs])
                kept.append(b"".join([*rest, raw[at:]]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return wide.mapInArrow(run, ddl)
