"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased runs of letters and digits with one space between them. A test item of m characters
may differ from a passage by ``k = m * budget / 100`` edits; cut into k + 1 pieces, at least one piece must then stand
in the passage unchanged. One automaton finds all pieces of all items in one pass over a text, and every place that a
piece points to is verified with Myers' bit-parallel edit distance over the item's whole length. An item of fewer than
``LEAST`` characters is one piece that must stand in the passage unchanged and between word boundaries; in scripts that
put no space between words, every place between two characters is one.

Items are few against the documents. They travel to the executors in broadcast blocks of a measured size
(``BLOCK_BYTES``), and the documents are read once, whatever the number of blocks. Documents never move.

Defined results: null and empty texts and items, and items without a letter or digit, match nothing; texts may be of any
length; equal items are all reported; a repeated document is judged each time it stands there; of equally close passages
the first is reported; an empty table gives an empty result, an empty benchmark finds nothing; extra columns pass through
``decontaminate``, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_steps

#: Edits allowed for each hundred characters of an item.
BUDGET = 8
#: Items with fewer normalised characters are matched without edits and as whole words: with edits, ordinary phrases
#: would match them.
LEAST = 25
BLOCK_BYTES = 4 << 20
#: Bytes of documents for which the automaton of a block is built, where there are several blocks.
HELD_BYTES = 64 << 20
GAP = re.compile(r"[\W_]+")
RUN = re.compile(r"[^\W_]+")
#: Letters of scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\uff66-\uff9f\U00020000-\U0003ffff]"
)


def normal(text: str) -> str:
    return GAP.sub(" ", text.lower()).strip()


def edits(m: int, budget: int) -> int:
    return m * budget // 100


def boundary(text: str, at: int) -> bool:
    """Whether a word of a normalised text may begin or end at a place."""
    if at <= 0 or at >= len(text):
        return True
    a, b = text[at - 1], text[at]
    return a == " " or b == " " or bool(UNSPACED.match(a) or UNSPACED.match(b))


def closest(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern anywhere in the text, the first of equals; None beyond
    ``most`` edits. Myers' algorithm, one machine-independent integer for a column."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    return _closest(where, m, text, most)


def _closest(where: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best, get = full, 0, m, None, where.get
    for j, c in enumerate(text):
        x = get(c, 0) | minus
        zero = (((x & plus) + plus) ^ plus) | x
        up = minus | (full & ~(plus | zero))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score <= most:
                best, most = (score, j + 1), score - 1
                if most < 0:
                    break
        up <<= 1
        minus = up & zero & full
        plus = (down << 1 | ~(up | zero)) & full
    return best


class Matcher:
    """All pieces of a block of items, (item_id, normalised text) each."""

    def __init__(self, items: list[tuple[int, str]], budget: int):
        import ahocorasick

        self.items, self.budget, pieces = items, budget, {}
        self.where, self.back = [], []
        for n, (_, text) in enumerate(items):
            m, k = len(text), edits(len(text), budget) if len(text) >= LEAST else 0
            for i in range(k + 1):
                begin, end = m * i // (k + 1), m * (i + 1) // (k + 1)
                pieces.setdefault(text[begin:end], []).append((n, end))
            for tables, body in ((self.where, text), (self.back, text[::-1])):
                table: dict[str, int] = {}
                for i, c in enumerate(body):
                    table[c] = table.get(c, 0) | 1 << i
                tables.append(table)
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, distance) of the best passage for each item, in a normalised text."""
        if not self.any:
            return []
        starts: dict[int, set[int]] = {}
        for last, places in self.automaton.iter(text):
            for n, end in places:
                starts.setdefault(n, set()).add(last + 1 - end)
        out = []
        for n, begins in sorted(starts.items()):
            m = len(self.items[n][1])
            if m < LEAST:
                whole = (b for b in begins if boundary(text, b) and boundary(text, b + m))
                if (first := min(whole, default=None)) is not None:
                    out.append((n, first, first + m, 0))
                continue
            most, k, best = edits(m, self.budget), edits(m, self.budget), None
            windows: list[list[int]] = []
            for b in sorted(begins):
                lo, hi = max(0, b - k), min(len(text), b + m + k)
                if windows and lo <= windows[-1][1] and hi - windows[-1][0] <= 4 * m:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                if most < 0:
                    break
                if found := _closest(self.where[n], m, text[lo:hi], most):
                    best, most = (found[0], lo + found[1]), found[0] - 1
            if best:
                distance, end = best
                begin = max(0, end - m - k)
                _, length = _closest(self.back[n], m, text[begin:end][::-1], distance)
                out.append((n, end - length, end, distance))
        return out


def original(text: str, begin: int, end: int) -> tuple[int, int]:
    """Where a span of the normalised text stands in the text itself."""
    at, first, last = 0, None, None
    for m in RUN.finditer(text.lower() if len(text.lower()) == len(text) else text):
        stop = at + len(m[0])
        if first is None and begin < stop:
            first = m.start() + max(0, begin - at)
        if end > at:
            last = m.start() + min(len(m[0]), end - at)
        if end <= stop:
            break
        at = stop + 1
    return first if first is not None else 0, last if last is not None else len(text)


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list:
    """The normalised items in blocks of a bounded size. Each goes from the driver into a broadcast file and is dropped
    there, so the driver holds one block at a time."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    out = []
    for k in range(n):
        here = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        items = [(r.i, normal(r.t)) for r in here.collect()]
        if items := [(i, t) for i, t in items if t]:
            items.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            held = benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))
            out.append(held)
    return out


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(block, budget: int) -> Matcher:
    """This worker's automaton for a block; only the latest is kept."""
    name, items = block.value
    if (name, budget) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name, budget] = Matcher(items, budget)
    return _MATCHERS[name, budget]


def _held(batches: Iterator[pa.RecordBatch], column: int, blocks: int) -> Iterator[list[pa.RecordBatch]]:
    """Documents that are matched with one block after the other: a step at a time for one block, else so many bytes
    that an automaton is worth building for them."""
    held, total = [], 0
    for batch in batches:
        for part in text_steps(batch, column):
            held.append(part)
            total += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if blocks < 2 or total >= HELD_BYTES:
                yield held
                held, total = [], 0
    if held:
        yield held


def _found(parts: list[pa.RecordBatch], column: int, blocks: list, budget: int) -> Iterator[tuple[int, int, Matcher, str, tuple]]:
    """(part, row, matcher, text, finding) for all documents of the parts and all blocks."""
    for block in blocks:
        matcher = _matcher(block, budget)
        for k, part in enumerate(parts):
            for i, x in enumerate(part.column(column)):
                if text := x.as_py():
                    for finding in matcher.find(normal(text)):
                        yield k, i, matcher, text, finding


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, budget: int = BUDGET, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, start, end (code points), distance."""
    ddl = "doc_id long, item_id long, start long, end long, distance int"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    blocks = blocks_of(benchmark, "item_id", "text", block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _held(batches, 1, len(blocks)):
            rows = []
            for k, i, matcher, text, (n, begin, end, distance) in _found(parts, 1, blocks, budget):
                place = original(text, begin, end)
                rows.append((parts[k].column(0)[i].as_py(), matcher.items[n][0], *place, distance))
            if rows:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start", "end", "distance"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, budget: int = BUDGET, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents that hold no test item, with their own columns."""
    names, schema = docs.columns, docs.schema
    blocks = blocks_of(benchmark, "item_id", "text", block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _held(batches, len(names), len(blocks)):
            hit = {(k, i) for k, i, *_ in _found(parts, len(names), blocks, budget)}
            for k, part in enumerate(parts):
                part = part.filter(pa.array([(k, i) not in hit for i in range(part.num_rows)], pa.bool_()))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names)

    own = [F.col(f"`{c}`") for c in names]
    return docs.select(*own, F.col("text").alias(free_name(docs, "__text"))).mapInArrow(run, schema)
