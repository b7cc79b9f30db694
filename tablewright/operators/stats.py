"""Statistics of many columns in few passes.

Everything that is asked of a table is put into one wide aggregate per pass, so a table is read a fixed number of times
however many columns it has. Distinct counts and quantiles are exact at every size. Up to ``EXACT_ROWS`` rows quantiles
are part of that aggregate, which holds all distinct values of a column in one task. Beyond, a sketch only says between
which values a quantile lies; those are counted and ranked in passes of their own (``selected``).
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as fc

#: More rows change how quantiles are found, not what they are.
EXACT_ROWS = 1_000_000
#: Up to so many rows one pass counts distinct values at once; up to so many distinct values are collected as a set.
SMALL_ROWS, FEW = 50_000, 5_000
#: Relative error of the sketches that say how to count and where to look.
ERROR = 0.05
ACCURACY = 10_000


@dataclass
class ColumnStats:
    name: str
    kind: T.DataType
    rows: int
    present: int
    distinct: int
    mean_length: float | None = None
    mean_words: float | None = None
    q1: float | None = None
    q3: float | None = None
    variance: float | None = None

    @property
    def missing_rate(self) -> float:
        return (self.rows - self.present) / self.rows if self.rows else 0.0


@contextmanager
def held(df):
    """The table, read and joined once for all passes inside; what is kept of it is let go at the end. A table that its
    owner has persisted stays as it is."""
    own = isinstance(df, DataFrame) and not df.isStreaming
    own = own and not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    if own:
        df.persist()
    try:
        yield df
    finally:
        if own:
            df.unpersist()


def quantiles(c: Column, points: list[float], rows: int) -> Column:
    """Part of an aggregate; beyond ``EXACT_ROWS`` NULL, for ``settled`` to fill in."""
    if rows > EXACT_ROWS:
        return F.lit(None).cast("array<double>")
    return F.percentile(c, F.array(*map(F.lit, points)))


def settled(
    df: DataFrame, asked: list[tuple[Column, list[float]]], found: list[list[float] | None], rows: int
) -> list[list[float] | None]:
    """The quantiles of each column asked for, given what ``quantiles`` found for it."""
    return selected(df, asked) if rows > EXACT_ROWS and asked else found


def selected(df: DataFrame, asked: list[tuple[Column, list[float]]]) -> list[list[float] | None]:
    """Exact quantiles, interpolated as ``percentile`` does, without holding a column's values in one task: a sketch
    gives a narrow range for each, and the values inside it are counted and ranked. A range that proves not to hold its
    quantile is opened to the whole column."""
    xs = [c.cast("double") for c, _ in asked]
    spread = 2 / ACCURACY
    first: list[Column] = []
    for x, (_, points) in zip(xs, asked):
        ends = [min(1.0, max(0.0, p + d)) for p in points for d in (-spread, spread)]
        first += [F.count(x), F.percentile_approx(x, ends, ACCURACY)]
    row = df.agg(*(e.alias(f"a{i}") for i, e in enumerate(first))).first()
    todo = {}
    for i, (_, points) in enumerate(asked):
        n, ends = row[2 * i], row[2 * i + 1]
        for j, p in enumerate(points if n else []):
            low = ends[2 * j] if p - spread > 0 else None
            high = ends[2 * j + 1] if p + spread < 1 else None
            todo[i, j] = (p * (n - 1), low, high)
    held: dict[tuple[int, int, int], float] = {}
    for _ in range(2):
        keys = [k for k, (at, _, _) in todo.items() if not {(*k, math.floor(at)), (*k, math.ceil(at))} <= held.keys()]
        if not keys:
            break
        held |= _ranked(df, xs, {k: todo[k] for k in keys})
        todo |= {k: (todo[k][0], None, None) for k in keys}
    out: list[list[float] | None] = []
    for i, (_, points) in enumerate(asked):
        values = []
        for j in range(len(points) if row[2 * i] else 0):
            at = todo[i, j][0]
            low, high = math.floor(at), math.ceil(at)
            a, b = held[i, j, low], held[i, j, high]
            values.append(a if a == b or low == high else (high - at) * a + (at - low) * b)
        out.append(values or None)
    return out


def _ranked(
    df: DataFrame, xs: list[Column], todo: dict[tuple[int, int], tuple[float, float | None, float | None]]
) -> dict[tuple[int, int, int], float]:
    """The values at the ranks on both sides of a place, for each (place, low, high): those that lie in its range."""
    keys, below, cells, any_inside = list(todo), [], [], F.lit(False)
    for k, (key, (_, low, high)) in enumerate(todo.items()):
        x = xs[key[0]]
        inside = x.isNotNull()
        if low is not None:
            inside = inside & (x >= low)
        if high is not None:
            inside = inside & (x <= high)
        below.append((F.count_if(x < low) if low is not None else F.max(F.lit(0))).alias(f"b{k}"))
        cells.append(F.when(inside, F.struct(F.lit(k).alias("k"), x.alias("x"))))
        any_inside = any_inside | inside
    before = df.agg(*below).first()
    near = df.where(any_inside)  # few rows, before arrays are made of them
    counted = near.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.k", "c.x").count()
    upto = F.sum("count").over(Window.partitionBy("k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto)
    ends = []
    for k, key in enumerate(keys):
        for rank in {math.floor(todo[key][0]), math.ceil(todo[key][0])}:
            rest = rank - before[k]
            ends.append(F.when((F.col("k") == k) & (F.col("upto") > rest) & (F.col("upto") - F.col("count") <= rest), F.lit(rank)))
    hits = ranked.select("k", "x", F.explode(F.array_compact(F.array(*ends))).alias("rank")).collect()
    return {(*keys[r.k], r["rank"]): r.x for r in hits}


def distinct_counts(df: DataFrame, columns: list[str], estimates: dict[str, int]) -> dict[str, int]:
    """Exact distinct counts. Columns of few values are collected as sets inside the one aggregate; only the others are
    expanded and shuffled value by value."""
    few = [c for c in columns if estimates[c] <= FEW]
    many = [c for c in columns if estimates[c] > FEW]
    out: dict[str, int] = {}
    if few:
        out |= dict(zip(few, df.agg(*(F.size(F.collect_set(fc.named(c))).alias(f"d{i}") for i, c in enumerate(few))).first()))
    if many:
        out |= dict(zip(many, df.agg(*(F.countDistinct(fc.named(c)).alias(f"d{i}") for i, c in enumerate(many))).first()))
    return out


#: What ``column_stats`` can find out; rows and present values always are.
ALL = ("distinct", "text", "quartiles", "variance")


def column_stats(df: DataFrame, columns: list[str], wanted: tuple[str, ...] = ALL) -> dict[str, ColumnStats]:
    """Statistics of the columns: the ``wanted`` ones, others are None (distinct: 0)."""
    kinds = {f.name: f.dataType for f in df.schema}
    quarters = [c for c in columns if "quartiles" in wanted and fc.is_numeric(kinds[c])]
    rows = df.count() if quarters or "distinct" in wanted else None  # decides how the others are found
    small = rows is not None and rows <= SMALL_ROWS
    asked: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        col, kind = fc.named(c), kinds[c]
        asked.append(F.count(col).alias(f"n{i}"))
        if "distinct" in wanted:
            asked.append((F.countDistinct(col) if small else F.approx_count_distinct(col, ERROR)).alias(f"d{i}"))
        if fc.is_string(kind) and "text" in wanted:
            asked += [F.avg(F.length(col)).alias(f"l{i}"), F.avg(fc.words(col)).alias(f"w{i}")]
        elif fc.is_numeric(kind):
            if c in quarters:
                asked.append(quantiles(fc.number(col), [0.25, 0.75], rows).alias(f"q{i}"))
            if "variance" in wanted:
                asked.append(F.var_samp(fc.number(col)).alias(f"v{i}"))
    row = df.agg(*asked).first().asDict()
    numeric = [i for i, c in enumerate(columns) if c in quarters]
    points = [(fc.number(fc.named(columns[i])), [0.25, 0.75]) for i in numeric]
    if points:
        row |= {f"q{i}": q for i, q in zip(numeric, settled(df, points, [row[f"q{i}"] for i in numeric], rows))}
    out = {}
    for i, c in enumerate(columns):
        q = row.get(f"q{i}") or [None, None]
        out[c] = ColumnStats(
            c, kinds[c], row["rows"], row[f"n{i}"], row.get(f"d{i}", 0), row.get(f"l{i}"), row.get(f"w{i}"), q[0], q[1],
            row.get(f"v{i}"),
        )
    if "distinct" in wanted and not small:
        for c, n in distinct_counts(df, columns, {c: out[c].distinct for c in columns}).items():
            out[c].distinct = n
    return out


def outlier_rates(df: DataFrame, stats: dict[str, ColumnStats]) -> dict[str, float | None]:
    """The share of present values beyond 1.5 interquartile ranges; None where that range is nothing."""
    out: dict[str, float | None] = {}
    asked = []
    for i, (c, s) in enumerate(stats.items()):
        if not fc.is_numeric(s.kind):
            out[c] = None
        elif not s.present:
            out[c] = 0.0
        elif s.q3 == s.q1:
            out[c] = None
        else:
            spread, x = 1.5 * (s.q3 - s.q1), fc.number(fc.named(c))
            asked.append((c, F.avg(fc.outside(x, s.q1 - spread, s.q3 + spread).cast("double")).alias(f"o{i}")))
    if asked:
        out |= dict(zip([c for c, _ in asked], df.agg(*(e for _, e in asked)).first()))
    return out


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n): how often each value stands in each column, from one pass."""
    listed = [F.struct(F.lit(c).alias("name"), fc.named(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*listed)).alias("x")).select("x.name", "x.value").where("value IS NOT NULL")
    return long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def rare_values(df: DataFrame, columns: list[str], share: float = 0.01, fold: list[str] = ()) -> dict[str, list[str]]:
    """The values of each column that make up less than a share of its present rows; texts of columns to ``fold`` are
    normalised first, each different text once."""
    if not columns:
        return {}
    counted = frequencies(df, columns)
    if fold:
        value = F.when(F.col("name").isin(*fold), fc.normalised(F.col("value"))).otherwise(F.col("value"))
        counted = counted.groupBy("name", value.alias("value")).agg(F.sum("n").alias("n"))
    # one row a column, so it is joined by broadcast whatever the number of values
    totals = F.broadcast(counted.groupBy("name").agg(F.sum("n").alias("total")))
    rare = counted.join(totals, "name").where(F.col("n") < F.lit(share) * F.col("total")).select("name", "value")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in rare.toLocalIterator():
        found[r["name"]].append(r["value"])
    return {c: sorted(v, key=lambda x: x.encode()) for c, v in found.items()}


def correlations(df: DataFrame, columns: list[str], target: str) -> dict[str, float | None]:
    if not columns:
        return {}
    y = fc.number(fc.named(target))
    asked = [fc.correlation(fc.number(fc.named(c)), y).alias(f"r{i}") for i, c in enumerate(columns)]
    return dict(zip(columns, df.agg(*asked).first()))


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson's r of all pairs, each over the rows where both are there; NaN where there is none."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    out = np.eye(n)
    if pairs:
        xs = [fc.number(fc.named(c)) for c in columns]
        row = df.agg(*(fc.correlation(xs[i], xs[j]).alias(f"r{k}") for k, (i, j) in enumerate(pairs))).first()
        for (i, j), r in zip(pairs, row):
            out[i, j] = out[j, i] = np.nan if r is None else r
    return out


def variance_inflation(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The diagonal of the inverse correlation matrix over the rows where all columns are there. Columns without
    variation are left out first (None); a singular matrix gives None for all."""
    none: dict[str, float | None] = dict.fromkeys(columns)
    if len(columns) < 2:
        return none
    xs = [fc.number(fc.named(c)) for c in columns]
    whole = df.where(fc.all_of(x.isNotNull() for x in xs))
    first = whole.agg(F.count(F.lit(1)), *(F.stddev_samp(x) for x in xs)).first()
    varying = [c for c, s in zip(columns, first[1:]) if s]
    if first[0] < 2 or len(varying) < 2:
        return none
    try:
        inverse = np.linalg.inv(correlation_matrix(whole, varying))
    except np.linalg.LinAlgError:
        return none
    return none | {c: max(0.0, float(v)) for c, v in zip(varying, np.diag(inverse))}


def binned(c: Column, cuts: list[float]) -> Column:
    """The number of cut points below a value: its bin."""
    out = F.lit(0)
    for cut in sorted(set(cuts)):
        out = out + (c > F.lit(float(cut))).cast("int")
    return F.when(c.isNotNull(), out)


def mutual_information(
    df: DataFrame, columns: list[str], target: str, stats: dict[str, ColumnStats], bins: int = 10, discrete: int = 20
) -> dict[str, float | None]:
    """Mutual information with the target in nats, by counting: numbers of more than ``discrete`` values are cut into
    ``bins`` quantile bins first. Counted and summed on the executors; one row for each column comes back."""
    if not columns:
        return {}
    everything = [*columns, target]
    wide = [c for c in everything if fc.is_numeric(stats[c].kind) and stats[c].distinct > discrete]
    points = [i / bins for i in range(1, bins)]
    rows = stats[target].rows
    cuts = {}
    if wide:
        row = df.agg(*(quantiles(fc.number(fc.named(c)), points, rows).alias(f"q{i}") for i, c in enumerate(wide))).first()
        found = settled(df, [(fc.number(fc.named(c)), points) for c in wide], list(row), rows)
        cuts = {c: q for c, q in zip(wide, found) if q is not None}

    def key(c: str) -> Column:
        return binned(fc.number(fc.named(c)), cuts[c]).cast("string") if c in cuts else fc.named(c).cast("string")

    y = key(target)
    listed = [F.struct(F.lit(i).alias("i"), key(c).alias("x"), y.alias("y")) for i, c in enumerate(columns)]
    cells = (
        df.select(F.explode(F.array(*listed)).alias("c")).select("c.*").where("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("i", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    ).persist()  # else each of the four uses counts the table again
    cells.count()  # now, or the uses that run side by side each count it before it is there
    of_x = cells.groupBy("i", "x").agg(F.sum("n").alias("nx"))
    of_y = cells.groupBy("i", "y").agg(F.sum("n").alias("ny"))
    total = cells.groupBy("i").agg(F.sum("n").alias("nn"))
    joined = cells.join(of_x, ["i", "x"]).join(of_y, ["i", "y"]).join(total, "i")
    term = F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))
    try:
        found = {r["i"]: max(0.0, r["mi"]) for r in joined.groupBy("i").agg(F.sum(term).alias("mi")).collect()}
    finally:
        cells.unpersist()
    return {c: found.get(i) for i, c in enumerate(columns)}


def monotonic(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which columns only rise or only fall in the order the table is read, and have no NULL. Each partition is judged
    by itself, then the partitions' ends against each other: nothing is sorted across partitions."""
    if not columns:
        return {}
    order = Window.partitionBy("__p").orderBy("__i")
    base = df.select(
        *(fc.named(c).alias(f"c{i}") for i, c in enumerate(columns)),
        F.spark_partition_id().alias("__p"),
        F.monotonically_increasing_id().alias("__i"),
    )
    steps, asked = [], []
    for i in range(len(columns)):
        before = F.lag(f"c{i}").over(order)
        steps += [F.coalesce(F.col(f"c{i}") >= before, F.lit(True)).alias(f"u{i}")]
        steps += [F.coalesce(F.col(f"c{i}") <= before, F.lit(True)).alias(f"d{i}")]
        asked += [F.min(f"u{i}"), F.min(f"d{i}"), F.min(F.col(f"c{i}").isNotNull())]
        asked += [F.min_by(f"c{i}", "__i"), F.max_by(f"c{i}", "__i")]
    parts = base.select("*", *steps).groupBy("__p").agg(*asked).collect()
    out = {}
    for i, c in enumerate(columns):
        own = [r[1 + 5 * i : 6 + 5 * i] for r in sorted(parts, key=lambda r: r["__p"])]
        ends = list(zip(own, own[1:]))
        if not all(x[2] for x in own):
            out[c] = False
            continue
        up = all(x[0] for x in own) and all(a[4] <= b[3] for a, b in ends)
        down = all(x[1] for x in own) and all(a[4] >= b[3] for a, b in ends)
        out[c] = up or down
    return out


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.where(fc.named(target).isNotNull()).groupBy(fc.named(target).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def imbalance(df: DataFrame, target: str) -> float | None:
    """Rows of the largest class for each row of the smallest; None for fractions and for a single class."""
    if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        return None
    low, high, n = class_counts(df, target).agg(F.min("n"), F.max("n"), F.count("n")).first()
    return high / low if n > 1 else None
