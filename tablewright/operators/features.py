"""Features that are added on request: pairs of numbers, times, clusters, texts.

Each is described by plain data (``{"kind": ..., ...}``), found once by a fit, and made into columns from it.
"""

from __future__ import annotations

import math
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..types import ColumnProfile, FeatureConfig, SemanticType

#: Tokens of two or more letters, digits or underscores, in any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"
MOST_CLUSTERS, FALLBACK_CLUSTERS, SEED = 10, 2, 42
#: Up to so many rows are clustered as they lie; beyond so many distinct points a sketch is enough to tell.
SPREAD_ROWS, MANY_POINTS = 50_000, 1_000
NAMES = {"ratio": "div", "product": "times", "difference": "minus"}

Feature = dict[str, Any]


def strongest(profiles: list[ColumnProfile], present: list[str], top_k: int) -> list[str]:
    """Numbers by the larger of correlation and information with the target; of the first ``top_k`` those present."""
    numeric = [p for p in profiles if p.semantic_type is SemanticType.NUMERIC_FEATURE]
    score = lambda p: max(abs(p.correlation_with_target or 0.0), abs(p.mutual_info_with_target or 0.0))
    return [p.name for p in sorted(numeric, key=lambda p: -score(p))[:top_k] if p.name in present]


def interactions(columns: list[str], kinds: list[str]) -> list[Feature]:
    return [
        {"kind": "interaction", "op": op, "a": a, "b": b, "names": [f"{a}_{NAMES[op]}_{b}"]}
        for a, b in combinations(columns, 2)
        for op in ("ratio", "product", "difference")
        if op in kinds
    ]


def date_features(columns: list[str], config: FeatureConfig) -> list[Feature]:
    out: list[Feature] = []
    if config.datetime_cyclical:
        ends = ("month_sin", "month_cos", "dayofweek_sin", "dayofweek_cos", "is_weekend")
        out += [{"kind": "cyclical", "column": c, "names": [f"{c}_{e}" for e in ends]} for c in columns]
    if config.datetime_deltas:
        out += [{"kind": "delta", "a": a, "b": b, "names": [f"{a}_to_{b}_days"]} for a, b in combinations(columns, 2)]
    if (ref := config.datetime_reference_col) in columns:
        out += [{"kind": "since", "a": ref, "b": c, "names": [f"{c}_days_since_ref"]} for c in columns if c != ref]
    return out


def text_feature(column: str) -> Feature:
    return {"kind": "text", "column": column, "names": [f"{column}_{e}" for e in ("char_length", "word_count", "has_text")]}


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fit_tfidf(df: DataFrame, column: str, top_k: int) -> Feature | None:
    """The most frequent terms (ties by the alphabet) with their weights; None if there is no term at all."""
    listed = df.select(tokens(fc.named(column)).alias("t"))
    n = listed.count()
    # every use of a term, and every term of a text once more: uses and texts are summed in the same shuffle
    seen = F.concat(
        F.transform("t", lambda t: F.struct(t.alias("term"), F.lit(1).alias("use"), F.lit(0).alias("text"))),
        F.transform(F.array_distinct("t"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("use"), F.lit(1).alias("text"))),
    )
    counted = listed.select(F.explode(seen).alias("s")).groupBy("s.term").agg(
        F.sum("s.use").alias("uses"), F.sum("s.text").alias("texts")
    )
    top = counted.orderBy(F.desc("uses"), "term").limit(top_k).collect()
    if not top:
        return None
    terms = sorted((r["term"], math.log((1 + n) / (1 + r["texts"])) + 1) for r in top)
    return {"kind": "tfidf", "column": column, "terms": [list(t) for t in terms], "names": [f"{column}_tfidf_{t}" for t, _ in terms]}


def fit_clusters(df: DataFrame, columns: list[str], k: int | str) -> Feature | None:
    """Centres of k-means over the columns, missing values being 0; with "auto" the k of best silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    if not columns:
        return None
    filled = df.select(*(F.coalesce(fc.number(fc.named(c)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)))
    filled = filled.persist()
    points = VectorAssembler(inputCols=filled.columns, outputCol="features").transform(filled).select("features")
    try:
        sizes = [r["count"] for r in filled.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        n, cores = sum(sizes), df.sparkSession.sparkContext.defaultParallelism
        # the sketch only tells whether the distinct points are few; those are counted
        many = filled.agg(F.approx_count_distinct(F.struct(*filled.columns))).first()[0] > MANY_POINTS
        distinct = MOST_CLUSTERS + 1 if many else filled.distinct().limit(MOST_CLUSTERS + 1).count()
        if n > SPREAD_ROWS and max(sizes) * cores > 2 * n:  # as the rows lie, few tasks would hold most of them
            points = points.repartition(2 * cores)
        points = points.persist()
        fit = lambda k: KMeans(k=k, seed=SEED).fit(points)
        if n < 2 or distinct < 2:
            return None
        if k == "auto":
            best, chosen = -2.0, None
            for size in range(2, min(MOST_CLUSTERS, n - 1, distinct) + 1):
                model = fit(size)
                if len(model.clusterCenters()) < 2:
                    continue
                score = ClusteringEvaluator().evaluate(model.transform(points))
                if score > best:
                    best, chosen = score, model
            chosen = chosen or fit(FALLBACK_CLUSTERS)
        else:
            chosen = fit(min(k, n)) if min(k, n) > 1 else None
        centres = [[float(x) for x in c] for c in chosen.clusterCenters()] if chosen else [_means(points, len(columns))]
    finally:
        points.unpersist()
        filled.unpersist()
    return {"kind": "cluster", "columns": list(columns), "centres": centres, "names": ["cluster_label", "cluster_dist_to_centroid"]}


def _means(points: DataFrame, width: int) -> list[float]:
    from pyspark.ml.functions import vector_to_array

    row = points.select(vector_to_array("features").alias("v")).agg(*(F.avg(F.get("v", F.lit(i))) for i in range(width))).first()
    return [float(x) for x in row]


def nearest(values: list[Column], centres: list[list[float]]) -> Column:
    """(distance, number) of the nearest centre, the first one of equals."""
    points = []
    for i, centre in enumerate(centres):
        square = sum((((v - F.lit(x)) * (v - F.lit(x))) for v, x in zip(values, centre)), F.lit(0.0))
        points.append(F.struct(F.sqrt(square).alias("distance"), F.lit(i).alias("label")))
    return points[0] if len(points) == 1 else F.least(*points)


def helper(feature: Feature) -> Column | None:
    """What several columns of a feature share, computed once for each row."""
    if feature["kind"] == "cluster":
        values = [F.coalesce(fc.number(fc.named(c)), F.lit(0.0)) for c in feature["columns"]]
        return nearest(values, feature["centres"])
    if feature["kind"] == "tfidf":
        held = fc.named("__tokens_" + feature["column"])
        return F.array(*(uses(held, term) * F.lit(weight) for term, weight in feature["terms"]))
    return None


def uses(held: Column, term: str) -> Column:
    return F.size(F.filter(held, lambda t: t == term))


def feature_columns(feature: Feature, source, shared: Column | None) -> list[Column]:
    """The columns of a feature; ``source`` gives the column of a name, ``shared`` is the helper's."""
    kind, names = feature["kind"], feature["names"]
    if kind == "interaction":
        a, b = fc.number(source(feature["a"])), fc.number(source(feature["b"]))
        op = feature["op"]
        out = [F.try_divide(a, b) if op == "ratio" else a * b if op == "product" else a - b]
    elif kind == "cyclical":
        c = source(feature["column"])
        day = F.weekday(c)
        out = [*fc.cycle(F.month(c), 12), *fc.cycle(day, 7), day >= 5]
    elif kind in ("delta", "since"):
        out = [fc.days_between(source(feature["a"]), source(feature["b"]))]
    elif kind == "text":
        c = F.coalesce(source(feature["column"]), F.lit(""))
        out = [F.length(c), fc.words(c), (F.length(fc.stripped(c)) > 0).cast("int")]
    elif kind == "cluster":
        out = [shared["label"], shared["distance"]]
    else:
        length = F.sqrt(F.aggregate(shared, F.lit(0.0), lambda a, x: a + x * x))
        out = [F.coalesce(F.try_divide(F.get(shared, F.lit(i)), length), F.lit(0.0)) for i in range(len(names))]
    return [x.alias(n) for x, n in zip(out, names, strict=True) if n not in feature.get("leave_out", ())]


def with_features(df: DataFrame, features: list[Feature], raw: dict[str, str] | None = None) -> DataFrame:
    """df with the features' columns. ``raw`` names the columns that hold values from before encoding."""
    raw = raw or {}
    source = lambda c: fc.named(raw.get(c, c))
    texts = {f["column"] for f in features if f["kind"] == "tfidf"}
    own = [fc.named(c) for c in df.columns]
    if texts:
        df = df.select(*own, *(tokens(source(c)).alias("__tokens_" + c) for c in sorted(texts)))
    helpers = {i: h for i, f in enumerate(features) if (h := helper(f)) is not None}
    if helpers:
        df = df.select("*", *(h.alias(f"__helper{i}") for i, h in helpers.items()))
    new = [
        c
        for i, f in enumerate(features)
        for c in feature_columns(f, source, F.col(f"__helper{i}") if i in helpers else None)
    ]
    return df.select(*own, *new)
