import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablewright import SemanticType as S
from tablewright import run_profiler
from tablewright.operators import profiling, stats


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        rows.append((
            1000 + i, rnd.gauss(40, 10) if i % 5 else None, rnd.choice("abc"), f"v{rnd.randrange(60)}", i % 2 == 0, "same",
            f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", f"a long remark of many words on the row with the number {i} here",
            f"{rnd.randrange(100, 999)} CC", f"{rnd.randrange(10**9, 10**10)}", 10000 + i % 40, float("nan") if i % 3 else 1.5 * i, None, i * 1.0 + rnd.random() * 1e-3, i,
        ))
    names = (
        "customer_id long, age double, kind string, city string, member boolean, country string, day string, remark string, "
        "engine string, phone string, zip_code int, gappy double, empty string, leak double, y long"
    )
    return spark.createDataFrame(rows, names).withColumn("signup", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,cast(y as int))"))


def test_types_and_decisions(mixed):
    profiles, entries = run_profiler(mixed, "y", "regression")
    p = {x.name: x for x in profiles}
    want = {
        "customer_id": S.NUMERIC_ID, "age": S.NUMERIC_FEATURE, "kind": S.CATEGORICAL_LOW, "city": S.CATEGORICAL_HIGH, "member": S.BOOLEAN,
        "country": S.CONSTANT, "day": S.DATETIME_STRING, "remark": S.TEXT, "engine": S.NUMERIC_FEATURE, "phone": S.CATEGORICAL_HIGH,
        "zip_code": S.CATEGORICAL_HIGH, "gappy": S.NUMERIC_FEATURE, "empty": S.CONSTANT, "leak": S.NUMERIC_FEATURE, "signup": S.DATETIME_NATIVE,
    }
    assert {k: v.semantic_type for k, v in p.items()} == want
    assert p["age"].missing_rate == pytest.approx(0.2) and p["gappy"].missing_rate == pytest.approx(2 / 3, abs=0.01)
    assert p["leak"].is_leakage_suspect and not p["age"].is_leakage_suspect
    assert p["remark"].text_avg_word_count == 14 and p["empty"].outlier_rate is None
    assert p["city"].rare_categories is not None and p["kind"].rare_categories == []
    actions = {(e.column, e.action) for e in entries}
    assert {
        ("engine", "coerce_numeric"), ("phone", "skip_coerce"), ("leak", "flagged_leakage_suspect"), ("remark", "flagged_text_column"),
        ("gappy", "flagged_high_missingness"), ("city", "flagged_high_cardinality"),
    } <= actions


def test_override_and_imbalance(spark):
    df = spark.range(300).selectExpr("id % 30 AS z", "CASE WHEN id < 5 THEN 'a' ELSE 'b' END AS y", "id % 7 AS w")
    profiles, entries = run_profiler(df, "y", column_types={"z": S.CATEGORICAL_LOW})
    assert {p.name: p.semantic_type for p in profiles}["z"] is S.CATEGORICAL_LOW
    assert {e.action for e in entries} >= {"manual_semantic_type_override", "flagged_class_imbalance"}


def test_threshold_boundary():
    stat = lambda d: stats.ColumnStats("c", __import__("pyspark.sql.types").sql.types.StringType(), 500, 500, d, 3.0, 1.0)
    assert profiling.infer_type(stat(19), 20) is S.CATEGORICAL_LOW and profiling.infer_type(stat(20), 20) is S.CATEGORICAL_HIGH
    assert profiling.infer_type(stat(2), 20) is S.BOOLEAN and profiling.infer_type(stat(1), 20) is S.CONSTANT
    assert profiling.infer_type(stat(0), 20) is S.CONSTANT


def test_coercion_votes(spark):
    df = spark.createDataFrame(
        [(f"{i} km", f"{i}kg" if i % 2 else f"{i} lb", "12 Nm@ 3400rpm", " 1,234.5 " if i else "n/a", "x1") for i in range(40)],
        "one string, two string, nested string, plain string, code string",
    )
    found = profiling.find_coercions(df, df.columns)
    assert set(found) == {"one", "plain"} and found["one"].unit == "km" and found["plain"].unit is None


def test_monotonic_across_partitions(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("id AS up", "-id AS down", "id % 10 AS saw", "nullif(id, 5) AS gap", "id div 9 AS flat")
    assert stats.monotonic(df, df.columns) == {"up": True, "down": True, "saw": False, "gap": False, "flat": True}


def test_large_tables_use_sketches_and_exact_counts_near_the_limits(spark, monkeypatch):
    monkeypatch.setattr(stats, "EXACT_ROWS", 100)
    monkeypatch.setattr(stats, "SMALL_ROWS", 50)
    df = spark.range(5000).selectExpr("id", "id % 20 AS low", "id % 1500 AS middle", "id div 2 AS pairs")
    s = stats.column_stats(df, df.columns)
    assert s["id"].distinct == 5000 and s["low"].distinct == 20 and abs(s["middle"].distinct - 1500) < 90
    monkeypatch.setattr(stats, "EXACT_ROWS", 10**7)
    monkeypatch.setattr(stats, "FEW", 100)
    s = stats.column_stats(df, df.columns)
    assert [s[c].distinct for c in df.columns] == [5000, 20, 1500, 2500]


def test_large_tables_are_exact(spark, monkeypatch):
    """profile_cardinality, profile_outlier_rate and what else asks for quantiles: the size changes no result."""
    df = spark.range(60000, numPartitions=6).selectExpr(
        "id", "id * 7919 % 50021 / 8 AS x", "id % 3 AS few", "if(id % 4 = 0, null, id * id) AS gaps", "cast(null as double) AS none",
        "id * 31 % 9001 AS middle",
    )
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99999, 1.0]
    asked = [(F.col(c), points) for c in df.columns]
    whole = [list(q) if q else None for q in df.agg(*(stats.quantiles(c, p, 1) for c, p in asked)).first()]
    want = stats.column_stats(df, df.columns)
    bins = stats.mutual_information(df, ["x", "gaps"], "middle", want)
    monkeypatch.setattr(stats, "EXACT_ROWS", 100)
    assert stats.settled(df, asked, [None] * len(asked), 60000) == whole and whole[4] is None
    assert stats.column_stats(df, df.columns) == want and want["middle"].distinct == 9001
    assert stats.mutual_information(df, ["x", "gaps"], "middle", want) == pytest.approx(bins)
    monkeypatch.setattr(stats, "ACCURACY", 50)  # a sketch too coarse for its ranges costs a pass and no result
    assert stats.settled(df, asked, [None] * len(asked), 60000) == whole


def test_correlation_and_vif_of_odd_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, None, float(i * i % 7)) for i in range(30)], "a double, b double, c double, d double, e double")
    assert stats.correlations(df, ["b", "c", "d"], "a") == {"b": pytest.approx(1), "c": None, "d": None}
    assert stats.variance_inflation(df, ["a"]) == {"a": None}
    assert stats.variance_inflation(df, ["a", "d"]) == {"a": None, "d": None}
    v = stats.variance_inflation(df, ["a", "c", "e"])
    r = np.corrcoef([r.a for r in df.collect()], [r.e for r in df.collect()])[0, 1]
    assert v["c"] is None and v["a"] == pytest.approx(1 / (1 - r * r))


def test_mutual_information(spark):
    df = spark.range(400).selectExpr("id % 4 AS a", "id % 4 AS y", "id % 3 AS other", "cast(null as string) AS nothing")
    found = stats.mutual_information(df, ["a", "other", "nothing"], "y", stats.column_stats(df, df.columns))
    assert found["a"] == pytest.approx(math.log(4)) and found["other"] < 0.01 and found["nothing"] is None


def test_outliers(spark):
    df = spark.createDataFrame([(float(x), 5.0, None) for x in [*range(20), 1000]], "a double, flat double, none double")
    assert stats.outlier_rates(df, stats.column_stats(df, df.columns)) == {"a": pytest.approx(1 / 21), "flat": None, "none": 0.0}
