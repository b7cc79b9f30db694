"""How often a table is read, and that what is counted by value or in one shuffle stays the same."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tablewright import api
from tablewright.operators import profiling
from tablewright.operators import stats as st
from tablewright.plans import catalog

ROWS = 60


@pytest.fixture
def watched(spark):
    """A table, and how many of its rows were made so far."""
    seen = spark.sparkContext.accumulator(0)

    def see(i):
        seen.add(1)
        return i

    made = F.udf(see, T.LongType()).asNondeterministic()
    df = spark.range(ROWS).select(made("id").alias("i"))
    df = df.select((F.col("i") * 1.5).alias("y"), (F.col("i") % 3).cast("string").alias("s"), F.concat(F.lit("g"), F.col("i") % 4).alias("g"))
    return df, seen


def test_a_table_is_read_once_to_be_profiled(watched):
    df, seen = watched
    result = api.profile(df, "y", "regression")
    assert len(result.report.profiles) == 2 and seen.value <= ROWS
    assert not df.storageLevel.useMemory


def test_information_counts_a_table_once(watched):
    df, seen = watched
    stats = {c: st.ColumnStats(c, df.schema[c].dataType, ROWS, ROWS, 4) for c in df.columns}
    found = st.mutual_information(df, ["s"], "g", stats)
    assert found["s"] == pytest.approx(0.0, abs=1e-9) and seen.value == ROWS


def test_what_its_owner_persisted_stays(spark):
    df = spark.range(3).persist()
    with st.held(df):
        pass
    assert df.storageLevel.useMemory
    df.unpersist()


def test_repeated_values_are_read_once_with_the_same_answer(spark):
    values = [("1 kg", "a", "7"), ("2.5 KG", "b", " 8 "), ("n/a", "c", ""), ("1 kg", "3", "7"), (None, None, None)] * 3
    df = spark.createDataFrame(values, "u string, t string, w string")
    alone = profiling.find_coercions(df, ["u", "t", "w"])
    assert alone == profiling.find_coercions(df, ["u", "t", "w"], ["u", "w"]) == profiling.find_coercions(df, ["u", "t", "w"], ["u", "t", "w"])
    assert alone == {"u": profiling.Coercion("kg", False), "w": profiling.Coercion(None, True)}


def test_rare_values_are_folded_after_counting(spark):
    df = spark.createDataFrame([("A",)] * 120 + [(" a",)] * 80 + [("Rare ",), ("RARE",)], "c string")
    assert st.rare_values(df, ["c"], 0.02, ["c"]) == {"c": ["rare"]}
    assert st.rare_values(df, ["c"], 0.005, ["c"]) == {"c": []}


def test_quantiles_beyond_a_number_of_rows_are_the_same(spark, monkeypatch):
    df = spark.range(500).select(F.when(F.col("id") % 9 != 0, F.col("id") * F.col("id") % 97).cast("double").alias("x"))
    points = [i / 10 for i in range(1, 10)]
    want = df.agg(st.quantiles(F.col("x"), points, 500)).first()[0]
    monkeypatch.setattr(st, "EXACT_ROWS", 10)
    assert st.settled(df, [(F.col("x"), points)], [None], 500)[0] == pytest.approx(want)


def test_differing_rows_are_counted_on_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "y")], "k int, v string")
    b = spark.createDataFrame([("x", 1), (None, 2), (None, 2), ("y", None)], "v string, k int")
    assert catalog._differing(a, b) == 2 and catalog._differing(a, a) == 0
