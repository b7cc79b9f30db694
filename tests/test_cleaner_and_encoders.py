import random

import pytest
from pyspark.sql import functions as F
from tablewright import ColumnProfile, run_cleaner, run_engineer, run_profiler
from tablewright import SemanticType as S
from tablewright.functions import columns as fc
from tablewright.operators import cleaning, encoding, features


def profile(name, kind, missing=0.0, rare=None):
    return ColumnProfile(name, kind, missing, "", rare_categories=rare)


def actions(entries):
    return {(e.column, e.action) for e in entries}


def test_clean_policy(spark):
    rows = [(i, "  Red " if i % 2 else "blue", f"C{i % 50}", None if i % 4 == 0 else 1.0 * i, None if i % 2 else 5.0 * i, 10**6 if i == 7 else i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "uid long, colour string, city string, some double, half double, wild long, y long")
    df = df.withColumn("colour", F.when(F.col("uid") % 5 != 0, F.col("colour"))).unionAll(df.limit(0))
    ps = [
        profile("uid", S.NUMERIC_ID), profile("colour", S.CATEGORICAL_LOW, 0.2), profile("city", S.CATEGORICAL_HIGH, 0.0, ["c1"]),
        profile("some", S.NUMERIC_FEATURE, 0.25), profile("half", S.NUMERIC_FEATURE, 0.5), profile("wild", S.NUMERIC_FEATURE),
    ]
    out, kept, entries, steps = run_cleaner(df, ps)
    rows = out.collect()
    assert [p.name for p in kept] == ["colour", "city", "some", "half", "wild"] and "uid" not in out.columns and "y" in out.columns
    assert {r.colour for r in rows} == {"red", "blue"} and out.where("colour_missing").count() == 40
    assert "c1" not in {r.city for r in rows} and fc.RARE in {r.city for r in rows}
    assert out.where("some IS NULL").count() == 0 and out.where("half IS NULL").count() == 100
    assert out.agg(F.max("wild")).first()[0] < 1000
    assert {
        ("uid", "drop_column"), ("colour", "normalize_categories"), ("colour", "add_missing_indicator"), ("colour", "mode_impute"),
        ("city", "group_rare_categories"), ("some", "median_impute"), ("half", "skip_winsorize"), ("wild", "winsorize_outliers"),
    } <= actions(entries)
    assert cleaning.cleaned(df.limit(3), steps).count() == 3


def test_duplicates_flat_columns_and_methods(spark):
    df = spark.createDataFrame([(5.0, "a")] * 9 + [(6.0, None)], "x double, c string")
    out, _, entries, _ = run_cleaner(df, [profile("x", S.NUMERIC_FEATURE), profile("c", S.CATEGORICAL_LOW, 0.5)])
    assert out.count() == 2 and ("*", "remove_duplicates") in actions(entries) and ("c", "constant_fill") in actions(entries)
    flat = spark.createDataFrame([(5.0, i) for i in range(9)] + [(60.0, 9)], "x double, k long")
    out, _, entries, _ = run_cleaner(flat, [profile("x", S.NUMERIC_FEATURE)])
    assert ("x", "skip_winsorize") in actions(entries) and out.agg(F.max("x")).first()[0] == 60
    with pytest.raises(ValueError):
        run_cleaner(df, [], outlier_method="mad")
    with pytest.raises(ValueError):
        cleaning.fences("mad", 1, 2, 1, 1)


def test_maps_are_carried_through_deduplication(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 1}), (2, None)], "x long, m map<string,int>")
    assert cleaning.drop_duplicates(df).count() == 2


def test_rare_values_mean_the_same_whatever_their_number(spark, monkeypatch):
    """Beyond MOST_RARE they are a table; an unseen value passes through either way."""
    rows = [(f"rare{i}",) for i in range(90)] + [("Often",)] * 30
    df = spark.createDataFrame([(v, i) for i, (v,) in enumerate(rows)], "c string, k long")
    new = spark.createDataFrame([("RARE7 ",), ("brand new",), ("often",), (None,)], "c string")
    seen = []
    for most in (90, 89):
        monkeypatch.setattr(cleaning, "MOST_RARE", most)
        out, _, _, steps = run_cleaner(df, [profile("c", S.CATEGORICAL_HIGH, 0, [f"rare{i}" for i in range(90)])])
        assert ("rare" in steps["c"]) == (most == 90) and {r.c for r in out.collect()} == {"often", fc.RARE}
        assert out.columns == df.columns
        seen.append(sorted(str(r.c) for r in cleaning.cleaned(new, {"c": steps["c"]}).collect()))
    assert seen[0] == seen[1] == sorted([fc.RARE, "brand new", "often", "None"])


DATES = {
    "2020-03-05T10:00:00+02:00": "2020-03-05 08:00:00", "3/5/20": "2020-03-05 00:00:00", "5.3.2020": "2020-05-03 00:00:00",
    "05-03-20": "2020-05-03 00:00:00", "Mar 5 2020 3pm": "2020-03-05 15:00:00", "20200305T1000": "2020-03-05 10:00:00",
    "Thu, 05 Mar 2020 10:00:00 GMT": "2020-03-05 10:00:00", "2020-03-05 10:00:00.250": "2020-03-05 10:00:00",
    "25.12.2020": "2020-12-25 00:00:00", "2020-3-5": "2020-03-05 00:00:00", "5 March 2020": "2020-03-05 00:00:00",
    "2020-03-05T10:00:00Z": "2020-03-05 10:00:00", "March 2020": "2020-03-01 00:00:00", "12/31/1999 23:59": "1999-12-31 23:59:00",
}


def test_what_is_taken_for_a_date_is_read_as_one(spark):
    from tablewright.operators.profiling import sniff_dates

    none = ["no date", "20200305", "-7", "", "99/99/9999", None]
    df = spark.createDataFrame([(t,) for t in [*DATES, *none]], "d string")
    found = {r.d: r.t for r in df.select("d", F.date_format(fc.parsed_date(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert {t: found[t] for t in DATES} == DATES and all(found[t] is None for t in none)
    read = fc.date_reader()
    assert all((read(t) is None) == (found[t] is None) for t in [*DATES, *none])
    assert sniff_dates(spark.createDataFrame([(t,) for t in DATES], "d string"), ["d"]) == {"d"}
    lost = spark.createDataFrame([(t, i) for i, t in enumerate([*DATES, "no date"])], "d string, k long")
    _, _, entries, steps = run_cleaner(lost, [profile("d", S.DATETIME_STRING)])
    assert steps["d"]["dates"] and [e.after_stats for e in entries if e.action == "coerce_datetime"] == [{"unread": 1}]



def test_null_safe_clip_and_strings(spark):
    df = spark.createDataFrame([(None, "\t A b \n"), (9.0, None), (-9.0, "")], "x double, s string")
    rows = df.select(fc.clipped(F.col("x"), -1, 1).alias("x"), fc.normalised(F.col("s")).alias("s"), fc.words(F.col("s")).alias("w")).collect()
    assert [tuple(r) for r in rows] == [(None, "a b", 2), (1.0, None, None), (-1.0, "", 0)]


def test_encoders_by_hint(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), f"k{rnd.randrange(40)}", rnd.expovariate(1) ** 3, i % 3 == 0, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "low string, high string, x double, flag boolean, y double")
    ps = [profile("low", S.CATEGORICAL_LOW), profile("high", S.CATEGORICAL_HIGH), profile("x", S.NUMERIC_FEATURE), profile("flag", S.BOOLEAN)]
    tree, entries = run_engineer(df, ps, "y", "tree")
    assert tree.columns == ["low", "high", "x", "flag", "y"] and dict(tree.dtypes)["high"] == "double"
    assert {("low", "ordinal_encode"), ("high", "target_encode_cross_fit")} == actions(entries)
    linear, entries = run_engineer(df, ps, "y", "linear")
    assert {"low_a", "low_b", "low_c"} <= set(linear.columns) and {("x", "log1p_transform"), ("x", "standard_scale")} <= actions(entries)
    mean, std = linear.agg(F.avg("x"), F.stddev_samp("x")).first()
    assert abs(mean) < 1e-9 and std == pytest.approx(1)
    assert tree.count() == linear.count() == 300


def test_cross_fit_leaves_the_own_fold_out(spark):
    rows = [("a", 1.0, 0), ("a", 3.0, 0), ("a", 8.0, 1), ("b", 5.0, 0), (None, 7.0, 1)]
    df = spark.createDataFrame(rows, "c string, y double, f int")
    out = {(r.y): r.c for r in encoding.cross_fit(df, ["c"], F.col("y"), F.col("f")).collect()}
    g = 24 / 5
    assert out[1.0] == pytest.approx((8 + 10 * g) / 11) and out[8.0] == pytest.approx((4 + 10 * g) / 12)
    assert out[5.0] == pytest.approx(g) and out[7.0] == pytest.approx(g)


def test_string_targets_and_constant_numbers(spark):
    df = spark.createDataFrame([(f"k{i % 30}", 4.0, "yes" if i % 2 else "no") for i in range(120)], "c string, x double, y string")
    out, _ = run_engineer(df, [profile("c", S.CATEGORICAL_HIGH), profile("x", S.NUMERIC_FEATURE)], "y", "linear")
    rows = out.collect()
    assert all(0 <= r.c <= 1 for r in rows) and {r.x for r in rows} == {4.0} and {r.y for r in rows} == {"yes", "no"}
    with pytest.raises(ValueError):
        run_engineer(df.drop("y"), [profile("c", S.CATEGORICAL_HIGH)], "y")


def test_features(spark):
    df = spark.createDataFrame([(4.0, 0.0, "The cat, the CAT_1"), (6.0, 3.0, None)], "a double, b double, t string")
    made = features.interactions(["a", "b"], ["ratio", "product", "difference"]) + [features.text_feature("t"), features.fit_tfidf(df, "t", 3)]
    first, second = features.with_features(df, made).orderBy("a").collect()
    assert (first.a_div_b, second.a_div_b, second.a_times_b, second.a_minus_b) == (None, 2.0, 18.0, 3.0)
    assert (first.t_char_length, first.t_word_count, first.t_has_text, second.t_has_text) == (18, 4, 1, 0)
    assert first.t_tfidf_the == pytest.approx(2 * first.t_tfidf_cat) and second.t_tfidf_the == 0
    assert first.t_tfidf_the**2 + first.t_tfidf_cat**2 + first.t_tfidf_cat_1**2 == pytest.approx(1)
    assert features.fit_tfidf(df.select(F.lit("").alias("t")), "t", 3) is None


def test_clusters(spark):
    rows = [(float(10 * (i % 3)) + 0.01 * i, None if i == 0 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, z double")
    auto = features.fit_clusters(df, ["x", "z"], "auto")
    assert len(auto["centres"]) == 3
    out = features.with_features(df, [auto]).where("z IS NOT NULL")
    assert out.agg(F.max("cluster_dist_to_centroid")).first()[0] < 1.5
    assert features.fit_clusters(df, [], "auto") is None and features.fit_clusters(df.limit(1), ["x"], 3) is None
    assert len(features.fit_clusters(df, ["x"], 1)["centres"]) == 1


def test_dates_in_many_forms(spark):
    texts = ["2024-03-05", "Mar 5, 2024", "March 5, 2024", "03/05/2024", " 2024-03-05 06:07:08 ", "5 Mar 2024", "none", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    found = [r[0] for r in df.select(F.date_format(fc.parsed_date(F.col("d")), "yyyy-MM-dd")).collect()]
    assert found == ["2024-03-05"] * 6 + [None, None]


def test_profile_then_clean_a_coerced_column(spark):
    df = spark.createDataFrame([(f"{i * 37 % 91}.5 kg" if i % 9 else "N/A", i) for i in range(100)], "w string, y long")
    ps, _ = run_profiler(df, "y", "regression")
    out, _, entries, _ = run_cleaner(df, ps)
    assert dict(out.dtypes)["w"] == "double" and out.where("w IS NULL").count() == 0 and ("w", "coerce_numeric") in actions(entries)
