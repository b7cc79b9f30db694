import json
import random

import pytest
import tablewright as tw
from pyspark.sql import functions as F
from tablewright import FeatureConfig, PrepModel
from tablewright import SemanticType as S


@pytest.fixture(scope="module")
def churn(spark):
    rnd = random.Random(11)
    rows = [
        (
            f"id{i:05d}", rnd.gauss(40, 9) if i % 10 else None, rnd.expovariate(0.1), rnd.choice(["red", "Green ", "blue"]), f"city{rnd.randrange(35)}",
            i % 3 == 0, f"{rnd.choice('abc')} is what the customer had to say about it in words", "yes" if rnd.random() < 0.4 else "no",
        )
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "`customer id` string, age double, spend double, colour string, city string, member boolean, note string, churn string")
    day = "timestamp'2024-01-01 05:00:00' + make_interval(0, 0, 0, cast(spend as int))"
    return df.withColumn("since", F.expr(day)).withColumn("until", F.expr(f"{day} + interval 36 hours")).cache()


ALL = FeatureConfig(
    interactions=True, interaction_top_k=2, interaction_types=["ratio", "product", "difference"], datetime_cyclical=True, datetime_deltas=True,
    datetime_reference_col="since", clustering=True, cluster_k=2, text_features=True, text_tfidf=True, text_tfidf_top_k=3,
)


@pytest.mark.parametrize("hint", ["tree", "linear"])
def test_prepare_and_replay(spark, churn, hint):
    result = tw.prepare(churn, "churn", model_hint=hint)
    assert result.df.count() == 400 and result.df.columns == [*result.pipeline.get_feature_names_out(), "churn"]
    new = churn.limit(5).unionByName(
        churn.limit(1).withColumns({"colour": F.lit("purple"), "city": F.lit("nowhere"), "age": F.lit(None).cast("double")})
    )
    out = PrepModel.from_json(result.pipeline.to_json()).transform(new)
    assert out.columns == result.df.columns and out.count() == 6
    odd = out.where("age_missing").orderBy("city").collect()[-1] if hint == "tree" else None
    if odd is not None:
        assert out.where("colour = -1").count() == 1
    assert "churn" not in result.pipeline.transform(new.drop("churn")).columns
    assert result.df.where("city IS NULL").count() == 0 and dict(result.df.dtypes)["city"] == "double"


def test_cross_fit_by_default_and_full_on_request(churn):
    own = tw.prepare(churn, "churn")
    full = tw.prepare(churn, "churn", train_encoding="full")
    n = lambda r: r.df.select("city").distinct().count()
    assert n(full) <= 35 < n(own)
    assert full.df.exceptAll(own.pipeline.transform(churn)).count() == 0
    with pytest.raises(ValueError):
        tw.prepare(churn, "churn", train_encoding="none")


def test_added_features(churn):
    base = tw.prepare(churn, "churn")
    before = base.df.columns
    rich = tw.add_features(base, ALL)
    assert base.df.columns == before and rich.df.count() == 400
    new = set(rich.df.columns) - set(before)
    assert {"since_month_sin", "since_to_until_days", "until_days_since_ref", "cluster_label", "note_word_count", "note_has_text"} <= new
    assert any("_div_" in c for c in new) and sum("_tfidf_" in c for c in new) == 3
    assert {r[0] for r in rich.df.select("since_to_until_days").distinct().collect()} == {1.5}
    out = rich.pipeline.transform(churn.limit(7))
    assert out.columns == rich.df.columns and out.where("since_month_sin IS NULL").count() == 0
    twice = tw.add_features(rich, FeatureConfig(datetime_cyclical=True))
    assert twice.df.columns == rich.df.columns
    assert any(e.action == "skipped_duplicate_feature" for e in twice.report.entries)
    none = tw.add_features(base, FeatureConfig())
    assert none.report.entries[-1].action == "add_features_skipped" and none.df is base.df
    same = rich.df.select(*before).exceptAll(base.df.select(*before)).count()
    assert same == 0  # what was encoded out of fold stays as it was


def test_only_prepared_results_take_features(churn):
    with pytest.raises(ValueError, match="prepare"):
        tw.add_features(tw.profile(churn, "churn"), ALL)
    with pytest.raises(TypeError):
        tw.add_features(tw.profile(churn, "churn"), {})


def test_presets_and_dry_run(churn):
    r = tw.prepare(churn, "churn", preset="fast", cardinality_threshold=10)
    assert r.report.entries[0].action == "apply_preset" and "'cardinality_threshold': 10" in r.report.entries[0].rationale
    dry = tw.prepare(churn, "churn", dry_run=True, feature_config=FeatureConfig(text_features=True))
    assert dry.df is churn and dry.pipeline is None and dry.report.entries[0].action == "dry_run"
    assert any(e.action == "generate_text_features" for e in dry.report.entries)
    with pytest.raises(ValueError):
        tw.prepare(churn, "churn", preset="slow")
    with pytest.raises(TypeError):
        tw.prepare(churn, "churn", dry_run="yes")
    with pytest.raises(ValueError):
        tw.prepare(churn, "churn", outlier_method="mad")


def test_stages(churn):
    assert tw.profile(churn, "churn").df is churn
    doubled = churn.unionAll(churn.limit(20))
    assert tw.clean(doubled, "churn").df.count() == 400
    out = tw.engineer(doubled, "churn", model_hint="linear", feature_config=FeatureConfig(datetime_deltas=True)).df
    assert out.count() == 400 and {"colour_red", "since_to_until_days"} <= set(out.columns)


def test_compare(churn, capsys, tmp_path):
    a, b = tw.prepare(churn, "churn"), tw.prepare(churn, "churn", model_hint="linear")
    found = tw.compare(a, b)
    assert set(found) == {
        "shape_a", "shape_b", "columns_only_in_a", "columns_only_in_b", "columns_in_both", "report_entry_counts_a", "report_entry_counts_b", "decision_diff",
    }
    assert found["shape_a"][0] == 400 and "colour" in found["columns_only_in_a"] and "colour" in found["decision_diff"]
    assert "colour" in capsys.readouterr().out
    with pytest.raises(ValueError):
        tw.compare(a, None)
    path = str(tmp_path / "c.pdf")
    tw.save_compare_pdf(a, b, path)
    assert open(path, "rb").read(5) == b"%PDF-"
    with pytest.raises(TypeError):
        tw.save_compare_pdf(a, "b", path)


def test_report(churn, capsys, tmp_path, spark):
    report = tw.prepare(churn, "churn").report
    counts = report.summary_counts()
    assert set(counts) == {"info", "warning", "critical"} and sum(counts.values()) == len(report.entries)
    table = report.to_dataframe()
    assert table.columns == ["stage", "column", "action", "rationale", "severity", "before_stats", "after_stats"]
    assert table.count() == len(report.entries) and tw.Report([]).to_dataframe(spark).columns == table.columns
    json.dumps(report.to_dict())
    report.show()
    assert "PROFILER" in capsys.readouterr().out
    assert len(report.plot()) >= 3 and report.plot("missingness")[0].svg().startswith("<svg")
    html = report.to_html()
    assert "<svg" in html and "http://" not in html.replace("http://www.w3.org/2000/svg", "")
    report.save_pdf(str(tmp_path / "r.pdf"))
    raw = (tmp_path / "r.pdf").read_bytes()
    assert raw.startswith(b"%PDF-") and raw.rstrip().endswith(b"%%EOF")
    for bad in (lambda: report.filter_by_severity("x"), lambda: report.filter_by_stage("x"), lambda: report.plot("x"), lambda: tw.Report([]).plot()):
        with pytest.raises(ValueError):
            bad()
    entry = tw.ReportEntry("cleaner", "<b>", "x", "a < b", "info")
    assert "&lt;b&gt;" in tw.Report([entry]).to_html() and report.filter_by_column("age")


def test_unfitted_and_missing_columns(churn):
    with pytest.raises(tw.NotFittedError):
        PrepModel().transform(churn)
    with pytest.raises(ValueError, match="missing"):
        tw.prepare(churn, "churn").pipeline.transform(churn.drop("age"))


def test_odd_tables(spark):
    """Only ValueError and TypeError may come of odd tables."""
    frames = [
        spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0), (None, 3.0), (1.0, 4.0)] * 10, "x double, y double"),
        spark.createDataFrame([("😀", "a b", 1.0), ("é", "c`d", 2.0)] * 20, "`emoji col` string, `a.b` string, y double"),
        spark.createDataFrame([(None, 1.0)] * 20, "n string, y double"),
        spark.createDataFrame([(1.0, 1.0)], "x double, y double"),
        spark.createDataFrame([([1, 2], float(i % 9), float(i)) for i in range(30)], "arr array<int>, x double, y double"),
        spark.createDataFrame([(i % 2 == 0, float(i)) for i in range(30)], "b boolean, y double"),
        spark.createDataFrame([(1e8 * i, float(i)) for i in range(40)], "big double, y double").select("big", F.col("big").cast("decimal(20,2)").alias("d"), "y"),
    ]
    for df in frames:
        for hint in ("tree", "linear"):
            try:
                out = tw.prepare(df, "y", "regression", hint)
                assert out.df.count() == df.count()
            except (ValueError, TypeError):
                pass


def test_override_and_small_cardinality(spark):
    df = spark.range(100).selectExpr("cast(id % 5 as int) AS zip_code", "id * 1.5 AS income", "id AS y")
    r = tw.prepare(df, "y", "regression", column_types={"zip_code": S.NUMERIC_FEATURE})
    assert {p.name: p.semantic_type for p in r.report.profiles}["zip_code"] is S.NUMERIC_FEATURE
