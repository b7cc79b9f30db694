import pytest
import tablewright as tw
from tablewright.types import PRESETS
from tablewright.validation import check_inputs


def test_semantic_types_and_presets():
    assert len(tw.SemanticType) == 9 and set(PRESETS) == {"fast", "thorough"}
    assert PRESETS["fast"]["drop_threshold"] == 0.8 and PRESETS["thorough"]["feature_config"].clustering


def test_not_computed_is_none():
    p = tw.ColumnProfile("a", tw.SemanticType.BOOLEAN, 0.0, "boolean")
    assert p.vif_score is None and p.correlation_with_target is None and p.is_leakage_suspect is False


@pytest.mark.parametrize("bad", [{"stage": "x"}, {"severity": "fatal"}])
def test_entries_are_checked(bad):
    given = {"stage": "cleaner", "column": "a", "action": "b", "rationale": "c", "severity": "info"} | bad
    with pytest.raises(ValueError):
        tw.ReportEntry(**given)


@pytest.mark.parametrize(
    "bad",
    [
        {"interaction_top_k": 0}, {"interaction_types": ["sum"]}, {"cluster_k": 0}, {"cluster_k": "many"}, {"cluster_k": True},
        {"cluster_features": "all"}, {"cluster_features": [1]}, {"text_tfidf_top_k": 0},
    ],
)
def test_feature_config_is_checked(bad):
    with pytest.raises(ValueError):
        tw.FeatureConfig(**bad)
    assert not tw.FeatureConfig().active and tw.FeatureConfig(text_tfidf=True).active


def test_checks_in_order(spark):
    df = spark.range(40).selectExpr("id * 1.5 AS x", "id AS y", "CAST(id % 2 AS STRING) AS z")
    with pytest.raises(TypeError):
        check_inputs([1], "y", "classification")
    with pytest.raises(ValueError, match="empty"):
        check_inputs(df.limit(0), "y", "regression")
    with pytest.raises(ValueError, match="does not exist"):
        check_inputs(df, "q", "regression")
    with pytest.raises(ValueError, match="only one column"):
        check_inputs(df.select("y"), "y", "regression")
    with pytest.raises(ValueError, match="duplicate"):
        check_inputs(df.select("x", "x", "y"), "y", "regression")
    with pytest.raises(ValueError, match="case"):
        check_inputs(df.selectExpr("x", "y AS Y", "y"), "y", "regression")
    with pytest.raises(ValueError, match="task"):
        check_inputs(df, "y", "ranking")
    with pytest.raises(ValueError, match="model_hint"):
        check_inputs(df, "y", "regression", "forest")
    with pytest.raises(ValueError, match="continuous"):
        check_inputs(df, "x", "classification")
    with pytest.raises(ValueError, match="target"):
        check_inputs(df, "y", "regression", None, {"y": tw.SemanticType.BOOLEAN})
    with pytest.raises(ValueError, match="does not exist"):
        check_inputs(df, "y", "regression", None, {"q": tw.SemanticType.BOOLEAN})
    with pytest.raises(ValueError, match="none of"):
        check_inputs(df, "y", "regression", None, {"x": "boolean"})
    assert check_inputs(df, "y", "regression") is None
    assert "non-numeric" in check_inputs(df, "z", "regression")
    assert "unique" in check_inputs(df.withColumn("y", df["y"] % 3), "y", "regression")
    assert check_inputs(df, "z", "classification") is None


def test_a_target_of_many_numbers_may_still_be_classes(spark):
    df = spark.range(1000).selectExpr("id % 25 AS y", "id AS x")
    assert check_inputs(df, "y", "classification") is None  # 25 values are 2.5 % of the rows


def test_pandas_tables(spark):
    import pandas as pd
    import tablewright as tw

    n = 60
    df = pd.DataFrame({
        "x": [None if i % 9 == 0 else float(i) for i in range(n)], "kind": pd.Categorical(["a", "b", "c"] * (n // 3)),
        "flag": [i % 2 == 0 for i in range(n)], "mixed": ["one", 2, 3.5] * (n // 3), "none": [None] * n,
        "when": pd.date_range("2020-01-01", periods=n), "y": [i % 2 for i in range(n)],
    })
    result = tw.prepare(df, "y")
    assert result.df.count() == n and "none" not in result.df.columns and result.pipeline.transform(result.report.df).count() == n
    assert result.report.to_dict()["total_entries"] == len(result.report.entries)
    for bad in (df.iloc[:0], pd.concat([df, df[["x"]]], axis=1)):
        with pytest.raises(ValueError):
            tw.prepare(bad, "y")
    with pytest.raises(TypeError):
        tw.prepare([1, 2], "y")
