import pytest
from pyspark.sql import functions as F
from tablewright.operators import features


def test_rows_that_lie_in_one_task_are_dealt_out_to_be_clustered(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    tasks, fit = [], KMeans.fit

    def watch(self, points, *more):
        tasks.append(points.select(F.spark_partition_id()).distinct().count())
        return fit(self, points, *more)

    monkeypatch.setattr(KMeans, "fit", watch)
    monkeypatch.setattr(features, "SPREAD_ROWS", 100)
    df = spark.range(0, 2000, 1, 1).select((F.col("id") % 2 * 1000 + F.col("id") % 5).cast("double").alias("x"))
    found = features.fit_clusters(df, ["x"], 2)
    assert min(tasks) > 1
    assert sorted(c[0] for c in found["centres"]) == pytest.approx([2.0, 1002.0])
