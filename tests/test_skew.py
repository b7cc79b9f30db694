import random

from tablewright.functions.skew import heavy_keys, skewed_join


def test_skewed_join_is_a_join(spark):
    r = random.Random(1)
    left = [(None if r.random() < 0.1 else 7 if r.random() < 0.5 else r.randrange(50), i) for i in range(3000)]
    right = [(k, k * 10) for k in range(0, 60, 2)] + [(7, 70), (7, 71), (None, 5)]
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, y int")
    for how in ("inner", "left"):
        want = sorted(map(str, a.join(b, ["k"], how).collect()))
        assert sorted(map(str, skewed_join(a, b, ["k"], how).collect())) == want
        small = a.limit(50)
        assert skewed_join(small, b, ["k"], how).count() == small.join(b, ["k"], how).count()
    heavy = heavy_keys(a.groupBy("k").count(), ["k"], "count", 8).collect()
    assert {r["k"] for r in heavy} == {None, 7} and all(2 <= r["__parts"] <= 8 for r in heavy)
    plan = skewed_join(a, b, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan
