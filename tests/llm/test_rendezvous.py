import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tablewright.llm.queries import op5_rendezvous_sharding
from tablewright.llm.rendezvous import rendezvous_shards, shard_of


def test_query(spark, docs_of, table_dir):
    texts = [None, "", "é", *(f"text {i}" for i in range(500)), *["copy"] * 300]
    rows = op5_rendezvous_sharding(spark, table_dir(docs_of(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) > 50
    assert 40 < sum(r.grown_shard == 8 for r in rows) < 160


def test_weights_and_stability(spark):
    df = spark.range(20000).select(
        shard_of(F.col("id"), [1.0, 3.0]).alias("a"), shard_of(F.col("id"), [1.0, 3.0, 4.0]).alias("b")
    )
    rows = df.collect()
    share = Counter(r.a for r in rows)
    assert abs(share[1] / 20000 - 0.75) < 0.02
    assert all(r.b in (r.a, 2) for r in rows) and abs(sum(r.b == 2 for r in rows) / 20000 - 0.5) < 0.02
    with pytest.raises(ValueError):
        shard_of(F.col("id"), [1.0, 0.0])


def test_null_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([(None,), (None,), (7,), (7,)], "doc_id long")
    rows = rendezvous_shards(df, "doc_id", [1.0] * 4).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in rows}) == 4
    assert rendezvous_shards(df.limit(0), "doc_id", [1.0]).count() == 0
