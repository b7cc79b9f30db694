import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablewright.llm import token_store, tokens
from tablewright.llm.queries import op3_content_store
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    passage = " ".join(rnd.choice("alpha beta gamma delta stone river").title() + str(rnd.random()) for _ in range(400))
    long = " ".join(f"{rnd.choice('abc')}{rnd.random()}" for _ in range(4000))
    return [None, "", "one", passage, f"Before. {passage} After it.", passage, long, *["copy of it"] * 40]


def plain(texts):
    model, start, out = Tokenizer.from_file(tokens.default_path()), 0, {}
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    return out


def test_query_against_plain_encoding(spark, docs_of, table_dir, texts):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op3_content_store(spark, table_dir(docs_of(texts))).collect()}
    assert got == {k: v[:3] for k, v in plain(texts).items()}


def test_round_trip_and_tampering(spark, docs_of, texts, tmp_path):
    path = str(tmp_path / "store")
    total = token_store.write_store(docs_of(texts).repartition(3), path)
    want = plain(texts)
    assert total == sum(v[1] for v in want.values())
    for r in token_store.read_documents(spark, path).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == want[r.doc_id][3]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    stored = chunks.agg(F.sum("n_ids")).first()[0]
    assert stored < total - 2 * 1000  # the passage is kept once, but for its ragged ends
    assert chunks.agg(F.max("n_ids")).first()[0] <= token_store.MOST

    bad = str(tmp_path / "bad")
    flipped = chunks.withColumn("payload", F.expr("concat(substring(payload, 2), substring(payload, 1, 1))"))
    flipped.write.parquet(f"{bad}/chunks")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    with pytest.raises(Exception, match="does not match its address"):
        token_store.digests(spark, bad).collect()
    worse = str(tmp_path / "worse")
    spark.read.parquet(f"{path}/recipes").where("doc_id > 0").write.parquet(f"{worse}/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{worse}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        token_store.verified_recipes(spark, worse)


def test_cuts_follow_content():
    table = token_store.gear(49408)
    cut = lambda ids: token_store.cuts(len(ids), token_store.marks(ids, table).tolist())
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49408, 40000).astype("<u4")
    a, b = cut(ids), cut(np.concatenate([ids[:777] * 0 + 5, ids]))
    assert a[-1] == 40000 and all(x < y for x, y in zip(a, a[1:]))
    shared = {x + 777 for x in a} & set(b)
    assert len(shared) > 0.8 * len(a)
    assert cut(ids[:0]) == [] and cut(ids[:1]) == [1]
    same = cut(np.zeros(10000, "<u4"))
    assert same[-1] == 10000 and max(np.diff([0, *same])) <= token_store.MOST
    # neighbours in a batch do not matter: marks of a document count from LEAST ids on, beyond the window
    alone, behind = token_store.marks(ids, table), token_store.marks(np.concatenate([ids[:50], ids]), table) - 50
    assert set(alone[alone >= token_store.LEAST]) == set(behind[behind >= token_store.LEAST])


def test_empty_table_and_null_ids(spark, docs_of, table_dir, tmp_path):
    empty = docs_of([]).limit(0)
    assert op3_content_store(spark, table_dir(empty)).count() == 0
    df = spark.createDataFrame([(None, "a", 1), (5, "a", 2), (5, "a", 2)], "doc_id long, text string, start int")
    path = str(tmp_path / "s")
    token_store.write_store(df, path)
    rows = token_store.digests(spark, path).collect()
    assert sorted(r.start for r in rows) == [0, 2, 4] and sorted(str(r.doc_id) for r in rows) == ["5", "5", "None"]


def test_missing_chunks_and_changed_numbers(spark, docs_of, texts, tmp_path):
    """op3_content_store: what is not whole raises an error in both ways of reading."""
    path = str(tmp_path / "store")
    token_store.write_store(docs_of(texts), path)
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in ("chunks", "recipes", "manifest")}
    first = tables["chunks"].agg(F.min("chunk_id")).first()[0]
    other = lambda column: tables["recipes"].withColumn(column, F.col(column) + 1)
    cases = {
        "missing": {"chunks": tables["chunks"].where(F.col("chunk_id") != F.lit(first))},
        "twice": {"chunks": tables["chunks"].union(tables["chunks"].where(F.col("chunk_id") == F.lit(first)))},
        "longer": {"chunks": tables["chunks"].withColumn("n_ids", F.col("n_ids") + 1)},
        "sizes": {"recipes": tables["recipes"].withColumn("sizes", F.transform("sizes", lambda n: n + 1))},
        "start": {"recipes": other("start")}, "n_tokens": {"recipes": other("n_tokens")},
    }
    for name, changed in cases.items():
        for t, df in (tables | changed).items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}/{t}")
        for read in (token_store.digests, token_store.read_documents):
            with pytest.raises(Exception, match="missing|add up|as long|does not match|do not match"):
                read(spark, f"{tmp_path}/{name}").collect()


def test_payloads_are_not_moved_to_be_found(spark, docs_of, texts, tmp_path, monkeypatch):
    """op3_content_store: the files of chunks lie as the join wants them, also for names with quotes and where some
    chunks are in very many documents."""
    path = str(tmp_path / "sto're")
    monkeypatch.setattr("tablewright.functions.skew.LIGHT", 2)
    monkeypatch.setattr("tablewright.functions.skew.SHARE", 20)
    token_store.write_store(docs_of(texts), path)
    chunks = token_store._chunks(spark, path)
    ids = spark.read.parquet(f"{path}/recipes").select(F.explode("chunk_ids").alias("chunk_id"))
    plan = ids.join(chunks.hint("merge"), "chunk_id", "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk_id") == 1 and "Bucketed: true" in plan
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.digests(spark, path).collect()} == {
        k: v[:3] for k, v in plain(texts).items()
    }
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]
