import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from tablewright.llm import bestfit_pack, decontaminate, quality_rules, secrets, tokens

from .test_bestfit_pack import best_fit_decreasing
from .test_decontaminate import brute as leaks
from .test_ngram_join import brute as groups
from .test_quality_rules import brute as measures


def prose(rnd, n):
    stop = "the of and to in is that it was for".split()
    return " ".join(rnd.choice(stop) if rnd.random() < 0.3 else "".join(rnd.choices("abcdefghiklmnorst", k=6)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(12)
    items = [(i, prose(rnd, 20)) for i in range(5)]
    texts = [None, "", "too short", "### ".join(prose(rnd, 80).split()), "same line of text here\n" * 30]
    for _ in range(15):
        text = prose(rnd, rnd.randint(80, 300))
        texts += [text] * rnd.choice([1, 1, 3])
        texts.append(f"{text} and two more")
    texts += [f"{prose(rnd, 60)} {q} {prose(rnd, 60)}" for _, q in items]
    texts += [f"{prose(rnd, 70)} token = {'0123456789abcdef' * 2} {prose(rnd, 70)}" for _ in range(3)] + [prose(rnd, 6000)]
    rnd.shuffle(texts)
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def verdict(text):
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    stop = {*quality_rules.STOP_WORDS, *(w.title() for w in quality_rules.STOP_WORDS)}
    m = measures(text) | {"n_lines": len(lines), "n_stop_words": sum(w in stop for w in words)}
    if m["base_failed"]:
        return False
    share = lambda r: 100 * m[r.top] / m[r.bottom]
    return all((r.low is None or share(r) >= r.low) and (r.high is None or share(r) <= r.high) for r in quality_rules.RULES)


def test_run_against_brute_force(spark, tables):
    path, texts, items = tables
    kept = [i for i, t in enumerate(texts) if verdict(t)]
    of = groups([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if of[k][1] == k]
    used = [(n, decontaminate.normal(q)) for n, q in items]
    kept = [i for i in kept if not leaks(texts[i], used)]
    left = {i: secrets.mask(texts[i], secrets.find(texts[i])) for i in kept}
    assert 10 < len(left) < len(texts) and sum(secrets.MASK in t for t in left.values()) == 3

    rows = corpus_pipeline.run(spark, path).collect()
    model = tokens.Encoder(tokens.default_path()).model
    ids = {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in left.items()}
    want = {
        (i, k, s, len(p := x[s : s + 4096]), zlib.crc32(np.array(p, "<u4").tobytes()))
        for i, x in ids.items()
        for k, s in enumerate(range(0, len(x), 4096))
    }
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    lengths = [r.length for r in rows]
    assert len({r.sequence_id for r in rows}) == best_fit_decreasing(lengths, 4096)
    assert bestfit_pack.plan({}, 4096) == ({}, 0)


def test_stages_keep_the_columns(spark, tables):
    path = tables[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema == docs.schema
