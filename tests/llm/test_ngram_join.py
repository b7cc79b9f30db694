import random
import re
from itertools import combinations

import pytest
from tablewright.llm import ngram_join
from tablewright.llm.graph import connected_components
from tablewright.llm.queries import op2_ngram_jaccard_join


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def union_find(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    links = [
        (i, j)
        for i, j in combinations(range(len(texts)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    return {i: (len(sets[i]), c) for i, c in enumerate(union_find(len(texts), links))}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=3))
    prose = lambda n: [word() for _ in range(n)]
    passage, texts = prose(60), [None, "", " \n", "one two", "One  TWO", "one two three four five", "É a b c d", "é a b c d", "a b c d"]
    for _ in range(12):
        base = prose(rnd.choice([8, 30, 60, 200]))
        for _ in range(rnd.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.choice([0, 1, 2])] = prose(rnd.choice([0, 1, 3]))
            texts.append(" ".join(copy))
    chain = prose(80)  # each alike to the next, the ends are not
    texts += [" ".join(chain[3 * i : 3 * i + 50]) for i in range(10)]
    texts += [" ".join(prose(k) + passage + prose(k)) for k in (1, 2, 3, 4, 5, 10, 20, 40) for _ in range(3)]
    texts += ["copy of a copy of a copy and more"] * 30
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_query_against_brute_force(spark, docs_of, table_dir, seed):
    texts = corpus(seed)
    rows = op2_ngram_jaccard_join(spark, table_dir(docs_of(texts).repartition(3))).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(texts) and got == brute(texts)


def test_small_cases(spark, docs_of):
    empty = ngram_join.similar_components(docs_of([]).limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "first"] and empty.count() == 0
    df = spark.createDataFrame(
        [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "a b c d e f", 1), (9, "A b c d e f", 1), (None, None, 1)],
        "doc_id long, text string, sig int",
    )
    found = ngram_join.similar_components(df).collect()
    rows = sorted((tuple(r)[:3] for r in found), key=str)
    assert sum(r.first for r in found) == 2 and ngram_join.deduplicate(df).columns == df.columns
    assert sorted(map(tuple, ngram_join.deduplicate(df).collect()), key=str) == [(5, "a b c d e f", 1), (None, None, 1)]
    assert rows == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (9, 2, 5), (None, 0, None)], key=str)


def test_deduplicate_keeps_one_of_each_group(spark, docs_of, table_dir):
    texts = corpus(9)
    want = sorted({c if n else i for i, (n, c) in brute(texts).items()})
    docs = spark.read.parquet(table_dir(docs_of(texts).repartition(3)) + "/documents.parquet")
    out = ngram_join.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want


def test_least_overlap():
    for n in range(1, 40):
        for m in range(1, 40):
            least = ngram_join.least_overlap(n, m, 75)
            assert 100 * least >= 75 * (n + m - least) and 100 * (least - 1) < 75 * (n + m - least + 1)


def test_connected_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    edges += [(500, i) for i in range(501, 700)] + [(3, 3)]
    want = union_find(701, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in touched}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_recombined_paragraphs(spark, docs_of, table_dir):
    """Texts from a pool of paragraphs: very many pairs share much, few enough."""
    rnd = random.Random(11)
    pool = [" ".join("".join(rnd.choices("abcdefghijklmnop", k=4)) for _ in range(rnd.choice([15, 30]))) for _ in range(12)]
    texts = [" \n".join(rnd.sample(pool, rnd.choice([2, 3, 4, 5, 6, 9]))) for _ in range(250)]
    rows = op2_ngram_jaccard_join(spark, table_dir(docs_of(texts).repartition(3))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts)


def test_shared_cells():
    import numpy as np

    rnd = np.random.default_rng(2)
    for n in (0, 1, 50, 2000):
        key, row = rnd.integers(0, 60, n).astype(np.uint64), rnd.integers(0, 40, n)
        packed, plain = (ngram_join.shared_cells(key, row, p) for p in (True, False))
        assert all((x == y).all() for x, y in zip(packed, plain))
        cells = set(zip(key.tolist(), row.tolist()))
        width = {k: sum(k == c[0] for c in cells) for k in {c[0] for c in cells}}
        assert list(zip(*(x.tolist() for x in plain))) == sorted(
            ((k, r, width[k]) for k, r in cells if width[k] > 1), key=lambda c: (c[1], c[0])
        )


def test_components_in_rounds_and_at_once(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(300, i) for i in range(301, 900)]
    df = spark.createDataFrame(edges, "u long, v long")
    at_once, rounds = (sorted(map(tuple, connected_components(df, n).collect())) for n in (10_000, 0))
    assert at_once == rounds and len(at_once) > 600


def test_frames_that_are_no_files(spark, docs_of):
    """A frame that is dealt out anew each time it is read is written first."""
    texts = corpus(9)
    df = docs_of(texts).repartition(5).withColumn("order", __import__("pyspark.sql.functions", fromlist=["x"]).rand())
    want = sorted({c if n else i for i, (n, c) in brute(texts).items()})
    assert sorted(r.doc_id for r in ngram_join.deduplicate(df.orderBy("order")).collect()) == want


def test_names_too_short_to_tell_sets_apart(spark, docs_of, table_dir, monkeypatch):
    assert [ngram_join.name_width(n) for n in (0, 1000, 10**6, 10**11, 10**30)] == [2, 4, 7, 11, 16]
    monkeypatch.setattr(ngram_join, "name_width", lambda n: 1)
    texts = corpus(2) + [f"one two three four five {i}" for i in range(300)]
    rows = op2_ngram_jaccard_join(spark, table_dir(docs_of(texts).repartition(3))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts)


def test_in_a_byte():
    import numpy as np

    held = np.unique(np.concatenate([np.arange(1, 3000), 2 ** np.arange(12, 33) - 1]))
    out = ngram_join.in_a_byte(held)
    assert (out[:64] == held[:64]).all() and (np.diff(out.astype(int)) >= 0).all() and out[-1] < 255


class FunctionOf:
    """Stands in for a DataFrame: what would be applied to each group comes back as it is."""

    def groupBy(self, *columns):
        return self

    def applyInArrow(self, function, schema):
        return function


def one_block(sets=2000, each=500):
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(5)
    names = [x.split()[0] for x in ngram_join.SCATTERED.split(", ")]
    parts = []
    for _ in range(20):  # a slice of documents each
        n = sets // 20
        low, high = rnd.integers(0, 2**32, n * each, np.uint32), rnd.integers(0, 256, n * each, np.uint8)
        low[::2], high[::2] = rnd.integers(0, 5000, n * each // 2), 0  # half of them are shared
        parts.append([0, *[None] * 4, rnd.bytes(n * 8), np.full(n, each, "<u4").tobytes(), low.tobytes(), high.tobytes()])
    kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 5]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*parts), kinds)], names=names), sets * each


def test_a_block_takes_little_memory_and_gives_it_back():
    import subprocess
    import sys
    import tracemalloc

    function = ngram_join.gather(FunctionOf(), 8)
    table, entries = one_block()
    tracemalloc.start()
    assert len(function(table)) == 2000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * entries

    # what stays with a worker, in a process of its own
    code = (
        "import sys; sys.path[:0] = sys.argv[1:]\n"
        "from test_ngram_join import FunctionOf, one_block, ngram_join\n"
        "import re\n"
        "anon = lambda: int(re.search(r'Anonymous:\\s+(\\d+)', open('/proc/self/smaps_rollup').read())[1]) >> 10\n"
        "function, (table, entries) = ngram_join.gather(FunctionOf(), 8), one_block()\n"
        "at = anon()\n"
        "for _ in range(3): len(function(table))\n"
        "print(anon() - at)"
    )
    root = ngram_join.__file__.rsplit("/tablewright/", 1)[0]
    said = subprocess.run(
        [sys.executable, "-c", code, root, f"{root}/tests/llm"], capture_output=True, text=True, check=True, timeout=100
    )
    assert int(said.stdout) < 30
