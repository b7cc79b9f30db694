import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tablewright.llm import decontaminate as d
from tablewright.llm.queries import op9_benchmark_decontamination


def edit_search(pattern, text):
    """(distance, first end) of the best approximate occurrence, by the textbook table."""
    column = list(range(len(pattern) + 1))
    best = (column[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i - 1] + (p != c), column[i] + 1, new[i - 1] + 1))
        column = new
        if column[-1] < best[0]:
            best = (column[-1], j)
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_bit_parallel_distance(pattern, text):
    want = edit_search(pattern, text)
    got = d.closest(pattern, text, len(pattern) - 1)
    assert got == (want if want[0] < len(pattern) else None)


def brute(text, items):
    text = d.normal(text)
    out = {}
    for n, item in items:
        distance, end = edit_search(item, text)
        if distance <= d.edits(len(item), d.BUDGET):
            out[n] = distance
    return out


@pytest.fixture(scope="module")
def sample():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("etaoinshr", k=rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rnd.randint(8, 30))) for i in range(12)] + [(100, "too short"), (101, ""), (102, None)]
    texts = [None, "", "short"]
    for i, item in items[:12]:
        noisy = list(item)
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8, 20])):
            at = rnd.randrange(len(noisy))
            noisy[at : at + rnd.choice([0, 1])] = rnd.choice(["", "q", "zz"])
        texts += [f"{prose(20)}. {''.join(noisy).upper()}! {prose(30)}", prose(60)]
    return items, texts + texts[3:4] * 5


def test_query_against_brute_force(spark, docs_of, table_dir, sample, tmp_path):
    items, texts = sample
    path = table_dir(docs_of(texts))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = op9_benchmark_decontamination(spark, path).collect()
    used = [(n, d.normal(t)) for n, t in items if t and len(d.normal(t)) >= d.LEAST]
    want = {(i, n): e for i, t in enumerate(texts) if t for n, e in brute(t, used).items()}
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == want and len(want) >= 8
    for r in rows:
        if r.distance == 0:
            assert d.normal(texts[r.doc_id][r.start : r.end]) == dict(used)[r.item_id]
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    clean = d.decontaminate(docs_of(texts), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert clean.columns == docs_of(texts).columns
    blocks = d.find_contamination(docs_of(texts), bench, block_bytes=300).collect()
    assert sorted(blocks) == sorted(rows)


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(docs_of(["a"]), bench).count() == 0
    assert d.decontaminate(docs_of(["a", None]), bench).count() == 2
    some = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert d.find_contamination(docs_of([]).limit(0), some).count() == 0


def test_spans_survive_odd_letters():
    text = "İİ ß — The Quick,\n Brown…fox jumps OVER the lazy dog ½ end"
    matcher = d.Matcher([(1, "quick brown fox jumps over the lazy dog")], 8)
    ((_, a, b, distance),) = matcher.find(d.normal(text))
    begin, end = d.original(text, a, b)
    assert distance == 0 and abs(begin - text.index("Quick")) <= 2 and abs(end - text.index(" ½")) <= 2


def test_short_items_are_found_word_for_word(spark, docs_of):
    """op9_benchmark_decontamination: a question, a formula, sentences without spaces; no edits, whole words only."""
    items = [(1, "What is 7 x 8?"), (2, "E = mc^2"), (3, "\u6c34\u7684\u5316\u5b66\u5f0f\u662f\u4ec0\u4e48\uff1f"), (4, "art"), (5, "?!"), (6, None)]
    texts = [
        "Quiz: what is 7 x 8? Easy.", "what is 7 x 85", "what is 7 y 8", "So e=MC^2, he said", "the mc 2 e mc 23",
        "\u8bf7\u95ee\u6c34\u7684\u5316\u5b66\u5f0f\u662f\u4ec0\u4e48\u5462", "start the party", "state-of-the-art", "?!", "", None,
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.find_contamination(docs_of(texts), bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows} == {(0, 1, 0), (3, 2, 0), (5, 3, 0), (7, 4, 0)}
    assert {r.item_id: texts[r.doc_id][r.start : r.end] for r in rows} == {
        1: "what is 7 x 8", 2: "e=MC^2", 3: items[2][1][:-1], 4: "art",
    }
    clean = d.decontaminate(docs_of(texts), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {0, 3, 5, 7}


def test_clashing_columns_and_blocks(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, __text string, ITEM string")
    bench = spark.createDataFrame([(i, f"{w} two three four five six seven") for i, w in enumerate(["one", "nine", "ten"])], "item_id long, text string")
    for size in (1, 1 << 20):
        out = d.decontaminate(df, bench, block_bytes=size)
        assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [2]
        assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
