import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tablewright.llm import suffix_dedup as d
from tablewright.llm.queries import op4_suffix_array_dedup
from tablewright.llm.suffix_sort import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(values):
    text = np.array(values, np.int64)
    assert suffix_array(text).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def brute(texts):
    """By a set of all strings seen so far; documents in order of their number."""
    seen, out = set(), {}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(raw[at : at + 100])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rnd = random.Random(seed)
    prose = lambda n: " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(2, 8))) for _ in range(n))
    passages = [prose(rnd.choice([12, 20, 30, 80])) for _ in range(6)]
    texts = [None, "", "short", "x" * 99, "y" * 100, "y" * 101, "z" * 400, "ab" * 300, "for " * 200, "the " * 90 + prose(50)]
    for _ in range(25):
        parts = [prose(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, len(p) // 2)
            parts += [p[cut : cut + rnd.randint(60, len(p))], prose(rnd.randint(0, 20))]
        texts.append(rnd.choice(["", " "]).join(parts))
    texts += [rnd.choice(texts[10:]) for _ in range(10)] + [passages[0]] * 12
    edited = texts[20] or ""
    texts.append(edited[: len(edited) // 2] + "#" + edited[len(edited) // 2 :])
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_query_against_brute_force(spark, docs_of, table_dir, seed):
    texts = corpus(seed)
    rows = op4_suffix_array_dedup(spark, table_dir(docs_of(texts).repartition(3))).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    want = brute(texts)
    assert len(rows) == len(texts) and {k: got[k] for k in want if got[k] != want[k]} == {}


def test_small_slices_and_many_blocks(spark, docs_of, table_dir, monkeypatch):
    texts = corpus(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = op4_suffix_array_dedup(spark, table_dir(docs_of(texts).repartition(9))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(texts)


def test_anchors_are_the_least_hashes():
    rng = np.random.default_rng(1)
    raws = [rng.integers(0, 3, n).astype(np.uint8).tobytes() for n in (1500, 0, 99, 100, 40, 700)]
    hashes, least, places, begins = d.anchors(raws)
    want = set()
    for raw, begin in zip(raws, begins.tolist()):
        own = d.gram_hashes(np.frombuffer(raw, np.uint8))
        assert hashes[begin : begin + len(own)].tolist() == own.tolist()
        for i in range(len(raw) - d.LENGTH + 1):
            low = own[i : i + d.PLACES].min()
            assert least[begin + i] == low
            want |= {begin + i + int(j) for j in np.flatnonzero(own[i : i + d.PLACES] == low)}
    assert set(places.tolist()) == want and int((least > 0).sum()) == sum(max(0, len(r) - 99) for r in raws)


def test_empty_null_ids_and_extra_columns(spark, docs_of, table_dir):
    assert op4_suffix_array_dedup(spark, table_dir(docs_of([]).limit(0))).count() == 0
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(150))
    rows = [(None, text, 1), (4, text, 1), (4, text, 1), (9, "head " + text, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").coalesce(1)
    path = table_dir(df)
    out = op4_suffix_array_dedup(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == [("4", 0), ("4", 150), ("9", 150), ("None", 150)]


def test_periodic_and_very_long_texts(spark, docs_of, table_dir, monkeypatch):
    """Runs, periods of all lengths, and one text in several pieces."""
    rnd = random.Random(4)
    prose = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    texts = [prose(30) + prose(p) * (700 // p) + prose(40) for p in (1, 2, 3, 7, 20, 47, 48, 52, 53, 54, 60, 99, 100, 130)]
    texts += ["a" * 500, "b" + "a" * 300 + "b", "ab" * 200 + "ba" * 100, "x" * 250 + "y" + "x" * 250]
    long = "".join(prose(rnd.choice([60, 200])) + rnd.choice([texts[3], "z" * 400, "", ""]) for _ in range(300))
    rows = op4_suffix_array_dedup(spark, table_dir(docs_of([*texts, long, long[100:5000]]))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute([*texts, long, long[100:5000]])


def test_pieces_of_long_documents():
    rnd = random.Random(5)
    raws = [bytes(rnd.choices(b"abc", k=n)) for n in (10, 3 * d.SLICE_BYTES, 500)]
    groups = list(d.pieces_of(raws))
    assert sorted({i for g in groups for i in g[0]}) == [0, 1, 2]
    windows = {(i, o + k) for g in groups for i, o, raw in zip(*g) for k in range(max(0, len(raw) - d.LENGTH + 1))}
    assert windows == {(i, k) for i, raw in enumerate(raws) for k in range(max(0, len(raw) - d.LENGTH + 1))}
    assert all(raws[i][o : o + len(raw)] == raw for g in groups for i, o, raw in zip(*g))


def test_periodic_runs_are_settled():
    for text in ("q" * 3000, "abcde" * 600, "k" * 500 + "l" + "k" * 500):
        raw = text.encode()
        hashes, _, places, _ = d.anchors([raw])
        wanted = np.unique(hashes[places] & np.uint64((1 << 40) - 1))
        runs = d.runs_of_windows([raw], np.zeros(1, np.int64), wanted, np.zeros(len(wanted), bool))
        settled = d.periodic(np.frombuffer(raw, np.uint8), *runs[:3], runs[4])
        assert settled.sum() > 0.8 * len(settled) and not settled[0]
        for i in np.flatnonzero(settled).tolist():
            at, n = int(runs[0][i]), int(runs[1][i])
            assert raw[at : at + n + 99] == raw[at - n : at + 99]


def test_hot_anchors(spark, docs_of, table_dir):
    """A passage in more documents than HOT, with other words around it each time."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(25))
    cuts = [rnd.randint(0, 20) for _ in range(d.HOT + 300)]
    texts = [f"{word()} {word()} {passage[c:]} {word()}{word()}" for c in cuts]
    rows = op4_suffix_array_dedup(spark, table_dir(docs_of(texts))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(texts)
