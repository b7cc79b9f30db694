import random
import zlib
from collections import defaultdict

import numpy as np
from tablewright.llm import bestfit_pack as b
from tablewright.llm import tokens
from tablewright.llm.queries import op8_best_fit_packing


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(1)
    for case in range(60):
        capacity = rnd.choice([7, 64, 100, 4096])
        lengths = [min(capacity, 1 + int(rnd.expovariate(4 / capacity))) for _ in range(rnd.randint(0, 400))]
        histogram = defaultdict(int)
        for n in lengths:
            histogram[n] += 1
        runs, bins = b.plan(dict(histogram), capacity)
        assert bins == best_fit_decreasing(lengths, capacity)
        used = defaultdict(list)
        for n, parts in runs.items():
            ends = [p[0] for p in parts[1:]] + [histogram[n]]
            for (rank, first, offset), end in zip(parts, ends):
                for k in range(end - rank):
                    used[first + k].append((offset, n))
        assert sum(map(len, used.values())) == len(lengths) and len(used) == bins
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity


def test_room_tree():
    tree, rnd, have = b.RoomTree(100), random.Random(5), set()
    for _ in range(3000):
        room = rnd.randint(0, 100)
        have ^= {room}
        tree.set(room, room in have)
        least = rnd.randint(0, 100)
        assert tree.tightest(least) == min((r for r in have if r >= least), default=None)


def check(rows, texts, capacity):
    model = tokens.Encoder(tokens.default_path()).model
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    spans, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        spans[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, all_ids in ids.items():
        want = [(k, s, min(capacity, len(all_ids) - s)) for k, s in enumerate(range(0, len(all_ids), capacity))]
        assert sorted(spans[i]) == want
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_query(spark, docs_of, table_dir):
    rnd = random.Random(4)
    texts = [None, "", *(" ".join(rnd.choices("abcdefgh", k=int(rnd.expovariate(1 / 900)))) for _ in range(150))]
    texts += ["same text again"] * 60 + [" ".join("xyz"[i % 3] for i in range(9000))]
    rows = op8_best_fit_packing(spark, table_dir(docs_of(texts).repartition(5))).collect()
    n = check(rows, dict(enumerate(texts)), 4096)
    assert n == best_fit_decreasing([r.length for r in rows], 4096)


def test_sequences_hold_the_tokens(spark, docs_of):
    texts = [f"{'word ' * i}" for i in range(40)]
    packed = b.pack_documents(docs_of(texts), capacity=32, ids=True)
    rows = {r.sequence_id: r for r in b.sequences(packed).collect()}
    for r in packed.collect():
        assert rows[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def test_empty_repeats_and_clashing_names(spark, docs_of):
    assert b.pack_documents(docs_of([]).limit(0)).count() == 0
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (None, None, 9)], "doc_id long, text string, offset int")
    rows = b.pack_documents(df).collect()
    assert sorted(r.offset for r in rows) == [0, 1, 3] or sorted(r.offset for r in rows) == [0, 2, 4]
