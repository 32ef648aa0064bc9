import math
import random

import numpy as np
import pytest

from verdance.llm import topk


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, v in good:
        if q is None or q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i is not None, i) for i, w in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 100, "block_rows": 4, "chunk_rows": 3}])
def test_matches_brute_force(spark, sizes):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, topk.search(df, **sizes).collect()), key=str) == brute(rows)


def test_edges(spark):
    rng = random.Random(6)
    rows = [(0, None), (50, []), (100, [1.0, None]), (150, [1.0, float("nan")]), (200, [float("inf"), 1.0]), (250, [0.5, 0.5]), (None, [0.5, 0.5])]
    rows += [(300, [1.0]), (350, [0.0, -0.1, 0.3])] + [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for i in range(1, 40)]
    rows += [(7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0])] * 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as rank")
    got = sorted(map(tuple, topk.search(df, group_rows=10, block_rows=3).collect()), key=str)
    queries = {q for q, *_ in got}
    assert queries == {250, 300, 350}
    assert got == brute([(i, (v + [0.0] * 3)[:3] if v and len(v) < 3 and all(c is not None and math.isfinite(c) for c in v) else v) for i, v in rows])
    assert topk.search(df.where("vec_id = 300")).collect() == []
    assert topk.search(df.limit(0)).collect() == []
    big = spark.createDataFrame([(50, [1e9, 1.0]), (1, [1e4, -3.0]), (2, [1e4, -2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(big).orderBy("rank").collect()] == [(2, 256**2 * (10**13 - 2)), (1, 256**2 * (10**13 - 3))]


def test_repeated_rows_and_queries(spark):
    rng = random.Random(9)
    rows = [(i % 70, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(300)] + [(50, [1.0, 2.0, 0.0, 1.0])] * 3 + [(None, [3.0, 3.0, 3.0, 3.0])] * 9
    scored = {}
    for q, v in rows:
        if q is not None and q % 50 == 0:
            scored.setdefault(q, []).extend((-256 * 256 * int(sum(a * b for a, b in zip(v, w))), i is not None, i) for i, w in rows if i != q)
    want = [(q, r + 1, i, -s) for q, found in scored.items() for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ({}, {"group_rows": 20, "block_rows": 4, "chunk_rows": 2}):
        assert sorted(map(tuple, topk.search(df, **sizes).collect()), key=str) == sorted(want, key=str)


def test_floor_skips_blocks_of_other_groups():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 30, (2048, 6)))
    index, q = topk.BlockIndex(np.arange(2048), x, 16), np.array([90.0, 10, 0, 0, 0, 0])
    bound = index.bounds(q[None])[0]
    best = index.search(q, -1, -1, 5, bound)[0]
    before, index.scored = index.scored, 0
    assert index.search(q, -1, -1, 5, bound, float(best[-1]))[0].tolist() == best.tolist()
    assert index.scored <= before and index.search(q, -1, -1, 5, bound, float(best[0]) + 1)[0].size <= 5


def test_blocks_are_skipped():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (40, 16))
    x = np.floor(np.repeat(centres, 64, axis=0) + rng.normal(0, 5, (2560, 16)))
    index = topk.BlockIndex(np.arange(2560), x)
    for q in x[::100]:
        scores, ids = index.search(q, -1, -1, 5, index.bounds(q[None])[0])
        order = np.lexsort((np.arange(2560), -(x @ q)))[:5]
        assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].tolist()
    assert index.scored < 0.2 * index.seen
