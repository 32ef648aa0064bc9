import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.llm import similar


def jaccard(a, b):
    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_groups(rows, similarity=0.8):
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= similarity:
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        a = i
        while parent[a] != a:
            a = parent[a]
        groups.setdefault(a, []).append(str(r[0]))
    return sorted(sorted(g) for g in groups.values())


def got_groups(df, **o):
    groups = {}
    for r in similar.near_duplicates(df, **o).collect():
        groups.setdefault(bytes(r.group), []).append(str(r.doc_id))
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("sizes", [{}, {"tile_rows": 4, "block": 2}])
def test_groups_match_brute_force(spark, sizes):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Same Words"), (4, "same words"), (5, "x y z"), (5, "x y z"), (6, "a b c d e"), (7, "a b c d e f")]
    words = [f"w{i}" for i in range(4000)]
    n = 100
    for b in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 200, 600]))]
        for e in range(8):
            t = list(base)
            for _ in range(max(0, e - 1) * len(base) // 200):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    for b in range(3):  # a chain: each is like the next only
        t = [rng.choice(words) for _ in range(200)]
        for _ in range(6):
            rows.append((n, " ".join(t)))
            n += 1
            t = t[10:] + [rng.choice(words) for _ in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("node"), F.lit(2).alias("fp"))
    assert got_groups(df, **sizes) == brute_groups(rows)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 4000").orderBy("doc_id").limit(400)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_groups(rows)
    assert len(want) < len(rows)
    assert got_groups(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_spanning_links_span():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    fps = base[rng.integers(0, 30, 700)].copy()
    for _ in range(6):
        fps[np.arange(700), rng.integers(0, 4, 700)] ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    pops = np.bitwise_count(fps).sum(1).astype(np.int64)
    order = np.argsort(pops)
    fps, pops = fps[order], pops[order]
    sizes = np.full(700, 50)
    for block in (64, 1024):
        links = similar.spanning_links(fps, pops, sizes, None, 20, 0.8, block)
        label = np.arange(700)
        for a, b in links:
            assert np.bitwise_count(fps[a] ^ fps[b]).sum() <= 20
            label[label == label[b]] = label[a]
        far = sum(np.bitwise_count(fps[:, None, w] ^ fps[None, :, w]).astype(int) for w in range(4))
        assert (label[:, None] == label[None])[far <= 20].all() and len(links) == 700 - len(set(label.tolist()))


def test_empty_table(spark):
    assert got_groups(spark.createDataFrame([], "doc_id long, text string")) == []


def test_few_shingles(spark):
    rng = random.Random(6)
    rows = []
    for n in [*range(5, 46)] * 3:  # a text and one with a word more; another with so many more that 0.8 just holds
        base = [f"v{rng.randrange(10**9)}" for _ in range(n)]
        for more in {1, max(1, (n - 4) // 4)}:
            rows.append((len(rows), " ".join(base + [f"v{rng.randrange(10**9)}" for _ in range(more)])))
        rows.append((len(rows), " ".join(base)))
    for part, sizes in ((rows, {}), (rows[:80], {"tile_rows": 16, "block": 8, "open_rows": 5})):
        want = brute_groups(part)
        assert len(want) < 0.7 * len(part)
        got = got_groups(spark.createDataFrame(part, "doc_id long, text string"), **sizes)
        assert sum(g not in want for g in got) <= 2  # a pair in a few thousand shares no bucket


def test_sets_of_borderline_texts_match_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    rows, sets = [], []
    for size in [8] * 200 + [20] * 25:
        base = [rng.choice(words) for _ in range(400)]
        mine = []
        for _ in range(size):
            s = rng.uniform(0.75, 0.85)
            k = int(396 * (1 - s) / (1 + s) / 2)  # changed at either end, so that pairs lie around 0.8
            t = [rng.choice(words) for _ in range(k)] + base[k : 400 - k] + [rng.choice(words) for _ in range(k)]
            mine.append((len(rows) + len(mine), " ".join(t)))
        rows += mine
        sets.append(mine)
    got = {r.doc_id: bytes(r.group) for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    unlike = 0
    for mine in sets:
        groups = {}
        for d, _ in mine:
            groups.setdefault(got[d], []).append(str(d))
        unlike += sorted(sorted(g) for g in groups.values()) != brute_groups(mine)
    assert unlike <= 2  # a pair in a thousand lies beyond the buckets or the radius


def test_partner_behind_rejected_links_is_found(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(4):  # a text, its partner of just 0.8 and thirty rivals of 0.79, which look nearer here and there
        base = [rng.choice(words) for _ in range(204)]
        for s in [1.0, 0.8, *[0.79] * 30]:
            k = int(200 * (1 - s) / (1 + s))
            rows.append((len(rows), " ".join(base[: 204 - k] + [f"z{rng.randrange(10**9)}" for _ in range(k)])))
    want = brute_groups(rows)
    assert len(want) == len(rows) - 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"tile_rows": 16, "block": 8, "open_rows": 5}):
        assert got_groups(df, **sizes) == want
