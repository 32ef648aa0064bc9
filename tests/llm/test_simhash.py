import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verdance.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "a b c d", "É ß A B C", "x " * 5000]
    texts += [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(100)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 8])
def test_components_match_brute_force(spark, tile_rows):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (None, "x y"), (None, "only null id"), (5, "x y"), (5, "x y")]
    base = [" ".join(rng.choice("abcdefghij") for _ in range(400)) for _ in range(12)]
    for i in range(150):
        words = base[i % 12].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(400)] = rng.choice("klmn")
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("u", F.lit(1))
    got = simhash.near_duplicates(df, tile_rows=tile_rows).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows), key=key)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_band_masks_lose_no_pair():
    rng = np.random.default_rng(0)
    for count in (10, 10**9, 10**14):
        masks = simhash.band_masks(count, 4, 65536)
        for _ in range(200):
            a = int(rng.integers(0, 2**63))
            b = a
            for bit in rng.choice(64, 4, replace=False):
                b ^= 1 << int(bit)
            assert any(a & m == b & m for m in masks)
