import random

import pytest

from verdance.llm import components


def plain(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def got(spark, edges):
    rows = components.roots(spark.createDataFrame(edges, "u long, v long").selectExpr("*", "1 as m", "2 as n")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.root for r in rows}


@pytest.mark.parametrize("hubs_from", [200_000, 1])
def test_components_match_plain_union(spark, monkeypatch, hubs_from):
    monkeypatch.setattr(components, "HUBS_FROM", hubs_from)
    monkeypatch.setattr(components, "HUB_SHARE", 20)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)]
    edges += [(500, i) for i in range(501, 700)] + [(i, 1000) for i in range(1001, 1100)]  # hubs, least and greatest
    edges += [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (None, 7), (8, None), (1, 2), (2, 1), (1, 2)]
    rng.shuffle(edges)
    assert got(spark, edges) == plain(edges)


def test_nothing_to_join(spark):
    assert got(spark, []) == {} and got(spark, [(1, 1), (None, None)]) == {}
