"""Connected components by alternating large-star and small-star rounds.

Defined results: an edge with a null end joins nothing and is left out, as is an
edge from a node to itself; repeated edges count once; an empty table gives an
empty result.  Only ``u`` and ``v`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_written, hot_join, written

#: Links from which hubs are looked for, and the share of all links (one in so many) that makes a node a hub.
HUBS_FROM, HUB_SHARE = 200_000, 1000


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """``links`` with ``m``, the least of u and its neighbours.

    The links of a hub would meet in one task; hubs, ``2 * HUB_SHARE`` at most, are joined by broadcast instead.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    if total < HUBS_FROM:
        return links.join(least.drop("n"), "u")
    return hot_join(links, least, "u", F.col("n") * HUB_SHARE > total).drop("n")


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star round over the ``total`` links ``(u, v)``.

    large: the greater neighbours of u are linked to the least of u and its neighbours.
    small: u and its lesser neighbours are linked to the least of them.
    """
    if large:
        links = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(links, total)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        both = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        out = joined.select(both.alias("x")).select("x.*")
    return out.where("u <> v").distinct()


def roots(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the least node of its component.

    Rounds grow with the logarithm of the longest path; each is written to the
    shared folder and the one before deleted.  The driver sees a row count and a
    checksum, never the links.
    """
    now = cut(edges.where("u <> v").select("u", "v").distinct(), label)
    before = None
    while True:
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark[0] == 0 or (before is not None and tuple(mark) == before):
            break
        before = tuple(mark)
        kept = written()
        now = cut(_star(_star(now, True, mark[0]), False, mark[0]), label)
        drop_written(now.sparkSession, kept - 1, last=kept)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
