"""Exact top-k inner-product search, a block at a time.

Vectors are dealt into document ranges (groups of bounded size, by a hash of the
row, so that sizes are even); inside a group they are ordered
into small blocks of alike vectors.  A block keeps, for each term (dimension), the
greatest and least value in it, and a forward index of its vectors.  For a query
the summed term maxima bound every score in a block.  Blocks are scored through
their forward indexes in order of that bound until the next bound falls below the
k-th score so far; equal bounds are still scored, as ties go to smaller ids.
Group results are merged with partial top-k lists.

The first group is searched alone; each query's k-th score there is a floor below
which no block of any other group is scored.  Groups and query chunks have
bounded sizes, and each pair of them is one unit of work, so nothing is broadcast
and no task holds an unbounded share.  Repeated rows are counted first and
scored once.

Defined results: a vector that is null, empty or has a null or non-finite
component takes no part; shorter vectors count as padded with zeros; a null id
takes part as candidate but is no query, and sorts before other ids on ties; a
row is left out of its own query's candidates by id; repeated rows are candidates
each, and repeated queries of one id rank the candidates of all of them; components and scores beyond a long saturate; a query with fewer candidates than k gets them all; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

K = 5
#: Vectors of a group, of a block, and queries of a chunk.
GROUP_ROWS = 16384
BLOCK_ROWS = 64
CHUNK_ROWS = 8192


def blocks_of(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row indices in blocks of ``rows`` at most, split at the median of the widest dimension in turn."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if part.size <= rows:
            done.append(part)
            continue
        dim = int(np.argmax(np.var(x[part], axis=0)))
        half = rows * max(1, part.size // rows // 2)
        order = np.argpartition(x[part, dim], half - 1)
        todo += [part[order[half:]], part[order[:half]]]
    return done


class BlockIndex:
    """Forward indexes and term bounds of one group's blocks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: int = BLOCK_ROWS):
        self.parts = blocks_of(x, rows)
        order = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        self.ids, self.x = ids[order], x[order]
        self.at = np.concatenate(([0], np.cumsum([p.size for p in self.parts]))).astype(np.int64)
        self.most = np.array([x[p].max(0) for p in self.parts])
        self.least = np.array([x[p].min(0) for p in self.parts])
        #: Blocks scored and blocks seen, for measuring.
        self.scored = self.seen = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The summed term maxima of each query (row) over each block."""
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, query: np.ndarray, skip: int, until: int, k: int, bound: np.ndarray, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, ids)`` of the best k, but for those below ``floor`` and ids from ``skip`` to before ``until``; score descending, then id."""
        order = np.argsort(-bound, kind="stable")
        scores, ids = np.zeros(0), np.zeros(0, self.ids.dtype)
        step, i = 2, 0
        self.seen += order.size
        while i < order.size and bound[order[i]] >= floor:
            take = order[i : i + step]
            take = take[bound[take] >= floor]
            self.scored += take.size
            rows = np.concatenate([np.arange(self.at[b], self.at[b + 1]) for b in take])
            rows = rows[(self.ids[rows] < skip) | (self.ids[rows] >= until)]
            scores, ids = np.concatenate((scores, self.x[rows] @ query)), np.concatenate((ids, self.ids[rows]))
            if scores.size > k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            if scores.size == k:
                floor = max(floor, float(scores.min()))
            i, step = i + take.size if take.size == step else order.size, min(64, step * 2)
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, factor: int = 256) -> DataFrame:
    """``id`` and ``v``: ``floor(factor * x)`` of each component, of the vectors that take part."""
    x = F.col(vector_col)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(good).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * factor)).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of integer lists, padded with zeros; float64 where products stay exact, else Python integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if (sizes == width).all():
        out = values.reshape(-1, width)
    else:
        out = np.zeros((len(sizes), width), np.int64)
        out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = values
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether float64 holds every partial sum of the products."""
    high = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return high < 2**53


def _pair(width: int, k: int, block_rows: int):
    """The best ``k`` scores of a chunk of queries with a group of vectors, as rows ``query_id, vec_id, score, n``."""

    def pair(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        names = ["query_id", "vec_id", "score", "n"]
        if ours.num_rows and theirs.num_rows:
            q, x = _matrix(ours.column("v"), width), _matrix(theirs.column("v"), width)
            dtype = np.float64 if _exact(q, x) else object
            ids = theirs.column("id").to_pylist()
            place = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), np.int64)
            rank = np.empty(len(ids), np.int64)  # ids compare by their order, equal ids alike
            rank[place] = np.cumsum([0] + [ids[a] != ids[b] for a, b in zip(place[1:], place)])
            rank_of = {ids[i]: r for i, r in enumerate(rank.tolist()) if ids[i] is not None}
            # A row's name in the index: its id's rank, then its place, so that copies can be counted after.
            name = rank * len(ids) + np.arange(len(ids))
            copies = theirs.column("n").to_numpy()
            index = BlockIndex(name, x.astype(dtype), block_rows)
            wanted = q.astype(dtype)
            floors = ours.column("floor").to_pylist()
            for i in range(0, len(wanted), 256):
                bounds = index.bounds(wanted[i : i + 256])
                for own, times, floor, query, bound in zip(ours.column("id").to_pylist()[i : i + 256], ours.column("n").to_pylist()[i : i + 256], floors[i : i + 256], wanted[i : i + 256], bounds):
                    mine = rank_of.get(own, -1)
                    low = -math.inf if floor is None else float(floor)
                    scores, found = index.search(query, mine * len(ids), (mine + 1) * len(ids), k, bound.astype(float) if dtype is not object else bound, low)
                    out[0] += [own] * len(found)
                    out[1] += [ids[r % len(ids)] for r in found.tolist()]
                    out[2] += [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores.tolist()]
                    out[3] += [int(copies[r % len(ids)]) * times for r in found.tolist()]
        types = [ours.schema.field("id").type, theirs.schema.field("id").type, pa.int64(), pa.int64()]
        return pa.table([pa.array(o, t) for o, t in zip(out, types)], names)

    return pair


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``vectors(id, v)`` for each of ``queries(id, v)``."""
    kind, query_kind = vectors.schema["id"].dataType, queries.schema["id"].dataType
    counted = lambda df: df.groupBy("id", "v").agg(F.count("*").alias("n"))
    vectors, queries = cut(counted(vectors), "topk-vectors"), cut(counted(queries), "topk-queries")
    total, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    asked, wide = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width, groups, chunks = max(width, wide), max(1, math.ceil(total / group_rows)), max(1, math.ceil(asked / chunk_rows))
    g = F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")
    c = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(chunks)).cast("int")
    schema = T.StructType([T.StructField("query_id", query_kind), T.StructField("vec_id", kind), T.StructField("score", T.LongType()), T.StructField("n", T.LongType())])
    dealt, held = queries.select("*", c.alias("c")), vectors.select("*", g.alias("g"))

    def found(asked: DataFrame, low: int, high: int) -> DataFrame:
        """The best of each group from ``low`` to ``high`` for each query."""
        left = asked.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("g"))
        right = held.where(F.col("g").between(low, high)).select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"))
        return left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(_pair(width, k, block_rows), schema)

    first = found(dealt.withColumn("floor", F.lit(None).cast("double")), 0, 0)
    if groups > 1:
        first = cut(first, "topk-first")
        # With k scores there, the least of them bounds the k-th of all from below; of an id's repeated queries the least such.
        floors = first.groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").cast("double").alias("floor")).where((F.col("m") >= k) & (F.abs("floor") < 2.0**53))
        once = dealt.groupBy("id").agg(F.count("*").alias("m")).where("m = 1").select("id")
        floors = floors.join(once, F.col("query_id") == F.col("id")).select("id", "floor")
        rest = found(dealt.join(floors, "id", "left").select("id", "v", "n", "floor", "c"), 1, groups - 1)
        first = first.unionByName(rest)
    some = first.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_first()))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = K, **sizes) -> DataFrame:
    """The ``k`` best of all rows for each row whose id ``every`` divides."""
    whole = integer_vectors(vectors, id_col, vector_col)
    return top_k(whole, whole.where(F.col("id") % every == 0), k, **sizes)
