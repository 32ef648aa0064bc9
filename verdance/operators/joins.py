"""Interval, as-of, footprint, polygon and neighbour joins, all as equi-joins where a key can be made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_segment(points: DataFrame, segments: DataFrame, keys: tuple[str, ...], t: str = "day", start: str = "t_start", end: str = "t_end") -> DataFrame:
    """The segment that holds a point's time, else the one after it, else the last.

    Segments come as one array per key, so points join on the key alone and pick
    by an expression; no range join and no row per candidate.
    """
    value = [c for c in segments.columns if c not in keys]
    packed = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("__s"), *value))).alias("__segs"))
    holds = F.filter("__segs", lambda s: s[end] >= F.col(t))
    pick = F.coalesce(F.try_element_at(holds, F.lit(1)), F.try_element_at("__segs", F.lit(-1)))
    out = points.join(packed, list(keys), "left").withColumn("__pick", pick)
    return out.select(*points.columns, *(F.col("__pick")[c].alias(c) for c in value))


def cell(x: Column, origin: float, width: float) -> Column:
    """The cell of a regular grid that holds a coordinate."""
    return F.floor((x - F.lit(origin)) / F.lit(width))


def footprint(fine: DataFrame, coarse: DataFrame, x: str, y: str, cx: str, cy: str, width: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Fine pixels inside each coarse pixel, by integer cell keys."""
    keyed = fine.withColumn(cx, cell(F.col(x), origin[0], width)).withColumn(cy, cell(F.col(y), origin[1], width))
    return keyed.join(coarse, [cx, cy])


def inside_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Ray casting: whether a point lies in the polygon of ``edges`` (array of x1, y1, x2, y2)."""
    crossed = F.filter(
        edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]),
    )
    return F.size(crossed) % 2 == 1


def touches_edge(x: Column, y: Column, edges: Column, half: float = 0.5) -> Column:
    """Whether an edge crosses the square of half width ``half`` around a point (separating axes)."""

    def crosses(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        near_x = (F.least(e["x1"], e["x2"]) <= x + half) & (F.greatest(e["x1"], e["x2"]) >= x - half)
        near_y = (F.least(e["y1"], e["y2"]) <= y + half) & (F.greatest(e["y1"], e["y2"]) >= y - half)
        return near_x & near_y & (F.abs((x - e["x1"]) * dy - (y - e["y1"]) * dx) <= half * (F.abs(dx) + F.abs(dy)))

    return F.exists(edges, crosses)


def zonal(pixels: DataFrame, polygons: DataFrame, x: str, y: str, poly: str = "poly", all_touched: bool = False) -> DataFrame:
    """Pixels with the polygon that holds their centre or, with ``all_touched``, any part of them; a box test goes first.

    ``polygons`` has ``poly`` and ``edges``; tiles of the boxes' grid make the join an
    equi-join.  A tile keeps the edges that a ray from its pixels can meet, and one
    that no edge comes near keeps only whether it lies inside.
    """
    side, more = 16.0, 0.5 if all_touched else 0.0
    xs, ys = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    boxed = polygons.select(poly, "edges", (F.array_min(xs) - more).alias("__xa"), (F.array_max(xs) + more).alias("__xb"), (F.array_min(ys) - more).alias("__ya"), (F.array_max(ys) + more).alias("__yb"))
    tiled = boxed.withColumn("__tx", F.explode(F.sequence(cell(F.col("__xa"), 0, side), cell(F.col("__xb"), 0, side))))
    tiled = tiled.withColumn("__ty", F.explode(F.sequence(cell(F.col("__ya"), 0, side), cell(F.col("__yb"), 0, side))))
    x0, y0 = F.col("__tx") * side, F.col("__ty") * side  # pixels of a tile lie from here to before x0 + side
    met = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= y0 - more) & (F.least(e["y1"], e["y2"]) <= y0 + side + more) & (F.greatest(e["x1"], e["x2"]) >= x0 - more))
    tiled = tiled.withColumn("edges", met)
    crossed = F.exists("edges", lambda e: F.least(e["x1"], e["x2"]) <= x0 + side + more)
    tiled = tiled.withColumn("__whole", F.when(~crossed, inside_polygon(x0 + side / 2, y0 + side / 2, F.col("edges"))))
    tiled = tiled.where("__whole is null or __whole").withColumn("edges", F.when(F.col("__whole").isNull(), F.col("edges")))
    keyed = pixels.withColumn("__tx", cell(F.col(x), 0, side)).withColumn("__ty", cell(F.col(y), 0, side))
    inside = inside_polygon(F.col(x), F.col(y), F.col("edges"))
    if all_touched:
        inside = inside | touches_edge(F.col(x), F.col(y), F.col("edges"))
    hit = F.col(x).between(F.col("__xa"), F.col("__xb")) & F.col(y).between(F.col("__ya"), F.col("__yb")) & F.coalesce(F.col("__whole"), inside)
    return keyed.join(tiled, ["__tx", "__ty"]).where(hit).select(*pixels.columns, poly)


def knn_labels(
    points: DataFrame, known: DataFrame, features: str, label: str, k: int = 5, point_id: str = "id", known_id: str | None = None, chunk_rows: int = 8192, group_rows: int = 8192,
) -> DataFrame:
    """``point_id``, the majority label of the ``k`` nearest labelled vectors and its votes; ties take the lesser label.

    Points and labelled rows meet in blocks: each pair of a chunk and a group is one
    unit of work that gives partial lists of ``k``, so no side is broadcast or
    bounded.  Distances are squared and rounded to nine decimals.  ``known_id``
    names the id by which a point is left out of its own neighbours.  Vectors of
    another length than most, or with NULL or non-finite components, take no part.
    """
    good = lambda df: df.where(F.col(features).isNotNull() & (F.size(features) > 0) & F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    n = F.count(F.lit(1))
    wide = good(known).where(F.col(label).isNotNull()).groupBy(F.size(features).alias("w")).agg(n.alias("n")).orderBy(F.desc("n"), "w").first()
    width, groups = (wide.w, -(-wide.n // group_rows)) if wide else (0, 1)
    asked = good(points).where(F.size(features) == width)
    chunks = max(1, -(-asked.count() // chunk_rows))
    own = F.col(known_id).cast("string") if known_id else F.lit(None).cast("string")
    deal = lambda by, parts: F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    left = asked.select(F.col(point_id).alias("i"), F.col(features).alias("f"), deal((point_id, features), chunks).alias("c")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = good(known).where((F.size(features) == width) & F.col(label).isNotNull()).select(own.alias("o"), F.col(label).alias("l"), F.col(features).alias("f"), deal((label, features), groups).alias("g"))
    right = right.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def nearest(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        at, labels, far = [], [], []
        if ours.num_rows and theirs.num_rows:
            matrix = lambda t: t.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
            a, b = matrix(ours), matrix(theirs)
            names = sorted(set(theirs.column("l").to_pylist()))
            place = {name: i for i, name in enumerate(names)}
            of = np.array([place[x] for x in theirs.column("l").to_pylist()])
            ids, owners = [str(x) for x in ours.column("i").to_pylist()], theirs.column("o").to_numpy(zero_copy_only=False)
            for i in range(0, len(a), 256):
                part = a[i : i + 256]
                d = np.zeros((len(part), len(b)))
                for j in range(a.shape[1]):
                    d += np.square(part[:, j, None] - b[None, :, j])
                d = np.round(d, 9)
                if known_id:
                    d[np.array(ids[i : i + 256], object)[:, None] == owners[None]] = np.inf
                order = np.argsort(of, kind="stable")  # among equal distances the lesser label first
                best = order[np.argsort(d[:, order], axis=1, kind="stable")[:, :k]]
                for r, cols in enumerate(best):
                    cols = cols[np.isfinite(d[r, cols])]
                    at += [i + r] * len(cols)
                    labels += [names[x] for x in of[cols].tolist()]
                    far += d[r, cols].tolist()
        return pa.table([ours.column("i").combine_chunks().take(pa.array(at, pa.int64())), pa.array(labels, theirs.schema.field("l").type), pa.array(far, pa.float64())], ["i", "l", "d"])

    schema = T.StructType([T.StructField("i", points.schema[point_id].dataType), T.StructField("l", known.schema[label].dataType), T.StructField("d", T.DoubleType())])
    found = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(nearest, schema)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "l"))
    ranked = found.withColumn("r", rank).where(F.col("r") <= k).groupBy(F.col("i").alias(point_id), F.col("l").alias(label)).agg(n.alias("votes"))
    best = F.row_number().over(Window.partitionBy(point_id).orderBy(F.desc("votes"), label))
    return ranked.withColumn("__r", best).where("__r = 1").drop("__r")


def unordered_pairs(df: DataFrame, key: str, left: str = "a", right: str = "b", most: int = 2000) -> DataFrame:
    """All pairs of rows with ``key`` rising, of a table of ``most`` rows at most (checked)."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows; {most} at most, as all pairs are made")
    one = df.select(*(F.col(c).alias(f"{c}_{left}") for c in df.columns))
    two = df.select(*(F.col(c).alias(f"{c}_{right}") for c in df.columns))
    return one.join(two, F.col(f"{key}_{left}") < F.col(f"{key}_{right}"))
