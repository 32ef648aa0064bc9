"""Resampling, gap filling, texture and spatial statistics of long pixel tables.

Tables have ``keys`` (the image), integer ``prow`` and ``pcol`` and a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name -> aggregate of a block's values
AGGREGATES = {
    "average": F.avg,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "med": lambda v: F.percentile(v, F.lit(0.5)),
    "q1": lambda v: F.percentile(v, F.lit(0.25)),
    "q3": lambda v: F.percentile(v, F.lit(0.75)),
    "rms": lambda v: F.sqrt(F.avg(F.col(v) * F.col(v))),
}
KERNELS = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos")


def _sized(df: DataFrame, keys: tuple[str, ...], scale: float | Column, extent: tuple[int, int] | None) -> DataFrame:
    """Rows with the truncated output size ``__h, __w`` of rasters of ``extent`` rows and columns.

    Without it, a raster ends at the greatest row and column it has.
    """
    blocks = lambda n: F.floor(n / scale + 1e-9)
    if extent is not None:
        return df.withColumns({c: blocks(F.lit(n)) for c, n in zip(("__h", "__w"), extent)})
    return df.join(df.groupBy(*keys).agg(blocks(F.max("prow") + 1).alias("__h"), blocks(F.max("pcol") + 1).alias("__w")), list(keys))


def block_keys(df: DataFrame, keys: tuple[str, ...], scale: float | Column, value: str = "v", extent: tuple[int, int] | None = None) -> DataFrame:
    """Rows with the block they fall in; blocks beyond the truncated output size are dropped."""
    out = _sized(df.withColumn("brow", F.floor(F.col("prow") / scale + 1e-9)).withColumn("bcol", F.floor(F.col("pcol") / scale + 1e-9)), keys, scale, extent)
    return out.where((F.col("brow") < F.col("__h")) & (F.col("bcol") < F.col("__w"))).drop("__h", "__w")


def resample(df: DataFrame, keys: tuple[str, ...], scale: float | Column, methods: tuple[str, ...], value: str = "v", extent: tuple[int, int] | None = None) -> DataFrame:
    """``keys, brow, bcol`` and one column per aggregating method; unknown methods are an error.

    ``scale`` may be a column that is constant for each of ``keys``.  ``extent`` has
    the rows and columns of rasters whose last ones may be absent.
    """
    unknown = [m for m in methods if m not in AGGREGATES and m != "mode"]
    if unknown:
        raise ValueError(f"unknown methods {unknown}; known: {', '.join([*AGGREGATES, 'mode', *KERNELS])}")
    blocks = block_keys(df, keys, scale, value, extent)
    by = [*keys, "brow", "bcol"]
    out = blocks.groupBy(*by).agg(*(AGGREGATES[m](value).alias(m) for m in methods if m != "mode")) if set(methods) - {"mode"} else None
    if "mode" in methods:
        counts = blocks.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
        top = counts.groupBy(*by).agg(F.max(F.struct("__n", (-F.col(value)).alias("__v"))).alias("__x")).select(*by, (-F.col("__x.__v")).alias("mode"))
        out = top if out is None else out.join(top, by, "left")
    return out


def _weights(method: str, x: Column) -> Column:
    """Kernel weight at a distance in input pixels."""
    d = F.abs(x)
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - d)
    if method == "cubic":
        near = 1.5 * d * d * d - 2.5 * d * d + 1
        far = -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2
        return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)
    if method == "cubic_spline":
        near = (3 * d * d * d - 6 * d * d + 4) / 6
        far = (2 - d) * (2 - d) * (2 - d) / 6
        return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)
    pi = 3.141592653589793
    wave = F.sin(pi * d) / F.nullif(pi * d, F.lit(0.0)) * F.sin(pi * d / 3) / F.nullif(pi * d / 3, F.lit(0.0))
    return F.when(d == 0, 1.0).when(d < 3, wave).otherwise(0.0)


REACH = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3}


def _spread(df: DataFrame, place: str, block: str, size: str, low: Column, high: Column) -> DataFrame:
    """Rows with each of the blocks from ``low`` to ``high`` that the output of ``size`` has."""
    low, high = F.greatest(low.cast("long"), F.lit(0)), F.least(high.cast("long"), F.col(size) - 1)
    kept = df.withColumns({"__lo": low, "__hi": high}).where("__lo <= __hi")  # sequence would count down
    return kept.withColumn(block, F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def resample_kernel(df: DataFrame, keys: tuple[str, ...], scale: float | Column, method: str, value: str = "v", extent: tuple[int, int] | None = None) -> DataFrame:
    """``keys, brow, bcol, value`` at block centres, by nearest pixel or by normalised kernel weights.

    On the way to coarser pixels a kernel is widened by the scale, so that every
    input pixel has its weight.  Weights are products of one along rows and one
    along columns, so two aggregations do: each pixel goes to the few blocks along
    a row whose kernel reaches it, then each such sum to the few along a column.
    A block that no pixel's kernel reaches has no row; ``extent`` is as in :func:`resample`.
    """
    sized = _sized(df.select(*keys, "prow", "pcol", value), keys, scale, extent)
    if method == "nearest":
        first = lambda p: F.ceil(F.col(p) / scale - 0.5 - 1e-9)  # noqa: E731  blocks whose centre the pixel holds
        last = lambda p: F.ceil((F.col(p) + 1) / scale - 0.5 - 1e-9) - 1
        near = _spread(_spread(sized, "pcol", "bcol", "__w", first("pcol"), last("pcol")), "prow", "brow", "__h", first("prow"), last("prow"))
        return near.select(*keys, "brow", "bcol", value)
    if method not in REACH:
        raise ValueError(f"unknown kernel {method!r}")
    wide = F.greatest(F.lit(1.0), scale) if isinstance(scale, Column) else max(1.0, float(scale))
    reach = REACH[method] * wide
    low = lambda p: F.ceil((F.col(p) + 0.5 - reach) / scale - 0.5)
    high = lambda p: F.floor((F.col(p) + 0.5 + reach) / scale - 0.5)
    away = lambda p, b: ((F.col(b) + 0.5) * scale - 0.5 - F.col(p)) / wide
    weighed = lambda rows, p, b: rows.where(F.abs(away(p, b)) < REACH[method]).withColumn("__k", _weights(method, away(p, b)))
    along = weighed(_spread(sized.where(F.col(value).isNotNull()), "pcol", "bcol", "__w", low("pcol"), high("pcol")), "pcol", "bcol")
    along = along.groupBy(*keys, "prow", "bcol", "__h").agg(F.sum(F.col("__k") * F.col(value)).alias("__v"), F.sum("__k").alias("__d"))
    across = weighed(_spread(along, "prow", "brow", "__h", low("prow"), high("prow")), "prow", "brow")
    total = F.sum(F.col("__k") * F.col("__v")) / F.nullif(F.sum(F.col("__k") * F.col("__d")), F.lit(0.0))
    return across.groupBy(*keys, "brow", "bcol").agg(total.alias(value))


def resample_to(df: DataFrame, keys: tuple[str, ...], current: float, target: float, method: str, value: str = "v", projected: bool = True) -> DataFrame:
    """``keys, brow, bcol, value`` at another resolution by any method; aggregates need a coarser one.

    The same resolution gives the pixels themselves; a grid in degrees is an error, as are
    unknown methods.
    """
    if not projected:
        raise ValueError("resolutions are in metres: project the grid first")
    if method not in AGGREGATES and method != "mode" and method not in KERNELS:
        raise ValueError(f"unknown method {method!r}")
    if target == current:
        return df.select(*keys, F.col("prow").alias("brow"), F.col("pcol").alias("bcol"), value)
    scale = target / current
    if method in KERNELS:
        return resample_kernel(df, keys, scale, method, value)
    if scale < 1:
        raise ValueError(f"{target} is finer than {current}: {method} needs a coarser resolution")
    return resample(df, keys, scale, (method,), value).withColumnRenamed(method, value)


def sweep(df: DataFrame, keys: tuple[str, ...], current: float, targets: tuple[float, ...], methods: tuple[str, ...], value: str = "v", extent: tuple[int, int] | None = None) -> DataFrame:
    """``keys, resolution, method, brow, bcol, value``: all targets by all methods, as :func:`resample_to` gives them.

    The target is a key of the pixels, so all targets take one aggregation for the
    aggregating methods and one for each kernel.  ``extent`` is as in :func:`resample`.
    """
    blocks, kernels = [m for m in methods if m not in KERNELS], [m for m in methods if m in KERNELS]
    if blocks and min(targets) < current:
        raise ValueError(f"{min(targets)} is finer than {current}: {blocks[0]} needs a coarser resolution")
    by, columns = (*keys, "resolution"), (*keys, "resolution", "method", "brow", "bcol", value)
    parts = []
    if current in targets:
        here = df.select(*keys, F.lit(float(current)).alias("resolution"), F.col("prow").alias("brow"), F.col("pcol").alias("bcol"), value)
        parts.append(here.withColumn("method", F.explode(F.array(*map(F.lit, methods)))))
    others = [float(t) for t in targets if t != current]
    if others:
        many = df.select(*keys, "prow", "pcol", value).withColumn("resolution", F.explode(F.array(*map(F.lit, others))))
        scale = F.col("resolution") / F.lit(float(current))
        if blocks:
            parts.append(resample(many, by, scale, tuple(blocks), value, extent).unpivot([*by, "brow", "bcol"], blocks, "method", value))
        parts += [resample_kernel(many, by, scale, k, value, extent).withColumn("method", F.lit(k)) for k in kernels]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def _nearest_in_columns(group: np.ndarray, row: np.ndarray, hole: np.ndarray, far: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each hole the place of the row whose own nearest known pixel (``far`` columns off, in column ``col``) is nearest to it.

    Rows are sorted by ``group`` (a column of an image), then ``row``.  Steps grow
    until no row further off can be nearer; ties take the least row, then column.
    """
    n = len(row)
    span = int(row.max() - row.min()) + 1 if n else 0
    key = group * np.int64(2 * span + 1) + (row - row.min() if n else row)
    square = np.where(far < 0, np.inf, far.astype(float) ** 2)
    best, source = square.copy(), np.arange(n)
    ends = np.append(np.flatnonzero(np.diff(group)), n - 1)[np.searchsorted(np.unique(group), group)] if n else row
    starts = np.searchsorted(group, group)
    active, step = np.flatnonzero(hole), 1
    while active.size:
        for sign in (-1, 1):
            want = key[active] + sign * step
            at = np.minimum(np.searchsorted(key, want), n - 1)
            hit = key[at] == want
            here, there = active[hit], at[hit]
            d = square[there] + float(step) ** 2
            better = (d < best[here]) | ((d == best[here]) & np.isfinite(d) & (row[there] < row[source[here]]))
            best[here[better]], source[here[better]] = d[better], there[better]
        step += 1
        more = (float(step) ** 2 <= best[active]) & ((row[ends[active]] - row[active] >= step) | (row[active] - row[starts[active]] >= step))
        active = active[more]
    return np.where(np.isfinite(best), source, -1)


def fill_nearest(df: DataFrame, keys: tuple[str, ...], value: str = "v", keep: str | None = None) -> DataFrame:
    """NULL pixels take the nearest value of their image, however far; ties take the least row, then column.

    Two passes of an exact distance transform: windows along rows find each pixel's
    nearest value in its row, then columns are searched for the nearest of these, so
    a task holds a few columns and never an image.  ``df`` has a row for every cell.
    ``keep`` names a boolean column of background pixels that stay NULL; an image
    without values stays as it is.
    """
    row = Window.partitionBy(*keys, "prow")
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("pcol").alias("c"), F.col(value).alias("v")))
    last = lambda by: F.last(seen, True).over(row.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    sided = df.withColumns({"__l": last(F.col("pcol")), "__r": last(F.desc("pcol"))})
    near = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(s)["c"] - F.col("pcol")).alias("d"), F.col(s)["c"].alias("c"), F.col(s)["v"].alias("v")))
    sided = sided.withColumn("__n", F.least(near("__l"), near("__r"))).drop("__l", "__r")
    hole = F.col(value).isNull() & (~F.coalesce(F.col(keep), F.lit(False)) if keep else F.lit(True))
    more = {"__hole": hole, "__d": F.coalesce(F.col("__n.d"), F.lit(-1)).cast("long"), "__c": F.coalesce(F.col("__n.c"), F.lit(-1)).cast("long"), "__v": F.col("__n.v")}
    dealt = sided.withColumns(more).drop("__n").repartition(*keys, "pcol").sortWithinPartitions(*keys, "pcol", "prow")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def filled(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = np.concatenate(([0], np.cumsum(new))).astype(np.int64)
            get = lambda c: table.column(c).to_numpy()
            source = _nearest_in_columns(group, get("prow").astype(np.int64), get("__hole"), get("__d"), get("__c"))
            own = np.where(get("__hole"), source, -1)
            take = pa.array(np.maximum(own, 0), pa.int64(), mask=own < 0)
            values = pa.compute.if_else(pa.array(get("__hole")), table.column("__v").combine_chunks().take(take), table.column(value).combine_chunks())
            out = table.select(names).set_column(names.index(value), table.schema.field(value), values)
            yield from out.combine_chunks().to_batches()

        def changes(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows - 1, bool)
            for k in (*keys, "pcol"):
                x = table.column(k).to_numpy(zero_copy_only=False)
                new |= x[1:] != x[:-1]
            return new

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            new = changes(table)
            cuts = np.flatnonzero(new)
            if cuts.size:  # whole columns go, the last one may go on
                yield from filled(table.slice(0, cuts[-1] + 1), new[: cuts[-1]])
                table = table.slice(cuts[-1] + 1)
            held = table
        if held is not None:
            yield from filled(held, changes(held))

    return dealt.mapInArrow(run, df.schema)


def _line_estimate(df: DataFrame, keys: tuple[str, ...], line: str, place: str, value: str, method: str, out: str) -> DataFrame:
    """``out``: each pixel's value by interpolation between the known ones around it in its line, NULL outside of them."""
    by = Window.partitionBy(*keys, line)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(place).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    until = lambda order, end: by.orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    ways = {"a": F.col(place), "b": F.desc(place)}
    marked = df.withColumns({f"__{w}2": F.last(point, True).over(until(o, -1)) for w, o in ways.items()})
    pair = lambda w: F.when(point.isNotNull(), F.struct(point.alias("p"), F.col(f"__{w}2").alias("q")))
    marked = marked.withColumns({f"__{w}": F.last(pair(w), True).over(until(o, 0)) for w, o in ways.items()})
    points = [F.col("__a.p"), F.col("__b.p")] + ([F.col("__a.q"), F.col("__b.q")] if method == "cubic" else [])
    used = F.filter(F.array(*points), lambda p: p.isNotNull())
    at = F.col(place).cast("double")
    part = lambda p: F.aggregate(used, F.lit(1.0), lambda s, q: F.when(q["x"] == p["x"], s).otherwise(s * (at - q["x"]) / F.nullif(p["x"] - q["x"], F.lit(0.0))))
    estimate = F.aggregate(used, F.lit(0.0), lambda s, p: s + p["y"] * part(p))
    inside = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col(value).isNull()
    return marked.withColumn(out, F.when(inside, estimate)).drop("__a", "__b", "__a2", "__b2")


def fill_interpolated(df: DataFrame, keys: tuple[str, ...], value: str = "v", method: str = "linear", keep: str | None = None) -> DataFrame:
    """NULL pixels take the mean of interpolations along their row and their column, where known pixels enclose them there.

    ``linear`` goes by the next known pixel on either side, ``cubic`` by the next two
    (the polynomial through those there are).  What is left takes the nearest value,
    as does everything in an image of fewer than four known pixels.  ``keep`` names
    a boolean column of background pixels that stay NULL.
    """
    if method not in ("linear", "cubic"):
        raise ValueError(f"unknown method {method!r}")
    known = df.groupBy(*keys).agg(F.count(value).alias("__known"))
    both = _line_estimate(df, keys, "prow", "pcol", value, method, "__e1")
    both = _line_estimate(both, keys, "pcol", "prow", value, method, "__e2").join(known, list(keys))
    mean = F.coalesce((F.col("__e1") + F.col("__e2")) / 2, "__e1", "__e2")
    stays = F.coalesce(F.col(keep), F.lit(False)) if keep else F.lit(False)
    both = both.withColumn("__e", F.when((F.col("__known") >= 4) & ~stays, mean)).drop("__e1", "__e2", "__known")
    out = fill_nearest(both, keys, value, keep)
    return out.select(*(F.coalesce("__e", c).cast(df.schema[c].dataType).alias(c) if c == value else c for c in df.columns))


def moran(df: DataFrame, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """Moran's I over eight neighbours: ``moran_i_ref`` (scaled by n / 8) and ``moran_i`` (by n / sum of weights).

    Masked (NULL) pixels count as zero deviations; cells beyond the raster are absent.
    """
    mean = df.groupBy(*keys).agg(F.avg(value).alias("__m"))
    z = df.join(mean, list(keys)).withColumn("z", F.coalesce(F.col(value) - F.col("__m"), F.lit(0.0))).select(*keys, "prow", "pcol", "z", F.col(value).isNotNull().cast("int").alias("ok"))
    row = Window.partitionBy(*keys, "prow").orderBy("pcol").rangeBetween(-1, 1)
    col = Window.partitionBy(*keys, "pcol").orderBy("prow").rangeBetween(-1, 1)
    # The sum over a 3 x 3 neighbourhood separates into sums along rows, then columns.
    lag = z.withColumn("__h", F.sum("z").over(row)).withColumn("__hn", F.sum("ok").over(row))
    lag = lag.withColumn("lag", F.sum("__h").over(col) - F.col("z")).withColumn("nb", F.sum("__hn").over(col) - F.col("ok"))
    out = lag.groupBy(*keys).agg(F.sum("ok").alias("n"), F.sum(F.col("z") * F.col("lag")).alias("cross"), F.sum(F.col("z") * F.col("z")).alias("square"), F.sum(F.col("nb") * F.col("ok")).alias("weights"))
    base = F.col("cross") / F.nullif(F.col("square"), F.lit(0.0))
    return out.select(*keys, (F.col("n") / 8 * base).alias("moran_i_ref"), (F.col("n") / F.nullif(F.col("weights"), F.lit(0)) * base).alias("moran_i"))


def grey_levels(df: DataFrame, keys: tuple[str, ...], value: str = "v", levels: int = 256) -> DataFrame:
    """Values scaled to integer levels between an image's extremes; NULL pixels have level zero, as has a constant image."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    scaled = F.floor((F.col(value) - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)) * (levels - 1))
    return df.join(ends, list(keys)).withColumn("level", F.coalesce(scaled, F.lit(0))).drop("__a", "__b")


def glcm(df: DataFrame, keys: tuple[str, ...], level: str = "level", least: int = 100) -> DataFrame:
    """Texture of right-hand neighbour pairs, counted both ways: the six properties of the co-occurrence matrix.

    An image with ``least`` or fewer pixels above level zero has none (NULL).  A
    constant image has contrast and dissimilarity 0, homogeneity, energy and ASM 1
    and no correlation.
    """
    w = Window.partitionBy(*keys, "prow").orderBy("pcol")
    seen = df.select(*keys, F.col(level).alias("a"), F.lead(level).over(w).alias("b"))
    # Besides both ways of a pair, a pixel above zero counts in the cell of -1.
    cell = lambda ok, i, j: F.when(ok, F.struct(i.cast("long").alias("i"), j.cast("long").alias("j")))
    a, b, pair = F.col("a"), F.col("b"), F.col("b").isNotNull()
    marked = F.array(cell(pair, a, b), cell(pair, b, a), cell(a > 0, F.lit(-1), F.lit(-1)))
    cells = seen.select(*keys, F.explode(marked).alias("x")).where("x is not null").groupBy(*keys, "x.i", "x.j").agg(F.count("*").cast("double").alias("n"))
    n, i, j = (F.when(F.col("i") >= 0, F.col(c)) for c in "nij")
    d = i - j
    total = F.sum(n)
    mean = F.sum(n * i) / total
    spread = F.sum(n * i * i) / total - mean * mean
    out = cells.groupBy(*keys).agg(
        (F.sum(n * d * d) / total).alias("contrast"), (F.sum(n * F.abs(d)) / total).alias("dissimilarity"), (F.sum(n / (1 + d * d)) / total).alias("homogeneity"),
        (F.sum(n * n) / total / total).alias("asm"), ((F.sum(n * i * j) / total - mean * mean) / F.when(F.abs(spread) > 1e-9, spread)).alias("correlation"),
        F.coalesce(F.sum(F.when(F.col("i") < 0, F.col("n"))), F.lit(0.0)).alias("__n"),
    ).withColumn("energy", F.sqrt("asm"))
    good = (F.col("__n") == 0) | (F.col("__n") > least)  # none above zero: constant
    names = ("contrast", "dissimilarity", "homogeneity", "asm", "energy", "correlation")
    return out.select(*keys, *(F.when(good, F.col(c)).alias(c) for c in names))


def otsu(df: DataFrame, keys: tuple[str, ...], value: str = "gcc", bins: int = 256, floor: float = 0.2) -> DataFrame:
    """``keys, threshold``: the first split of greatest between-class variance, no lower than ``floor``."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) * (bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    # Only split after filled bins matters, as empty ones change nothing and the first maximum wins.
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    h = hist.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("bin")).over(up)).withColumn("w", F.sum("n").over(all_)).withColumn("s", F.sum(F.col("n") * F.col("bin")).over(all_))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0))
    between = F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0))
    best = h.groupBy(*keys).agg(F.max(F.struct(F.round(between, 6).alias("b"), (-F.col("bin")).alias("t"))).alias("x"))
    return best.select(*keys, F.greatest(-F.col("x.t") / F.lit(float(bins - 1)), F.lit(floor)).alias("threshold"))
