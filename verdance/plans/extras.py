"""Smaller operations: cloud filters, crops, composites, labels, projections, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import raster as R
from ..sources.adapters import camera, chips, mosaics, scenes, series
from .registry import query, r6, r10


@query("SELECT scene, part, round(CAST(floor(nir * 10000) AS BIGINT) / 10000.0::DOUBLE, 8) AS nir, round(CAST(floor(green * 10000) AS BIGINT) / 10000.0::DOUBLE, 8) AS green FROM scenes WHERE fmask / 15.0::DOUBLE >= 0.6 AND CAST(floor(blue * 27.5) AS BIGINT) NOT IN (3, 8, 9, 10)", "scenes")
def s2_cloud_filter(spark, sf_dir):
    """Digital numbers scaled, of pixels with a clear-sky score above a limit and no class of shadow, cloud or cirrus."""
    s = scenes(spark, sf_dir)
    # The test tables hold neither: digital numbers, the score and the class are made from other columns first.
    s = s.select("scene", "part", *(F.floor(F.col(c) * 10000).alias(c) for c in ("nir", "green")), (F.col("fmask") / 15.0).alias("cs"), F.floor(F.col("blue") * 27.5).alias("scl"))
    clear = s.where((F.col("cs") >= 0.6) & ~F.col("scl").isin(3, 8, 9, 10))
    return clear.select("scene", "part", *(r6(F.col(c) / 10000, 8).alias(c) for c in ("nir", "green")))


@query("SELECT image, prow, pcol, round(v, 10) AS v FROM chips c JOIN (SELECT image AS i, CAST(trunc(avg(prow)) AS BIGINT) AS mr, CAST(trunc(avg(pcol)) AS BIGINT) AS mc FROM chips WHERE v > 0.1 GROUP BY image) m ON c.image = m.i WHERE prow BETWEEN mr - 2 AND mr + 1 AND pcol BETWEEN mc - 2 AND mc + 1", "chips")
def central_crop(spark, sf_dir):
    """A window around the centre of each image's valid pixels."""
    c = chips(spark, sf_dir)
    mid = c.where("v > 0.1").groupBy("image").agg(F.avg("prow").cast("long").alias("mr"), F.avg("pcol").cast("long").alias("mc"))
    inside = F.col("prow").between(F.col("mr") - 2, F.col("mr") + 1) & F.col("pcol").between(F.col("mc") - 2, F.col("mc") + 1)
    return c.join(mid, "image").where(inside).select("image", "prow", "pcol", r10("v").alias("v"))


@query("SELECT vec_id AS image, (i - 1) // 8 AS prow, (i - 1) % 8 AS pcol FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] > 0.2")
def mask_coordinates(spark, sf_dir):
    """Coordinates of the pixels of a mask, from arrays."""
    flat = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image"), F.posexplode(F.transform("embedding", lambda x: x > 0.2)))
    return flat.where("col").select("image", F.floor(F.col("pos") / 8).alias("prow"), (F.col("pos") % 8).cast("long").alias("pcol"))


@query("SELECT DISTINCT strftime(day, '%Y-%m') AS label, printf('%02d', month(day)) || '/' || CAST(year(day) AS VARCHAR) AS short FROM series", "series")
def format_labels(spark, sf_dir):
    """Padded numbers in labels."""
    return series(spark, sf_dir).select(F.date_format("day", "yyyy-MM").alias("label"), F.format_string("%02d/%d", F.month("day"), F.year("day")).alias("short")).distinct()


@query("SELECT prow, pcol, round(avg(green), 8) AS green, round(avg(nir), 8) AS nir FROM scenes WHERE day >= DATE '1998-06-01' AND day < DATE '1998-07-01' AND (fmask & 14) = 0 GROUP BY prow, pcol", "scenes")
def composite_mean(spark, sf_dir):
    """Mean composite of a period's clear pixels."""
    s = scenes(spark, sf_dir).where((F.col("day") >= "1998-06-01") & (F.col("day") < "1998-07-01") & B.bits_clear(F.col("fmask"), 14))
    return s.groupBy("prow", "pcol").agg(r6(F.avg("green"), 8).alias("green"), r6(F.avg("nir"), 8).alias("nir"))


@query("SELECT day, round(avg(green), 8) AS green, count(*) AS n FROM scenes WHERE prow BETWEEN 1 AND 2 AND pcol BETWEEN 3 AND 6 GROUP BY day", "scenes")
def region_mean(spark, sf_dir):
    """Mean over a region, by day."""
    s = scenes(spark, sf_dir).where(F.col("prow").between(1, 2) & F.col("pcol").between(3, 6))
    return s.groupBy("day").agg(r6(F.avg("green"), 8).alias("green"), F.count("*").alias("n"))


_UTM = """p AS (SELECT obs, radians(value * 6 + 18 - 21) AS d, sin(radians(60 + value * 10)) AS s FROM series),
 q AS (SELECT obs, d, sinh(atanh(s) - 0.08181919084262149 * atanh(0.08181919084262149 * s)) AS t FROM p),
 w AS (SELECT obs, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM q)"""


@query(
    """SELECT obs, round(6364902.166165087 * (eta + 0.0008377318188192541 * cos(2 * xi) * sinh(2 * eta) + 7.608496958699166e-07 * cos(4 * xi) * sinh(4 * eta) + 1.2034877875966646e-09 * cos(6 * xi) * sinh(6 * eta)) + 500000, 2) AS east,
    round(6364902.166165087 * (xi + 0.0008377318188192541 * sin(2 * xi) * cosh(2 * eta) + 7.608496958699166e-07 * sin(4 * xi) * cosh(4 * eta) + 1.2034877875966646e-09 * sin(6 * xi) * cosh(6 * eta)), 2) AS north FROM w""",
    "series", _UTM,
)
def utm_project(spark, sf_dir):
    """Points projected to a metric grid."""
    east, north = B.utm(F.col("value") * 6 + 18, 60 + F.col("value") * 10)
    return series(spark, sf_dir).select("obs", F.round(east, 2).alias("east"), F.round(north, 2).alias("north"))


#: Metres of the sweep's targets; its pixels are as fine as the first.
TARGETS = (0.1, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 15.0, 20.0, 30.0)
SWEEP = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "max", "min", "med", "q1", "q3", "sum", "rms")


def _sweep_sql() -> str:
    aggregates = {
        "average": "avg(v)", "max": "max(v)", "min": "min(v)", "med": "quantile_cont(v, 0.5)", "q1": "quantile_cont(v, 0.25)", "q3": "quantile_cont(v, 0.75)", "sum": "sum(v)", "rms": "sqrt(avg(v * v))",
    }
    kernels = {
        "bilinear": (1, "1 - $"),
        "cubic": (2, "CASE WHEN $ <= 1 THEN 1.5 * pow($, 3) - 2.5 * pow($, 2) + 1 ELSE -0.5 * pow($, 3) + 2.5 * pow($, 2) - 4 * $ + 2 END"),
        "cubic_spline": (2, "CASE WHEN $ <= 1 THEN (3 * pow($, 3) - 6 * pow($, 2) + 4) / 6 ELSE pow(2 - $, 3) / 6 END"),
        "lanczos": (3, "CASE WHEN $ = 0 THEN 1 ELSE sin(pi() * $) / (pi() * $) * sin(pi() * $ / 3) / (pi() * $ / 3) END"),
    }
    names = ", ".join(f"'{m}'" for m in SWEEP)
    parts = [f"SELECT image, 0.1::DOUBLE AS resolution, unnest([{names}]) AS method, prow AS brow, pcol AS bcol, v FROM mosaics"]
    parts += [f"SELECT image, resolution, '{m}', CAST(floor(prow / s) AS BIGINT) AS brow, CAST(floor(pcol / s) AS BIGINT) AS bcol, {f} FROM src WHERE floor(prow / s) < side AND floor(pcol / s) < side GROUP BY ALL" for m, f in aggregates.items()]
    parts.append("SELECT image, resolution, 'nearest', r.b, q.b, v FROM src JOIN b r ON r.b < side AND floor((r.b + 0.5) * s) = prow JOIN b q ON q.b < side AND floor((q.b + 0.5) * s) = pcol")
    for m, (reach, weight) in kernels.items():
        away = lambda b, p: f"(abs(({b} + 0.5) * s - 0.5 - {p}) / s)"  # noqa: B023, E731
        wr, wc = weight.replace("$", away("r.b", "prow")), weight.replace("$", away("q.b", "pcol"))
        parts.append(f"SELECT image, resolution, '{m}', r.b AS brow, q.b AS bcol, sum(({wr}) * ({wc}) * v) / sum(({wr}) * ({wc})) FROM src JOIN b r ON r.b < side AND {away('r.b', 'prow')} < {reach} JOIN b q ON q.b < side AND {away('q.b', 'pcol')} < {reach} GROUP BY image, resolution, r.b, q.b")
    return f"SELECT image, resolution, method, brow, bcol, round(v, 8) AS v FROM ({' UNION ALL '.join(parts)})"


_SRC = f"src AS (SELECT image, prow, pcol, v, t AS resolution, t / 0.1::DOUBLE AS s, floor(16 / (t / 0.1::DOUBLE)) AS side FROM mosaics, (SELECT unnest([{', '.join(map(str, TARGETS[1:]))}]::DOUBLE[]) AS t)), b AS (SELECT unnest(range(0, 16)) AS b)"


@query(_sweep_sql(), "mosaics", _SRC)
def resample_sweep(spark, sf_dir):
    """Ten resolutions by thirteen methods in one table."""
    out = R.sweep(mosaics(spark, sf_dir), ("image",), TARGETS[0], TARGETS, SWEEP, extent=(16, 16))
    return out.select("image", "resolution", "method", "brow", "bcol", r6("v", 8).alias("v"))


@query("SELECT CAST(dayofyear(day) AS BIGINT) AS doy, imgroup, round(avg(green_ratio), 10) AS mean, round(avg(green_ratio) - stddev_samp(green_ratio), 8) AS low, round(avg(green_ratio) + stddev_samp(green_ratio), 8) AS high FROM camera GROUP BY 1, 2", "camera")
def line_summary(spark, sf_dir):
    """What a line plot draws: mean by abscissa and hue with a deviation band."""
    mean, std = F.avg("green_ratio"), F.stddev_samp("green_ratio")
    by = camera(spark, sf_dir).groupBy(F.dayofyear("day").cast("long").alias("doy"), "imgroup")
    return by.agg(r10(mean).alias("mean"), r6(mean - std, 8).alias("low"), r6(mean + std, 8).alias("high"))


@query("SELECT s.scene, s.part, round(s.green, 10) AS green, round(c.cs, 10) AS cs FROM scenes s JOIN (SELECT scene, max(red) AS cs FROM scenes GROUP BY scene) c ON s.scene = c.scene WHERE c.cs >= 0.4", "scenes")
def link_cloud_score(spark, sf_dir):
    """Scenes linked to a score table by their index and filtered on it."""
    s = scenes(spark, sf_dir)
    score = s.groupBy("scene").agg(F.max("red").alias("cs"))
    return s.join(score, "scene").where("cs >= 0.4").select("scene", "part", r10("green").alias("green"), r10("cs").alias("cs"))


@query("SELECT scene, CAST(epoch_ms(ts) AS BIGINT) AS date, round(avg(red), 10) AS absorbing_index FROM scenes WHERE day >= DATE '1996-01-01' AND day < DATE '2000-01-01' AND prow = 2 AND pcol = 4 GROUP BY scene, ts", "scenes")
def atmosphere_point(spark, sf_dir):
    """One band of a collection at a point, per image with its time in epoch milliseconds."""
    s = scenes(spark, sf_dir).where((F.col("day") >= "1996-01-01") & (F.col("day") < "2000-01-01") & (F.col("prow") == 2) & (F.col("pcol") == 4))
    return s.groupBy("scene", "ts").agg(r10(F.avg("red")).alias("absorbing_index")).select("scene", B.utc_millis(F.col("ts")).alias("date"), "absorbing_index")


@query("SELECT prow, pcol, CAST(epoch_ms(s.ts) AS BIGINT) AS date, s.scene AS scene, s.part AS part FROM (SELECT prow, pcol, arg_min({'ts': ts, 'scene': scene, 'part': part}, (ts, scene, part)) AS s FROM scenes GROUP BY prow, pcol)", "scenes")
def first_observation(spark, sf_dir):
    """The first image of each pixel."""
    first = F.min(F.struct("ts", "scene", "part")).alias("s")
    return scenes(spark, sf_dir).groupBy("prow", "pcol").agg(first).select("prow", "pcol", B.utc_millis(F.col("s.ts")).alias("date"), "s.scene", "s.part")


@query("SELECT prow, pcol, max(low) = 0 AS masked FROM (SELECT prow, pcol, CASE WHEN green < 0.03 AND red < 0.05 THEN 1 ELSE 0 END AS low FROM scenes) GROUP BY prow, pcol", "scenes")
def never_reached_mask(spark, sf_dir):
    """A mask of the pixels whose greatest extent is zero."""
    low = F.when((F.col("green") < 0.03) & (F.col("red") < 0.05), 1).otherwise(0)
    return scenes(spark, sf_dir).groupBy("prow", "pcol").agg((F.max(low) == 0).alias("masked"))


@query("SELECT scene, part, prow, pcol, CASE WHEN water <> 0 THEN round(green, 8) END AS green, CASE WHEN water <> 0 THEN round(nir, 8) END AS nir FROM (SELECT *, CASE WHEN (prow * 10 + pcol) % 7 = 0 THEN 0 ELSE 1 END AS water FROM scenes) WHERE day = DATE '1998-06-10'", "scenes")
def band_preview(spark, sf_dir):
    """Some bands of one day, water blanked."""
    s = scenes(spark, sf_dir).where(F.col("day") == F.lit("1998-06-10").cast("date"))
    land = (F.col("prow") * 10 + F.col("pcol")) % 7 != 0
    return s.select("scene", "part", "prow", "pcol", *(F.when(land, r6(F.col(c), 8)).alias(c) for c in ("green", "nir")))
