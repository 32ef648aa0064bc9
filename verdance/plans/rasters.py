"""Resampling, texture, spectra and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import joins as J
from ..operators import raster as R
from ..sources.adapters import chips, mosaics, spectra
from .groups import _PX, green_pixels
from .registry import query, r6, r10

_BLOCKS = "blocks AS (SELECT *, prow // 3 AS brow, pcol // 3 AS bcol FROM chips WHERE prow // 3 < 2 AND pcol // 3 < 2)"
BY = ("image", "brow", "bcol")


def blocks(spark, sf_dir, *methods):
    out = R.resample(chips(spark, sf_dir), ("image",), 3, methods)
    return out.select(*BY, *(r10(m).alias(m) for m in methods))


@query("SELECT image, brow, bcol, round(avg(v), 10) AS average, round(sum(v), 10) AS sum FROM blocks GROUP BY ALL", "chips", _BLOCKS)
def resample_avg(spark, sf_dir):
    """Block means and sums; truncated output size."""
    return blocks(spark, sf_dir, "average", "sum")


@query("SELECT image, brow, bcol, round(min(v), 10) AS min, round(max(v), 10) AS max FROM blocks GROUP BY ALL", "chips", _BLOCKS)
def resample_minmax(spark, sf_dir):
    """Block extremes."""
    return blocks(spark, sf_dir, "min", "max")


@query("SELECT image, brow, bcol, round(quantile_cont(v, 0.25), 10) AS q1, round(quantile_cont(v, 0.5), 10) AS med, round(quantile_cont(v, 0.75), 10) AS q3 FROM blocks GROUP BY ALL", "chips", _BLOCKS)
def resample_quantiles(spark, sf_dir):
    """Block quartiles, linearly interpolated."""
    return blocks(spark, sf_dir, "q1", "med", "q3")


@query("SELECT image, brow, bcol, round(sqrt(avg(v * v)), 10) AS rms FROM blocks GROUP BY ALL", "chips", _BLOCKS)
def resample_rms(spark, sf_dir):
    """Block root mean squares."""
    return blocks(spark, sf_dir, "rms")


@query("SELECT image, brow, bcol, mode FROM (SELECT image, brow, bcol, q AS mode, row_number() OVER (PARTITION BY image, brow, bcol ORDER BY count(*) DESC, q) AS r FROM (SELECT image, brow, bcol, floor(v * 10) AS q FROM blocks) GROUP BY image, brow, bcol, q) WHERE r = 1", "chips", _BLOCKS)
def resample_mode(spark, sf_dir):
    """Most frequent class of a block, the least on ties."""
    c = chips(spark, sf_dir).withColumn("v", F.floor(F.col("v") * 10).cast("double"))
    return R.resample(c, ("image",), 3, ("mode",)).select(*BY, "mode")


@query("SELECT image, prow // 2 AS brow, pcol // 2 AS bcol, round(v, 10) AS v FROM chips WHERE prow % 2 = 1 AND pcol % 2 = 1", "chips")
def resample_nearest(spark, sf_dir):
    """The pixel at each block's centre."""
    return R.resample_kernel(chips(spark, sf_dir), ("image",), 2, "nearest").select(*BY, r10("v").alias("v"))


def _kernel_sql(weight: str, reach: int) -> str:
    """Weights of a kernel widened to the scale of two: ``$`` is the distance from a block's centre in blocks."""
    place = lambda b, p: f"(abs({b} * 2 + 0.5::DOUBLE - c.{p}) / 2)"
    return f"""SELECT image, b.brow, b.bcol, round(sum(wr * wc * v) / nullif(sum(wr * wc), 0), 8) AS v FROM (SELECT c.image, r.b AS brow, q.b AS bcol, c.v, {weight.replace('$', place('r.b', 'prow'))} AS wr, {weight.replace('$', place('q.b', 'pcol'))} AS wc
     FROM chips c JOIN (SELECT unnest(range(0, 4)) AS b) r ON {place('r.b', 'prow')} < {reach} JOIN (SELECT unnest(range(0, 4)) AS b) q ON {place('q.b', 'pcol')} < {reach}) b GROUP BY ALL"""


def _by_kernel(spark, sf_dir, method):
    return R.resample_kernel(chips(spark, sf_dir), ("image",), 2, method).select(*BY, r6("v", 8).alias("v"))


@query(_kernel_sql("1 - $", 1), "chips")
def resample_bilinear(spark, sf_dir):
    """Bilinear weights at block centres."""
    return _by_kernel(spark, sf_dir, "bilinear")


@query(_kernel_sql("CASE WHEN $ <= 1 THEN 1.5 * $ * $ * $ - 2.5 * $ * $ + 1 ELSE -0.5 * $ * $ * $ + 2.5 * $ * $ - 4 * $ + 2 END", 2), "chips")
def resample_cubic(spark, sf_dir):
    """Cubic convolution at block centres."""
    return _by_kernel(spark, sf_dir, "cubic")


@query(_kernel_sql("CASE WHEN $ <= 1 THEN (3 * $ * $ * $ - 6 * $ * $ + 4) / 6 ELSE (2 - $) * (2 - $) * (2 - $) / 6 END", 2), "chips")
def resample_cubic_spline(spark, sf_dir):
    """Cubic spline weights at block centres."""
    return _by_kernel(spark, sf_dir, "cubic_spline")


@query(_kernel_sql("sin(pi() * $) / (pi() * $) * sin(pi() * $ / 3) / (pi() * $ / 3)", 3), "chips")
def resample_lanczos(spark, sf_dir):
    """Lanczos weights at block centres."""
    return _by_kernel(spark, sf_dir, "lanczos")


#: Single holes, and in every third image a block of five by five.
_HOLE = "(pos * 7 + image) % 5 > 0 AND NOT (image % 3 = 0 AND prow BETWEEN 2 AND 6 AND pcol < 5)"
_HOLES = f"holed AS (SELECT image, prow, pcol, CASE WHEN {_HOLE} THEN v END AS v FROM chips)"
_NEAREST = "(SELECT first(n.v ORDER BY (n.prow - h.prow) * (n.prow - h.prow) + (n.pcol - h.pcol) * (n.pcol - h.pcol), n.prow, n.pcol) FROM holed n WHERE n.image = h.image AND n.v IS NOT NULL)"


def holed(spark, sf_dir):
    return chips(spark, sf_dir).select("image", "prow", "pcol", F.when(F.expr(_HOLE), F.col("v")).alias("v"))


@query(f"SELECT h.image, h.prow, h.pcol, round(coalesce(h.v, {_NEAREST}), 10) AS v FROM holed h", "chips", _HOLES)
def gapfill_nearest(spark, sf_dir):
    """Holes take the nearest value, however far."""
    return R.fill_nearest(holed(spark, sf_dir), ("image",)).select("image", "prow", "pcol", r10("v").alias("v"))


def _line_sql(line: str, place: str, points: int) -> str:
    """The hole's value by the polynomial through the next known pixels on either side of its line."""

    def polynomial(names: str) -> str:
        term = lambda p: " * ".join([f"{p}.y", *(f"(spot - {q}.x) / ({p}.x - {q}.x)" for q in names.split() if q != p)])
        return " + ".join(map(term, names.split()))

    known = f"SELECT *, lag({place}) OVER k AS px, lag(v) OVER k AS py, lead({place}) OVER k AS nx, lead(v) OVER k AS ny FROM holed WHERE v IS NOT NULL WINDOW k AS (PARTITION BY image, {line} ORDER BY {place})"
    point = lambda x, y: f"{{'x': CAST({x} AS DOUBLE), 'y': {y}}}"
    sides = f"""SELECT h.image, h.prow, h.pcol, h.{place}::DOUBLE AS spot, h.v,
      last_value(CASE WHEN k.v IS NOT NULL THEN {{'p': {point('k.' + place, 'k.v')}, 'q': CASE WHEN k.px IS NOT NULL THEN {point('k.px', 'k.py')} END}} END IGNORE NULLS) OVER (PARTITION BY h.image, h.{line} ORDER BY h.{place}) AS l,
      last_value(CASE WHEN k.v IS NOT NULL THEN {{'p': {point('k.' + place, 'k.v')}, 'q': CASE WHEN k.nx IS NOT NULL THEN {point('k.nx', 'k.ny')} END}} END IGNORE NULLS) OVER (PARTITION BY h.image, h.{line} ORDER BY h.{place} DESC) AS r
      FROM holed h LEFT JOIN ({known}) k ON h.image = k.image AND h.prow = k.prow AND h.pcol = k.pcol"""
    named = f"SELECT image, prow, pcol, spot, l.p AS a, l.q AS c, r.p AS b, r.q AS d FROM ({sides}) WHERE v IS NULL AND l IS NOT NULL AND r IS NOT NULL"
    if points == 2:
        value = polynomial("a b")
    else:
        value = f"CASE WHEN c IS NULL AND d IS NULL THEN {polynomial('a b')} WHEN c IS NULL THEN {polynomial('a b d')} WHEN d IS NULL THEN {polynomial('a b c')} ELSE {polynomial('a b c d')} END"
    return f"SELECT image, prow, pcol, {value} AS e FROM ({named})"


def _interpolation_sql(points: int) -> str:
    return f"""SELECT h.image, h.prow, h.pcol, round(coalesce(h.v, CASE WHEN (SELECT count(n.v) FROM holed n WHERE n.image = h.image) >= 4 THEN coalesce((x.e + y.e) / 2, x.e, y.e) END, {_NEAREST}), 8) AS v FROM holed h
     LEFT JOIN ({_line_sql('prow', 'pcol', points)}) x ON h.image = x.image AND h.prow = x.prow AND h.pcol = x.pcol LEFT JOIN ({_line_sql('pcol', 'prow', points)}) y ON h.image = y.image AND h.prow = y.prow AND h.pcol = y.pcol"""


@query(_interpolation_sql(2), "chips", _HOLES)
def gapfill_linear(spark, sf_dir):
    """Holes filled by linear interpolation along rows and columns."""
    return R.fill_interpolated(holed(spark, sf_dir), ("image",), method="linear").select("image", "prow", "pcol", r6("v", 8).alias("v"))


@query(_interpolation_sql(4), "chips", _HOLES)
def gapfill_cubic(spark, sf_dir):
    """Holes filled by cubics along rows and columns."""
    return R.fill_interpolated(holed(spark, sf_dir), ("image",), method="cubic").select("image", "prow", "pcol", r6("v", 8).alias("v"))


_SIZES = "sized AS (SELECT 8 AS side, image, prow, pcol, v FROM chips UNION ALL SELECT 16, image, prow, pcol, v FROM mosaics)"
_LEVELS = _SIZES + """, lv AS (SELECT side, image, prow, pcol, CASE WHEN b > a AND v IS NOT NULL THEN CAST(floor((v - a) / (b - a) * 255) AS BIGINT) ELSE 0 END AS level FROM
  (SELECT *, min(v) OVER (PARTITION BY side, image) AS a, max(v) OVER (PARTITION BY side, image) AS b FROM sized)),
 right_of AS (SELECT a.side, a.image, a.level AS i, b.level AS j FROM lv a JOIN lv b ON a.side = b.side AND a.image = b.image AND a.prow = b.prow AND b.pcol = a.pcol + 1),
 enough AS (SELECT side, image, count(*) FILTER (level > 0) AS above FROM lv GROUP BY ALL)"""
_TEXTURES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")


@query(
    f"""SELECT e.side, e.image, {', '.join(f'CASE WHEN above = 0 OR above > 100 THEN {c} END AS {c}' for c in _TEXTURES)} FROM enough e LEFT JOIN
    (SELECT side, image, round(contrast, 9) AS contrast, round(dissimilarity, 9) AS dissimilarity, round(homogeneity, 9) AS homogeneity, round(sqrt(asm_), 9) AS energy, round((ij - m * m) / nullif(ii - m * m, 0), 9) AS correlation, round(asm_, 9) AS asm FROM
    (SELECT side, image, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm_, sum(p * i) AS m, sum(p * i * i) AS ii, sum(p * i * j) AS ij FROM
     (SELECT side, image, i, j, count(*) / sum(count(*)) OVER (PARTITION BY side, image) AS p FROM (SELECT * FROM right_of UNION ALL SELECT side, image, j, i FROM right_of) GROUP BY side, image, i, j) GROUP BY side, image)) t ON e.side = t.side AND e.image = t.image""",
    "chips mosaics", _LEVELS,
)
def glcm_props(spark, sf_dir):
    """Co-occurrence texture of chips (too small for any) and of mosaics."""
    sized = [df(spark, sf_dir).select(F.lit(side).alias("side"), "image", "prow", "pcol", "v") for side, df in ((8, chips), (16, mosaics))]
    out = R.glcm(R.grey_levels(sized[0].unionByName(sized[1]), ("side", "image")), ("side", "image"))
    return out.select("side", "image", *(r6(c, 9).alias(c) for c in _TEXTURES))


@query(
    """SELECT image, round(n / 8.0::DOUBLE * cross_ / sq, 6) AS moran_i_ref, round(n / w * cross_ / sq, 6) AS moran_i FROM (SELECT a.image, 64.0::DOUBLE AS n, sum(a.z * b.z) AS cross_, max(a.sq) AS sq, count(*) AS w FROM zz a JOIN zz b ON a.image = b.image AND abs(a.prow - b.prow) <= 1 AND abs(a.pcol - b.pcol) <= 1 AND (a.prow <> b.prow OR a.pcol <> b.pcol) GROUP BY a.image)""",
    "chips", "zz AS (SELECT *, sum(z * z) OVER (PARTITION BY image) AS sq FROM (SELECT image, prow, pcol, v - avg(v) OVER (PARTITION BY image) AS z FROM chips))",
)
def moran_i(spark, sf_dir):
    """Spatial autocorrelation of each chip in two normalisations."""
    return R.moran(chips(spark, sf_dir), ("image",)).select("image", r6("moran_i_ref").alias("moran_i_ref"), r6("moran_i").alias("moran_i"))


_PROF = """prof AS (SELECT cls, list(m ORDER BY pos) AS u FROM (SELECT cls, pos, avg(v) AS m FROM chips GROUP BY cls, pos) GROUP BY cls),
 ang AS (SELECT a.cls AS cls_a, b.cls AS cls_b, coalesce(degrees(acos(greatest(-1, least(1, list_dot_product(a.u, b.u) / nullif(sqrt(list_dot_product(a.u, a.u)) * sqrt(list_dot_product(b.u, b.u)), 0))))), 90) AS angle FROM prof a JOIN prof b ON a.cls < b.cls)"""


def class_angles(spark, sf_dir):
    """Angles between the mean spectra of classes: as many rows as pairs of classes."""
    means = spectra(spark, sf_dir).select("cls", F.posexplode("bands")).groupBy("cls", "pos").agg(F.avg("col").alias("m"))
    prof = means.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("u"))
    return J.unordered_pairs(prof, "cls").select("cls_a", "cls_b", B.spectral_angle(F.col("u_a"), F.col("u_b")).alias("angle"))


@query("SELECT cls_a, cls_b, round(angle, 5) AS angle, row_number() OVER (ORDER BY round(angle, 5), cls_a, cls_b)::INT AS place FROM ang", "chips", _PROF)
def sam_pairs(spark, sf_dir):
    """Spectral angles of all pairs of classes, in order."""
    from pyspark.sql import Window

    out = class_angles(spark, sf_dir).withColumn("angle", F.round("angle", 5))
    return out.withColumn("place", F.row_number().over(Window.orderBy("angle", "cls_a", "cls_b")))


@query("SELECT cls_a, cls_b, round(angle, 5) AS angle FROM ang UNION ALL SELECT cls_b, cls_a, round(angle, 5) FROM ang UNION ALL SELECT cls, cls, 0.0::DOUBLE FROM prof", "chips", _PROF)
def sam_matrix(spark, sf_dir):
    """The full symmetric matrix of angles."""
    half = class_angles(spark, sf_dir).withColumn("angle", F.round("angle", 5))
    other = half.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b"), "angle")
    same = spectra(spark, sf_dir).select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(0.0).alias("angle")).distinct()
    return half.unionByName(other).unionByName(same)


#: Places of a chip: the bands of a profile.
_PLACES = range(64)


@query(f"SELECT cls, {', '.join(f'round(avg(v) FILTER (pos = {i}), 6) AS b{i}' for i in _PLACES)} FROM chips GROUP BY cls", "chips")
def pivot_profiles(spark, sf_dir):
    """Means of all bands as columns."""
    wide = chips(spark, sf_dir).groupBy("cls").pivot("pos", list(_PLACES)).agg(F.avg("v"))
    return wide.select("cls", *(r6(str(i)).alias(f"b{i}") for i in _PLACES))


@query(
    """SELECT image, round(greatest(arg_max(bin, (round(b, 6), -bin)) / 255.0::DOUBLE, 0.2), 6) AS threshold FROM (SELECT image, bin, coalesce(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), 0) AS b FROM
     (SELECT image, bin, sum(n) OVER u AS w0, sum(n * bin) OVER u AS s0, sum(n) OVER (PARTITION BY image) AS w, sum(n * bin) OVER (PARTITION BY image) AS s FROM (SELECT image, CAST(floor(gcc * 255) AS BIGINT) AS bin, count(*) AS n FROM px WHERE gcc IS NOT NULL GROUP BY ALL) WINDOW u AS (PARTITION BY image ORDER BY bin))) GROUP BY image""",
    "chips", _PX,
)
def otsu_threshold(spark, sf_dir):
    """Otsu's threshold of each image."""
    return R.otsu(green_pixels(spark, sf_dir), ("image",)).select("image", r6("threshold").alias("threshold"))
