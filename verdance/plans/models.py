"""Models, clustering, sampling and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import cluster as C
from ..operators import harmonic as H
from ..operators import imagery as I
from ..operators import stats as S
from ..operators.breaks import break_stats
from ..sources.adapters import broken_series, camera, chips, meadows, series
from ..streaming.daily import run_batchwise
from .registry import query, r6, r10
from .scans import _RGB, rgb

_YEARS = "year(day) + (dayofyear(day) - 1.0::DOUBLE) / dayofyear(make_date(year(day), 12, 31))"


def site_series(spark, sf_dir):
    s = series(spark, sf_dir)
    daily = s.groupBy("site", "day").agg(F.avg("value").alias("value"))
    return daily.withColumn("t", B.fractional_year(F.col("day")))


#: Sums of products of the eight terms (times count from the first year) and their solution by elimination, one term a step.
_SYSTEM = f"""daily AS (SELECT site, {_YEARS} AS t, avg(value) AS y FROM series GROUP BY site, day), start AS (SELECT floor(min(t)) AS t0 FROM daily),
 terms AS (SELECT site, t, y, [1.0::DOUBLE, t - t0, cos(2 * pi() * t), sin(2 * pi() * t), cos(4 * pi() * t), sin(4 * pi() * t), cos(6 * pi() * t), sin(6 * pi() * t), y] AS b FROM daily, start),
 m AS (SELECT site, i, j, sum(b[i] * b[j]) AS v FROM terms, (SELECT unnest(range(1, 9)) AS i), (SELECT unnest(range(1, 10)) AS j) GROUP BY site, i, j)"""
_ELIMINATED = _SYSTEM + """, el AS (SELECT 0 AS k, site, i, j, v FROM m UNION ALL
  SELECT k + 1, site, i, j, CASE WHEN i = k + 1 THEN v / head ELSE v - col * (line / head) END FROM
   (SELECT *, max(v) FILTER (i = k + 1 AND j = k + 1) OVER (PARTITION BY site) AS head, max(v) FILTER (j = k + 1) OVER (PARTITION BY site, i) AS col, max(v) FILTER (i = k + 1) OVER (PARTITION BY site, j) AS line FROM el WHERE k < 8)),
 solved AS (SELECT site, list(v ORDER BY i) AS c FROM el WHERE k = 8 AND j = 9 GROUP BY site)"""
_FITTED = """SELECT f.site, count(*) AS n, round(any_value(c[1] - c[2] * t0), 5) AS c0, {places}, round(sqrt(avg(pow(y - list_dot_product(c, b[1:8]), 2))), 6) AS rmse
 FROM {table} f JOIN terms d ON f.site = d.site, start GROUP BY f.site"""
_PLACES = ", ".join(f"round(any_value(c[{i + 1}]), 6) AS c{i}" for i in range(1, 8))


def fitted(spark, sf_dir, penalty):
    out = H.harmonic_fit(site_series(spark, sf_dir), ("site",), penalty=penalty)
    return out.select("site", "n", *(r6(F.col("coefs")[i], 6 if i else 5).alias(f"c{i}") for i in range(8)), r6("rmse").alias("rmse"))


@query(_FITTED.format(table="solved", places=_PLACES), "series", _ELIMINATED, recursive=True)
def harmonic_fit(spark, sf_dir):
    """Eight coefficients of each site's series by least squares."""
    return fitted(spark, sf_dir, 0.0)


#: Coordinate descent on scaled terms, one coordinate a step.
_DESCENT = _SYSTEM + """, size AS (SELECT site, count(*) AS n FROM daily GROUP BY site), mean AS (SELECT m.site, j, v / n AS a FROM m JOIN size USING (site) WHERE i = 1),
 dev AS (SELECT m.site, m.i, sqrt(v / n - a * a) AS s FROM m JOIN size USING (site) JOIN mean ON mean.site = m.site AND mean.j = m.i WHERE m.i = m.j AND m.i > 1),
 scaled AS (SELECT m.site, m.i, m.j, (v / n - p.a * q.a) / d.s / coalesce(e.s, 1) AS z FROM m JOIN size USING (site) JOIN mean p ON p.site = m.site AND p.j = m.i JOIN mean q ON q.site = m.site AND q.j = m.j
   JOIN dev d ON d.site = m.site AND d.i = m.i LEFT JOIN dev e ON e.site = m.site AND e.i = m.j WHERE m.i > 1 AND m.j > 1),
 gram AS (SELECT site, list(line ORDER BY i) AS g, list(goal ORDER BY i) AS r FROM (SELECT site, i, list(z ORDER BY j) FILTER (j < 9) AS line, max(z) FILTER (j = 9) AS goal FROM scaled GROUP BY site, i) GROUP BY site),
 walk AS (SELECT 0 AS step, site, g, r, [0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS w FROM gram UNION ALL
  SELECT step + 1, site, g, r, w[1:j - 1] || [sign(x) * greatest(abs(x) - 0.002, 0) / g[j][j]] || w[j + 1:] FROM
   (SELECT *, step % 7 + 1 AS j, r[step % 7 + 1] - list_dot_product(g[step % 7 + 1], w) + g[step % 7 + 1][step % 7 + 1] * w[step % 7 + 1] AS x FROM walk WHERE step < 7 * 60)),
 slopes AS (SELECT site, i + 1 AS i, w[i] AS w FROM walk, (SELECT unnest(range(1, 8)) AS i) WHERE step = 7 * 60),
 whole AS (SELECT site, list(w / s ORDER BY i) AS c, sum(w / s * a) AS off FROM slopes JOIN dev USING (site, i) JOIN mean ON mean.site = slopes.site AND mean.j = slopes.i GROUP BY slopes.site),
 lasso AS (SELECT w.site, [a - off] || c AS c FROM whole w JOIN mean ON mean.site = w.site AND j = 9)"""


@query(_FITTED.format(table="lasso", places=_PLACES), "series", _DESCENT, recursive=True)
def harmonic_fit_lasso(spark, sf_dir):
    """The same under an absolute penalty."""
    return fitted(spark, sf_dir, 0.002)


#: The planted breaks: the days of a site's series before and from its own day on.
_BROKEN = f"""daily AS (SELECT DISTINCT site, day, {_YEARS} AS t, site % 4 <> 3 AND date_diff('day', DATE '1997-01-01', day) >= site * 20 AS risen FROM series),
 parts AS (SELECT site, risen, min(t) AS t_start, max(t) AS t_end, count(*) AS n FROM daily GROUP BY site, risen)"""


@query(
    "SELECT site, row_number() OVER (PARTITION BY site ORDER BY t_start) AS segment, round(t_start, 8) AS t_start, round(t_end, 8) AS t_end, round(lead(t_start) OVER (PARTITION BY site ORDER BY t_start), 8) AS t_break FROM parts", "series", _BROKEN
)
def ccdc_segments(spark, sf_dir):
    """Stable segments and breaks of each site's series, whose breaks are planted."""
    out = H.ccdc(broken_series(spark, sf_dir), ("site",))
    return out.select("site", "segment", *(r6(c, 8).alias(c) for c in ("t_start", "t_end", "t_break")))


@query("SELECT site, 1::BIGINT AS n_breaks, round(t_start, 8) AS first_break, round(t_start, 8) AS last_break, 0.2::DOUBLE AS max_magnitude, round(t_start, 8) AS max_break FROM parts WHERE risen", "series", _BROKEN)
def ccdc_break_stats(spark, sf_dir):
    """Breaks of the segments found: count, first, last, greatest."""
    seg = H.ccdc(broken_series(spark, sf_dir), ("site",)).where("t_break is not null")
    arrays = seg.groupBy("site").agg(F.collect_list(F.struct("t_break", "prob", "magnitude")).alias("segments"))
    out = break_stats(arrays, ("site",), low=1990.0, high=2100.0)
    return out.select("site", F.col("n_breaks").cast("long").alias("n_breaks"), *(r6(c, p).alias(c) for c, p in (("first_break", 8), ("last_break", 8), ("max_magnitude", 1), ("max_break", 8))))


#: The kinds of green that a method should tell apart, by brightness, by hue or by size.
_FIRST = {"kmeans": "kind = 1", "gmm": "kind = 2", "dbscan": "kind = CASE WHEN lights > darks THEN 2 ELSE 1 END", "spectral": "kind = 1"}


def _class_sql(method: str) -> str:
    metrics = lambda part, of: ", ".join(
        [f"round(count(*) FILTER ({of}) / count(*), 6) AS {part}_ratio", *(f"round({f}(gcc) FILTER ({of}), 6) AS {part}_{m}" for m, f in (("mean", "avg"), ("std", "stddev_pop"), ("norm", "avg")))]
    )
    first = _FIRST[method]
    return f"""SELECT image, {metrics('green', 'kind > 0')}, {metrics('class1', f'kind > 0 AND ({first})')}, {metrics('class2', f'kind > 0 AND NOT ({first})')}, '{method}' AS method FROM
    (SELECT *, g * 1.0::DOUBLE / (r + g + b) AS gcc, count(*) FILTER (kind = 1) OVER (PARTITION BY image) AS darks, count(*) FILTER (kind = 2) OVER (PARTITION BY image) AS lights FROM meadows) GROUP BY image"""


def _classes(method):
    def run(spark, sf_dir):
        out = C.vegetation_classes(meadows(spark, sf_dir), method)
        return out.select("image", *(r6(f"{part}_{m}").alias(f"{part}_{m}") for part in ("green", "class1", "class2") for m in ("ratio", "mean", "std", "norm")), "method")

    run.__name__ = f"{method}_classes"
    run.__doc__ = f"Green ratio and two classes of each image by {method}."
    return query(_class_sql(method), "mosaics meadows")(run)


kmeans_classes, gmm_classes, dbscan_classes, spectral_classes = map(_classes, C.METHODS)


@query(
    """SELECT image, round(low + 0.6 * (high - low), 6) AS threshold FROM (SELECT image, first(low ORDER BY round(gain, 9) DESC, x) AS low, first(high ORDER BY round(gain, 9) DESC, x) AS high FROM
    (SELECT image, x, s0 / n0 AS low, CASE WHEN na > n0 THEN (sa - s0) / (na - n0) ELSE s0 / n0 END AS high, s0 * s0 / n0 + CASE WHEN na > n0 THEN (sa - s0) * (sa - s0) / (na - n0) ELSE 0 END AS gain FROM
      (SELECT image, x, sum(n) OVER u AS n0, sum(n * x) OVER u AS s0, sum(n) OVER (PARTITION BY image) AS na, sum(n * x) OVER (PARTITION BY image) AS sa FROM
        (SELECT image, g / (r + g + b + 1e-10) AS x, count(*) AS n FROM rgb GROUP BY ALL) WINDOW u AS (PARTITION BY image ORDER BY x))) GROUP BY image)""",
    "chips", _RGB,
)
def kmeans_threshold(spark, sf_dir):
    """Threshold between the two centres of each image's green shares."""
    return C.kmeans_threshold(rgb(spark, sf_dir)).select("image", r6("threshold").alias("threshold"))


@query()
def frame_detection(spark, sf_dir):
    """Bounding box of the strongest edges of each image (limits scaled to the chips' size)."""
    return I.frames(rgb(spark, sf_dir), least=2, inset=0)


@query("SELECT day, imgroup, round(avg(green_ratio), 6) AS green_ratio, count(*) AS n FROM camera GROUP BY day, imgroup", "camera")
def stream_daily_mean(spark, sf_dir):
    """Daily means by Structured Streaming, once through all there is."""
    return run_batchwise(spark, f"{sf_dir}/events.parquet").select("day", "imgroup", r6("green_ratio").alias("green_ratio"), "n")


@query("SELECT image, green_ratio FROM (SELECT image, round(green_ratio, 6) AS green_ratio, row_number() OVER (ORDER BY green_ratio DESC, image) AS r FROM camera) WHERE r <= 100", "camera")
def top_images(spark, sf_dir):
    """The hundred greenest images."""
    top = camera(spark, sf_dir).orderBy(F.desc("green_ratio"), "image").limit(100)
    return top.select("image", r6("green_ratio").alias("green_ratio"))


_DRAWN = """sized AS (SELECT count(*) AS n FROM chips), rate AS (SELECT n, least(CAST(floor(n * 0.1::DOUBLE) AS BIGINT), 10000) AS m FROM sized),
 lam AS (SELECT m, (m + 5 * sqrt(m::DOUBLE) + 10) / n AS l FROM rate),
 hit AS (SELECT image, pos, v, m, len(list_filter(range(0, 30), lambda k: CAST('0x' || substr(md5('42:' || image || ':' || pos), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE >= list_sum(list_transform(range(0, k + 1), lambda i: exp(-l) * pow(l, i) / CAST(factorial(i::INT) AS DOUBLE))))) AS copies FROM chips, lam),
 drawn AS (SELECT image, pos, v, m, unnest(range(1, copies + 1)) AS draw FROM hit)"""


@query("SELECT image, pos, draw, round(v, 10) AS v FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || image || ':' || pos || ':' || draw), image, pos, draw) AS r FROM drawn) WHERE r <= m", "chips", _DRAWN)
def sample_pixels(spark, sf_dir):
    """A seeded sample of pixels with replacement, a share of them up to a cap: a sampling operator."""
    out = S.draw_rows(chips(spark, sf_dir), ("image", "pos"), 0.1, 10000, 42)
    return out.select("image", "pos", "draw", r10("v").alias("v"))


@query("SELECT image, green_ratio FROM (SELECT image, round(green_ratio, 10) AS green_ratio, row_number() OVER (ORDER BY md5('7:' || image), image) AS r FROM camera) WHERE r <= 1000", "camera")
def sample_rows(spark, sf_dir):
    """A seeded uniform sample of a thousand rows at most: a sampling operator."""
    return S.choose_rows(camera(spark, sf_dir), ("image",), 1000, 7).select("image", r10("green_ratio").alias("green_ratio"))
