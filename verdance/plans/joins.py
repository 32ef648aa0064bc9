"""Joins of series, pixels, segments and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import joins as J
from ..operators import temporal as O
from ..sources.adapters import camera, grid, scenes, series, spectra
from .registry import query, r6, r10

_OBS = """obs AS (SELECT site, day, avg(value) AS value FROM series GROUP BY ALL), prd AS (SELECT site, day, avg(value) * 0.95 AS predicted FROM series WHERE status <> 'P' GROUP BY ALL)"""


def obs_pred(spark, sf_dir):
    """Observed and predicted daily series by site."""
    s = series(spark, sf_dir)
    obs = O.daily_mean(s, {"value": F.col("value")}, keys=("site",))
    pred = s.where("status <> 'P'").groupBy("site", "day").agg((F.avg("value") * 0.95).alias("predicted"))
    return obs, pred


@query("SELECT site, day, round(value, 10) AS value, round(predicted, 10) AS predicted, round(value - predicted, 10) AS residual FROM obs JOIN prd USING (site, day)", "series", _OBS)
def obs_pred_join(spark, sf_dir):
    """Observed joined with predicted on the day."""
    obs, pred = obs_pred(spark, sf_dir)
    return obs.join(pred, ["site", "day"]).select("site", "day", r10("value").alias("value"), r10("predicted").alias("predicted"), r10(F.col("value") - F.col("predicted")).alias("residual"))


@query("SELECT site, day, round(value, 10) AS value, round(predicted, 10) AS predicted FROM (SELECT site, day, value, CASE WHEN predicted < 0.6 THEN predicted END AS predicted FROM obs JOIN prd USING (site, day)) WHERE value IS NOT NULL AND predicted IS NOT NULL", "series", _OBS)
def join_dropna(spark, sf_dir):
    """Join, then drop rows with any NULL."""
    obs, pred = obs_pred(spark, sf_dir)
    both = obs.join(pred.withColumn("predicted", F.when(F.col("predicted") < 0.6, F.col("predicted"))), ["site", "day"]).na.drop("any")
    return both.select("site", "day", r10("value").alias("value"), r10("predicted").alias("predicted"))


@query(
    "SELECT CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, CAST(dom AS BIGINT) AS dom, round(a.v, 6) AS v_x, round(b.v, 6) AS v_y FROM (SELECT year(day) AS year, month(day) AS month, day(day) AS dom, avg(value) AS v FROM series GROUP BY ALL) a JOIN (SELECT year(day) AS year, month(day) AS month, day(day) AS dom, avg(green) AS v FROM scenes GROUP BY ALL) b USING (year, month, dom)", "series scenes"
)
def join_ymd(spark, sf_dir):
    """Join on year, month and day with suffixed values."""
    def daily(df, value, name):
        return df.groupBy(F.year("day").cast("long").alias("year"), F.month("day").cast("long").alias("month"), F.dayofmonth("day").cast("long").alias("dom")).agg(r6(F.avg(value)).alias(name))

    return daily(series(spark, sf_dir), "value", "v_x").join(daily(scenes(spark, sf_dir), "green", "v_y"), ["year", "month", "dom"])


@query("SELECT CAST(a.year AS BIGINT) AS year, round(a.v, 6) AS series_mean, round(b.v, 6) AS scene_mean FROM (SELECT year(day) AS year, avg(value) AS v FROM series GROUP BY 1) a JOIN (SELECT year(day) AS year, avg(green) AS v FROM scenes GROUP BY 1) b ON a.year = b.year", "series scenes")
def annual_join(spark, sf_dir):
    """Two yearly aggregates joined."""
    yearly = lambda df, v, n: df.groupBy(F.year("day").cast("long").alias("year")).agg(r6(F.avg(v)).alias(n))
    return yearly(series(spark, sf_dir), "value", "series_mean").join(yearly(scenes(spark, sf_dir), "green", "scene_mean"), "year")


@query("SELECT site, day, round(value, 10) AS value, round(predicted, 10) AS predicted FROM obs LEFT JOIN prd USING (site, day)", "series", _OBS)
def link_left(spark, sf_dir):
    """Left join; unmatched days have no prediction."""
    obs, pred = obs_pred(spark, sf_dir)
    return obs.join(pred, ["site", "day"], "left").select("site", "day", r10("value").alias("value"), r10("predicted").alias("predicted"))


@query("SELECT site, day, round(value, 10) AS value FROM obs WHERE day IN (SELECT day FROM scenes WHERE part = 1)", "series scenes", _OBS)
def semi_join_dates(spark, sf_dir):
    """Days that another table has too."""
    obs, _ = obs_pred(spark, sf_dir)
    return obs.join(scenes(spark, sf_dir).where("part = 1").select("day"), "day", "left_semi").select("site", "day", r10("value").alias("value"))


@query(
    "SELECT p.day, count(s.scene) AS n, round(avg(s.green), 6) AS green FROM (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-12-30', INTERVAL 1 DAY)) AS DATE) AS day) p LEFT JOIN scenes s ON s.ts >= p.day AND s.ts < p.day + INTERVAL 1 DAY GROUP BY p.day", "scenes"
)
def day_spine_join(spark, sf_dir):
    """Scenes of each day of a half-open range, the interval condition as a day key."""
    spine = spark.range(1).select(F.explode(F.sequence(F.lit("1997-01-01").cast("date"), F.lit("1997-12-30").cast("date"))).alias("day"))
    means = scenes(spark, sf_dir).groupBy("day").agg(F.count("scene").alias("n"), F.avg("green").alias("green"))
    return spine.join(means, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), r6("green").alias("green"))


_SEGS = """segs AS (SELECT site, CAST(seg AS BIGINT) AS seg, min(day) AS t_start, max(day) AS t_end FROM (SELECT site, day, (year(day) - 1995) // 2 AS seg FROM series WHERE month(day) BETWEEN 3 AND 10) GROUP BY site, seg)"""


@query(
    """SELECT s.obs, s.site, s.day, coalesce((SELECT arg_min(seg, t_start) FROM segs g WHERE g.site = s.site AND g.t_end >= s.day), (SELECT arg_max(seg, t_start) FROM segs g WHERE g.site = s.site)) AS seg FROM series s""", "series", _SEGS
)
def asof_segment(spark, sf_dir):
    """The segment of each observation, the next one in gaps, the last after the end."""
    s = series(spark, sf_dir)
    seg = F.floor((F.year("day") - 1995) / 2)
    segs = s.where(F.month("day").between(3, 10)).groupBy("site", seg.alias("seg")).agg(F.min("day").alias("t_start"), F.max("day").alias("t_end"))
    return J.asof_segment(s.select("obs", "site", "day"), segs, ("site",)).select("obs", "site", "day", "seg")


_COARSE = "coarse AS (SELECT cx, cy, avg(v) AS sat FROM grid WHERE dn > 25 GROUP BY cx, cy)"


def coarse_of(g):
    return g.where("dn > 25").groupBy("cx", "cy").agg(F.avg("v").alias("sat"))


@query("SELECT g.x, g.y, g.cx, g.cy, count(*) AS n, round(avg(c.sat), 6) AS sat FROM grid g JOIN coarse c ON g.cx = c.cx AND g.cy = c.cy GROUP BY ALL", "grid", _COARSE)
def pixel_footprint_join(spark, sf_dir):
    """Fine pixels inside each coarse pixel."""
    g = grid(spark, sf_dir)
    hit = J.footprint(g.select("x", "y", "v"), coarse_of(g), "x", "y", "cx", "cy", 10)
    return hit.groupBy("x", "y", "cx", "cy").agg(F.count("*").alias("n"), r6(F.avg("sat")).alias("sat"))


@query(
    "SELECT g.cx, g.cy, round(avg(v), 10) AS mean, round(median(v), 10) AS median, round(min(v), 10) AS low, round(max(v), 10) AS high, round(stddev_pop(v), 10) AS std, count(*) AS n, count(v) AS valid FROM (SELECT g.cx, g.cy, CASE WHEN dn > 5 THEN v END AS v FROM grid g JOIN coarse c ON g.cx = c.cx AND g.cy = c.cy) g GROUP BY g.cx, g.cy", "grid", _COARSE
)
def footprint_stats(spark, sf_dir):
    """Statistics of the fine pixels in each footprint, raw and valid counts apart."""
    g = grid(spark, sf_dir)
    hit = J.footprint(g.select("x", "y", F.when(F.col("dn") > 5, F.col("v")).alias("v")), coarse_of(g), "x", "y", "cx", "cy", 10)
    return hit.groupBy("cx", "cy").agg(
        r10(F.avg("v")).alias("mean"), r10(F.median("v")).alias("median"), r10(F.min("v")).alias("low"), r10(F.max("v")).alias("high"), r10(F.stddev_pop("v")).alias("std"), F.count("*").alias("n"), F.count("v").alias("valid")
    )


#: Two triangles and an empty sliver over the grid.
POLYGONS = {"north": [(10.3, 5.2), (180.7, 8.1), (60.2, 70.9)], "south": [(90.1, 20.4), (199.5, 95.6), (40.8, 90.3)], "sliver": [(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)]}
_EDGES = [(name, *p, *q) for name, ps in POLYGONS.items() for p, q in zip(ps, ps[1:] + ps[:1])]
_POLY = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x1}, {y1}, {x2}, {y2})" for n, x1, y1, x2, y2 in _EDGES) + ") AS e(poly, x1, y1, x2, y2))"


@query(
    """SELECT poly, 'v' AS band, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM (SELECT e.poly, g.x, g.y, g.v, g.dn, row_number() OVER () FROM
     (SELECT *, row_number() OVER () AS id FROM grid) g CROSS JOIN edges e WHERE (CAST(e.y1 AS DOUBLE) > g.y) <> (CAST(e.y2 AS DOUBLE) > g.y) AND g.x < (CAST(e.x2 AS DOUBLE) - CAST(e.x1 AS DOUBLE)) * (g.y - CAST(e.y1 AS DOUBLE)) / nullif(CAST(e.y2 AS DOUBLE) - CAST(e.y1 AS DOUBLE), 0) + CAST(e.x1 AS DOUBLE)
     GROUP BY e.poly, g.id, g.x, g.y, g.v, g.dn HAVING count(*) % 2 = 1) GROUP BY poly""",
    "grid", _POLY,
)
def zonal_stats(spark, sf_dir):
    """Statistics of the pixels in each polygon."""
    hit = J.zonal(grid(spark, sf_dir).select("x", "y", "v"), polygons(spark), "x", "y")
    return hit.groupBy("poly").agg(F.lit("v").alias("band"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), F.count("v").alias("n"))


def polygons(spark):
    edge = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = [(n, [tuple(e[1:]) for e in _EDGES if e[0] == n]) for n in POLYGONS]
    return spark.createDataFrame(rows, f"poly string, edges array<{edge}>")


_TOUCH = _POLY.replace("SELECT *", "SELECT poly, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2")


@query(
    """SELECT poly, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT e.poly, g.id, g.v FROM (SELECT *, row_number() OVER () AS id FROM grid) g CROSS JOIN edges e GROUP BY e.poly, g.id, g.v
     HAVING count(*) FILTER ((e.y1 > g.y) <> (e.y2 > g.y) AND g.x < (e.x2 - e.x1) * (g.y - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1) % 2 = 1
      OR count(*) FILTER (least(e.x1, e.x2) <= g.x + 0.5 AND greatest(e.x1, e.x2) >= g.x - 0.5 AND least(e.y1, e.y2) <= g.y + 0.5 AND greatest(e.y1, e.y2) >= g.y - 0.5
        AND abs((g.x - e.x1) * (e.y2 - e.y1) - (g.y - e.y1) * (e.x2 - e.x1)) <= 0.5 * (abs(e.x2 - e.x1) + abs(e.y2 - e.y1))) > 0) GROUP BY poly""",
    "grid", _TOUCH,
)
def zonal_stats_touched(spark, sf_dir):
    """Statistics of all pixels that a polygon touches."""
    hit = J.zonal(grid(spark, sf_dir).select("x", "y", "v"), polygons(spark), "x", "y", all_touched=True)
    return hit.groupBy("poly").agg(r6(F.avg("v")).alias("mean"), F.count("v").alias("n"))


@query("SELECT scene, part, day, round(green, 6) AS green FROM scenes WHERE prow = 3 AND pcol = 7", "scenes")
def point_extract(spark, sf_dir):
    """The pixel that holds a point, by the inverse affine transform."""
    x, y = 500000 + 7.4 * 30, 7500000 - 3.6 * 30
    row, col = int((7500000 - y) // 30), int((x - 500000) // 30)
    return scenes(spark, sf_dir).where((F.col("prow") == row) & (F.col("pcol") == col)).select("scene", "part", "day", r6("green").alias("green"))


@query(
    """SELECT image, cls, votes FROM (SELECT image, cls, votes, row_number() OVER (PARTITION BY image ORDER BY votes DESC, cls) AS r FROM (SELECT image, cls, count(*) AS votes FROM
    (SELECT a.image, b.cls, row_number() OVER (PARTITION BY a.image ORDER BY round(list_sum(list_transform(list_zip(a.bands, b.bands), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), b.cls) AS k FROM spectra a JOIN spectra b ON a.image <> b.image) WHERE k <= 5 GROUP BY image, cls)) WHERE r = 1""",
    "spectra",
)
def knn_labels(spark, sf_dir):
    """Majority class of each spectrum's five nearest other spectra."""
    s = spectra(spark, sf_dir)
    return J.knn_labels(s.select("image", "bands"), s, "bands", "cls", point_id="image", known_id="image")


@query("SELECT image, count(*) AS n, round(avg(green_ratio), 6) AS green_ratio FROM camera WHERE imgroup = 'West' AND species = 'click' GROUP BY image", "camera")
def equality_chain(spark, sf_dir):
    """A chain of equality filters."""
    return camera(spark, sf_dir).where("imgroup = 'West'").where("species = 'click'").groupBy("image").agg(F.count("*").alias("n"), r6(F.avg("green_ratio")).alias("green_ratio"))


@query("SELECT s.obs, s.site, round((s.value - m.m) / nullif(m.s, 0), 6) AS z FROM series s CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM series) m", "series")
def scalar_broadcast(spark, sf_dir):
    """Rows against a global mean and deviation, a table of one row."""
    s = series(spark, sf_dir)
    one = s.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return s.crossJoin(F.broadcast(one)).select("obs", "site", r6(B.ratio(F.col("value") - F.col("m"), F.col("s"))).alias("z"))
