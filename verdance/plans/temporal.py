"""Aggregation in time, deviations, anomalies and the flagship extent query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import temporal as O
from ..sources.adapters import camera, scenes, series
from .registry import query, r6, r10

PIXEL = ("prow", "pcol")
BASE_YEAR = 1999


def clear_gcc(spark, sf_dir):
    """Green chromatic coordinate of pixels with clear quality bits."""
    s = scenes(spark, sf_dir).where(B.bits_clear(F.col("fmask"), 14))
    return s.withColumn("gcc", B.gcc(F.col("red"), F.col("green"), F.col("blue")))


_GCC = "g AS (SELECT *, green / nullif(red + green + blue, 0) AS gcc FROM scenes WHERE (fmask & 14) = 0)"
_DAILY = _GCC + ", daily AS (SELECT prow, pcol, day, avg(gcc) AS value FROM g GROUP BY ALL)"
_DEV = _DAILY + """, pred AS (SELECT prow, pcol, month(day) AS m, avg(value) AS predicted FROM daily WHERE year(day) < 1999 GROUP BY ALL),
 dev AS (SELECT d.prow, d.pcol, d.day, d.value, p.predicted, (d.value - p.predicted) / nullif(p.predicted, 0) AS rd FROM daily d JOIN pred p ON d.prow = p.prow AND d.pcol = p.pcol AND month(d.day) = p.m),
 annual AS (SELECT prow, pcol, CAST(year(day) AS BIGINT) AS year, avg(CASE WHEN abs(rd) <= 1 THEN rd END) AS rd FROM dev WHERE month(day) BETWEEN 6 AND 8 GROUP BY ALL),
 sig AS (SELECT *, stddev_pop(rd) OVER (PARTITION BY prow, pcol) AS sigma FROM annual)"""


@query("SELECT prow, pcol, day, round(value, 6) AS gcc FROM daily", "scenes", _DAILY)
def daily_mean_pixel(spark, sf_dir):
    """Daily means of each pixel's clear observations."""
    return O.daily_mean(clear_gcc(spark, sf_dir), {"gcc": F.col("gcc")}, keys=PIXEL).select(*PIXEL, "day", r6("gcc").alias("gcc"))


def annual_rd(spark, sf_dir):
    """Yearly summer means of relative deviation within [-1, 1], one row per pixel and year."""
    dev = O.deviations(clear_gcc(spark, sf_dir), "gcc", PIXEL, BASE_YEAR)
    return O.annual_mean(dev, B.within(F.col("rd"), -1, 1), PIXEL).withColumnRenamed("value", "rd")


@query("SELECT prow, pcol, day, round(value, 6) AS observed, round(predicted, 6) AS predicted, round(rd, 6) AS rd FROM dev", "scenes", _DEV)
def relative_deviation(spark, sf_dir):
    """Observed against predicted, per pixel and day."""
    dev = O.deviations(clear_gcc(spark, sf_dir), "gcc", PIXEL, BASE_YEAR)
    return dev.select(*PIXEL, "day", r6("value").alias("observed"), r6("predicted").alias("predicted"), r6("rd").alias("rd"))


@query(
    "SELECT prow, pcol, day, round((value - predicted) / nullif(rmse, 0), 5) AS score FROM (SELECT *, sqrt(avg((value - predicted) * (value - predicted)) OVER (PARTITION BY prow, pcol)) AS rmse FROM dev)", "scenes", _DEV
)
def condition_score(spark, sf_dir):
    """Residuals in units of each pixel's root mean square error."""
    dev = O.deviations(clear_gcc(spark, sf_dir), "gcc", PIXEL, BASE_YEAR)
    res = F.col("value") - F.col("predicted")
    dev = dev.withColumn("rmse", F.sqrt(F.avg(res * res).over(Window.partitionBy(*PIXEL))))
    return dev.select(*PIXEL, "day", F.round(B.condition_score(F.col("value"), F.col("predicted"), F.col("rmse")), 5).alias("score"))


@query("SELECT prow, pcol, day, CASE WHEN abs(value - m) > 1e-3 THEN round((value - predicted) / (value - m), 4) END AS metric FROM (SELECT *, avg(value) OVER (PARTITION BY prow, pcol) AS m FROM dev)", "scenes", _DEV)
def test_metric(spark, sf_dir):
    """Residual over the deviation from the mean; NULL where that is nearly zero."""
    dev = O.deviations(clear_gcc(spark, sf_dir), "gcc", PIXEL, BASE_YEAR).withColumn("m", F.avg("value").over(Window.partitionBy(*PIXEL)))
    v = F.col("value")
    metric = F.when(F.abs(v - F.col("m")) > 1e-3, B.ratio(v - F.col("predicted"), v - F.col("m")))
    return dev.select(*PIXEL, "day", F.round(metric, 4).alias("metric"))


test_metric.__test__ = False


@query("SELECT prow, pcol, year, round(rd, 6) AS rd FROM annual", "scenes", _DEV)
def annual_pixel_mean(spark, sf_dir):
    """Yearly summer means of each pixel."""
    return annual_rd(spark, sf_dir).select(*PIXEL, "year", r6("rd").alias("rd"))


@query("SELECT prow, pcol, round(stddev_pop(rd), 6) AS sigma, count(rd) AS years FROM annual GROUP BY prow, pcol", "scenes", _DEV)
def pixel_sigma(spark, sf_dir):
    """Population deviation of each pixel across years."""
    return annual_rd(spark, sf_dir).groupBy(*PIXEL).agg(r6(F.stddev_pop("rd")).alias("sigma"), F.count("rd").alias("years"))


@query("SELECT prow, pcol, year, round(rd, 6) AS rd FROM sig WHERE abs(rd) > sigma", "scenes", _DEV)
def anomaly_sigma_mask(spark, sf_dir):
    """Pixel years whose deviation exceeds the pixel's own."""
    kept = O.beyond_sigma(annual_rd(spark, sf_dir), "rd", PIXEL, strict=True, negative=False)
    return kept.where("kept is not null").select(*PIXEL, "year", r6("rd").alias("rd"))


@query(
    "SELECT year, round(avg(kept), 6) AS mean, round(stddev_pop(kept), 6) AS std, round(count(kept) / count(*), 6) AS extent FROM (SELECT *, CASE WHEN abs(rd) >= sigma AND rd <= 0 THEN rd END AS kept FROM sig) GROUP BY year", "scenes", _DEV
)
def defoliation_extent(spark, sf_dir):
    """Mean, deviation and extent of losses by year: the flagship query."""
    out = O.extent(O.beyond_sigma(annual_rd(spark, sf_dir), "rd", PIXEL), ("year",))
    return out.select("year", *(r6(c).alias(c) for c in ("mean", "std", "extent")))


@query(
    "SELECT s.site, s.day, round(avg(o.value), 10) AS value, count(o.value) AS n FROM (SELECT site, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM series GROUP BY site) s LEFT JOIN series o ON o.site = s.site AND o.day = s.day GROUP BY s.site, s.day", "series"
)
def daily_mean_gapfill(spark, sf_dir):
    """Daily means of each site on a full calendar; days without rows stay, with NULL."""
    every = series(spark, sf_dir)
    means = every.groupBy("site", "day").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    filled = O.day_spine(every, keys=("site",)).join(means, ["site", "day"], "left")
    return filled.select("site", "day", r10("value").alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT day, round(avg(green_ratio), 6) AS green_ratio, round(avg(plot), 6) AS plot, count(*) AS n FROM camera GROUP BY day", "camera")
def daily_multi_mean(spark, sf_dir):
    """Daily means of several columns at once."""
    return camera(spark, sf_dir).groupBy("day").agg(r6(F.avg("green_ratio")).alias("green_ratio"), r6(F.avg("plot")).alias("plot"), F.count("*").alias("n"))


@query("SELECT site, CAST(year(day) AS BIGINT) AS year, round(avg(value), 6) AS value FROM series WHERE month(day) BETWEEN 6 AND 8 GROUP BY 1, 2", "series")
def annual_summer_mean(spark, sf_dir):
    """Summer means by site and year."""
    return O.annual_mean(series(spark, sf_dir), F.col("value"), ("site",)).select("site", "year", r6("value").alias("value"))


_RES = """daily AS (SELECT site, day, avg(value) AS value FROM series GROUP BY ALL), pred AS (SELECT site, month(day) AS m, avg(value) AS predicted FROM daily WHERE year(day) < 1999 GROUP BY ALL),
 res AS (SELECT d.site, d.day, d.value, p.predicted, (d.value - p.predicted) / nullif(p.predicted, 0) AS rd FROM daily d JOIN pred p ON d.site = p.site AND month(d.day) = p.m WHERE month(d.day) BETWEEN 6 AND 8),
 yearly AS (SELECT site, CAST(year(day) AS BIGINT) AS year, avg(rd) AS rd FROM res GROUP BY ALL)"""


def summer_rd(spark, sf_dir):
    return O.deviations(series(spark, sf_dir), "value", ("site",), BASE_YEAR).where(F.month("day").between(6, 8))


@query("SELECT site, year, round(rd, 6) AS rd FROM (SELECT *, stddev_samp(rd) OVER (PARTITION BY site) AS s FROM yearly) WHERE abs(rd) > s", "series", _RES)
def annual_anomaly(spark, sf_dir):
    """Years beyond the sample deviation of the yearly means."""
    yearly = O.annual_mean(summer_rd(spark, sf_dir), F.col("rd"), ("site",)).withColumnRenamed("value", "rd")
    kept = O.beyond_sigma(yearly, "rd", ("site",), strict=True, negative=False, sample=True)
    return kept.where("kept is not null").select("site", "year", r6("rd").alias("rd"))


@query("SELECT y.site, y.year, round(y.rd, 6) AS rd FROM yearly y JOIN (SELECT site, stddev_samp(rd) AS s FROM res GROUP BY site) d ON y.site = d.site WHERE abs(y.rd) > d.s / 8", "series", _RES)
def annual_anomaly_dailysigma(spark, sf_dir):
    """Years beyond an eighth of the deviation of the daily summer values (the other rule's deviation)."""
    daily = summer_rd(spark, sf_dir)
    stats = daily.groupBy("site", F.year("day").cast("long").alias("year")).agg(F.avg("rd").alias("rd"))
    sigma = daily.groupBy("site").agg(F.stddev_samp("rd").alias("s"))
    return stats.join(sigma, "site").where(F.abs("rd") > F.col("s") / 8).select("site", "year", r6("rd").alias("rd"))
