"""Group statistics, fences, histograms, reshaping and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import stats as S
from ..sources.adapters import camera, chips, scenes, series, spectra
from .registry import query, r6, r10
from .scans import _RGB, rgb

_CAM = "SELECT imgroup, round(avg(green_ratio), 6) AS green_ratio_mean, round(stddev_samp(green_ratio), 6) AS green_ratio_std FROM camera GROUP BY imgroup"


@query(_CAM, "camera")
def group_mean_std(spark, sf_dir):
    """Mean and sample deviation by group."""
    out = S.mean_std(camera(spark, sf_dir), ("imgroup",), ("green_ratio",))
    return out.select("imgroup", *(r6(c).alias(c) for c in out.columns[1:]))


@query(
    "SELECT species, day, round(avg(green_ratio), 10) AS green_ratio_mean, round(stddev_samp(green_ratio), 10) AS green_ratio_std, count(green_ratio) AS green_ratio_count, round(avg(bvoc), 10) AS bvoc_mean, round(stddev_samp(bvoc), 10) AS bvoc_std, count(bvoc) AS bvoc_count FROM (SELECT *, CASE WHEN plot % 5 <> 0 THEN plot / 1000.0 END AS bvoc FROM camera) GROUP BY ALL", "camera"
)
def group_mean_std_count(spark, sf_dir):
    """Mean, sample deviation and count of two columns."""
    c = camera(spark, sf_dir).withColumn("bvoc", F.when(F.col("plot") % 5 != 0, F.col("plot") / 1000))
    out = S.mean_std(c, ("species", "day"), ("green_ratio", "bvoc"), count=True)
    return out.select("species", "day", *((F.col(n) if n.endswith("count") else r10(n)).alias(n) for n in out.columns[2:]))


@query("SELECT CAST(year(day) AS BIGINT) AS year, species, substr(imgroup, 1, 1) AS letter, CAST(dayofyear(day) AS BIGINT) AS doy, round(avg(green_ratio), 10) AS green_ratio_mean, round(stddev_samp(green_ratio), 10) AS green_ratio_std FROM camera GROUP BY ALL", "camera")
def species_doy_stats(spark, sf_dir):
    """Statistics by year, species, group letter and day of the year in one grouping."""
    c = camera(spark, sf_dir).withColumns({"year": F.year("day").cast("long"), "doy": F.dayofyear("day").cast("long"), "letter": F.substring("imgroup", 1, 1)})
    out = S.mean_std(c, ("year", "species", "letter", "doy"), ("green_ratio",))
    return out.select("year", "species", "letter", "doy", r10("green_ratio_mean").alias("green_ratio_mean"), r10("green_ratio_std").alias("green_ratio_std"))


_PX = _RGB + ", px AS (SELECT image, g / nullif(r + g + b, 0) AS gcc FROM rgb)"


def green_pixels(spark, sf_dir):
    return rgb(spark, sf_dir).select("image", B.gcc(F.col("r"), F.col("g"), F.col("b")).alias("gcc"))


@query("SELECT image, round(avg(CASE WHEN gcc > 0.38 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM px GROUP BY image", "chips", _PX)
def green_ratio(spark, sf_dir):
    """Share of pixels greener than the threshold."""
    return green_pixels(spark, sf_dir).groupBy("image").agg(r6(F.avg(F.coalesce(F.col("gcc") > 0.38, F.lit(False)).cast("double"))).alias("ratio"))


@query("SELECT image, round(avg(gcc), 6) AS mean, round(stddev_pop(gcc), 6) AS std FROM px GROUP BY image", "chips", _PX)
def green_metrics_all(spark, sf_dir):
    """Mean and population deviation over all pixels."""
    return green_pixels(spark, sf_dir).groupBy("image").agg(r6(F.avg("gcc")).alias("mean"), r6(F.stddev_pop("gcc")).alias("std"))


@query("SELECT image, round(coalesce(avg(gcc) FILTER (gcc > 0.38), 0), 6) AS mean, round(coalesce(stddev_pop(gcc) FILTER (gcc > 0.38), 0), 6) AS std, round(coalesce(avg(gcc) FILTER (gcc > 0.38), 0), 6) AS norm FROM px GROUP BY image", "chips", _PX)
def green_metrics_masked(spark, sf_dir):
    """The same over green pixels only, zero if there are none."""
    g = F.when(F.col("gcc") > 0.38, F.col("gcc"))
    mean = r6(F.coalesce(F.avg(g), F.lit(0.0)))
    return green_pixels(spark, sf_dir).groupBy("image").agg(mean.alias("mean"), r6(F.coalesce(F.stddev_pop(g), F.lit(0.0))).alias("std"), mean.alias("norm"))


@query(
    "SELECT cls, round(avg(m), 6) AS mean, round(avg(s), 6) AS std, sum(n)::BIGINT AS n FROM (SELECT cls, image, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM chips GROUP BY cls, image) GROUP BY cls", "chips"
)
def two_stage_summary(spark, sf_dir):
    """Unweighted means of group means and deviations."""
    one = chips(spark, sf_dir).groupBy("cls", "image").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n"))
    return one.groupBy("cls").agg(r6(F.avg("m")).alias("mean"), r6(F.avg("s")).alias("std"), F.sum("n").alias("n"))


@query("SELECT round(avg(green_ratio), 6) AS mean, round(median(green_ratio), 6) AS median, round(stddev_samp(green_ratio), 6) AS std FROM camera WHERE green_ratio > 0.2", "camera")
def threshold_summary(spark, sf_dir):
    """Mean, median and sample deviation above a floor."""
    g = F.col("green_ratio")
    return camera(spark, sf_dir).where(g > 0.2).agg(r6(F.avg(g)).alias("mean"), r6(F.median(g)).alias("median"), r6(F.stddev_samp(g)).alias("std"))


@query(
    "SELECT c.image, round(c.green_ratio, 6) AS v FROM camera c JOIN (SELECT species, quantile_cont(green_ratio, 0.25) AS q1, quantile_cont(green_ratio, 0.75) AS q3 FROM camera GROUP BY species) q ON c.species = q.species WHERE green_ratio < q1 - 1.5 * (q3 - q1) OR green_ratio > q3 + 1.5 * (q3 - q1)", "camera"
)
def iqr_outliers(spark, sf_dir):
    """Rows beyond the interquartile fence of their species."""
    return S.outside_iqr(camera(spark, sf_dir), ("species",), "green_ratio").select("image", r6("green_ratio").alias("v"))


@query(
    "SELECT d.image, round(d.green_ratio, 6) AS v FROM d JOIN (SELECT species, 1.4826 * median(abs(green_ratio - m)) AS mad FROM d GROUP BY species) x ON d.species = x.species WHERE d.green_ratio > m + mad OR d.green_ratio < m - mad",
    "camera", "d AS (SELECT c.*, median(green_ratio) OVER (PARTITION BY species) AS m FROM camera c WHERE green_ratio > 0.2)",
)
def mad_outliers(spark, sf_dir):
    """Rows beyond the scaled median absolute deviation of their species."""
    return S.outside_mad(camera(spark, sf_dir).where("green_ratio > 0.2"), ("species",), "green_ratio").select("image", r6("green_ratio").alias("v"))


@query(
    """SELECT imgroup, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM
    (SELECT c.imgroup, green_ratio AS v, q1, q2, q3 FROM camera c JOIN (SELECT imgroup, quantile_cont(green_ratio, 0.25) AS q1, quantile_cont(green_ratio, 0.5) AS q2, quantile_cont(green_ratio, 0.75) AS q3 FROM camera GROUP BY imgroup) q ON c.imgroup = q.imgroup) GROUP BY imgroup, q1, q2, q3""",
    "camera",
)
def boxplot_stats(spark, sf_dir):
    """Quartiles and whiskers by group."""
    out = S.box_plot(camera(spark, sf_dir), ("imgroup",), "green_ratio")
    return out.select("imgroup", *(r6(c).alias(c) for c in ("q1", "q2", "q3", "low", "high")))


@query("SELECT image, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, round(stddev_pop(v + 1) / nullif(avg(v + 1), 0), 6) AS cv FROM chips GROUP BY image", "chips")
def basic_stats_cv(spark, sf_dir):
    """Basic statistics and the coefficient of variation."""
    c = chips(spark, sf_dir).withColumn("w", F.col("v") + 1)
    return c.groupBy("image").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), r6(F.min("v")).alias("low"), r6(F.max("v")).alias("high"), r6(S.variation("w")).alias("cv"))


_HIST = """bins AS (SELECT image, least(coalesce(CAST(floor((v - a) * 50 / nullif(b - a, 0)) AS BIGINT), 0), 49) AS bin FROM (SELECT image, v, min(v) OVER (PARTITION BY image) AS a, max(v) OVER (PARTITION BY image) AS b FROM chips)),
 hist AS (SELECT image, bin, count(*) AS n FROM bins GROUP BY image, bin)"""


@query("SELECT image, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT image, n / sum(n) OVER (PARTITION BY image) AS p FROM hist) GROUP BY image", "chips", _HIST)
def entropy(spark, sf_dir):
    """Entropy of each image's histogram."""
    out = S.entropy(S.equal_bins(chips(spark, sf_dir), ("image",), "v"), ("image",))
    return out.select("image", r6("entropy").alias("entropy"))


@query("SELECT CAST(floor(nir * 10) AS BIGINT) AS bin, count(*) AS n FROM scenes GROUP BY 1", "scenes")
def hist_binwidth(spark, sf_dir):
    """Histogram of bins of width one."""
    return scenes(spark, sf_dir).groupBy(F.floor(F.col("nir") * 10).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT image, bin, n FROM hist", "chips", _HIST)
def hist_50(spark, sf_dir):
    """Histogram of fifty equal bins, the last closed."""
    return S.equal_bins(chips(spark, sf_dir), ("image",), "v").select("image", "bin", "n")


@query("SELECT CAST(floor(green * 20) AS BIGINT) AS gx, CAST(floor(nir * 20) AS BIGINT) AS gy, count(*) AS n, round(ln(count(*)), 6) AS log_n FROM scenes GROUP BY 1, 2", "scenes")
def density_2d(spark, sf_dir):
    """Joint histogram with log counts."""
    return scenes(spark, sf_dir).groupBy(F.floor(F.col("green") * 20).alias("gx"), F.floor(F.col("nir") * 20).alias("gy")).agg(F.count("*").alias("n"), r6(F.ln(F.count("*"))).alias("log_n"))


@query("SELECT imgroup, count(*) AS total, count(*) FILTER (green_ratio < 0.5) AS done, count(*) FILTER (green_ratio >= 0.5) AS failed FROM camera GROUP BY imgroup", "camera")
def status_counts(spark, sf_dir):
    """Conditional counts."""
    g = F.col("green_ratio")
    return camera(spark, sf_dir).groupBy("imgroup").agg(F.count("*").alias("total"), F.count_if(g < 0.5).alias("done"), F.count_if(g >= 0.5).alias("failed"))


@query("SELECT DISTINCT CAST(year(day) AS BIGINT) AS year FROM series", "series")
def distinct_values(spark, sf_dir):
    """Distinct years."""
    return series(spark, sf_dir).select(F.year("day").cast("long").alias("year")).distinct()


@query("SELECT image, min(prow) AS top, max(prow) AS bottom, min(pcol) AS near, max(pcol) AS far, CAST(trunc(avg(prow)) AS BIGINT) AS mid_row, CAST(trunc(avg(pcol)) AS BIGINT) AS mid_col FROM chips WHERE v > 0.1 GROUP BY image", "chips")
def mask_bbox(spark, sf_dir):
    """Bounding box and truncated centroid of masked pixels."""
    m = chips(spark, sf_dir).where("v > 0.1")
    return m.groupBy("image").agg(F.min("prow").alias("top"), F.max("prow").alias("bottom"), F.min("pcol").alias("near"), F.max("pcol").alias("far"), F.avg("prow").cast("long").alias("mid_row"), F.avg("pcol").cast("long").alias("mid_col"))


@query("SELECT imgroup, species, n, rank FROM (SELECT imgroup, species, count(*) AS n, CAST(row_number() OVER (PARTITION BY imgroup ORDER BY count(*) DESC, species) AS INT) AS rank FROM camera GROUP BY imgroup, species) WHERE rank <= 2", "camera")
def top2_clusters(spark, sf_dir):
    """The two largest classes of each group."""
    sizes = camera(spark, sf_dir).groupBy("imgroup", "species").agg(F.count("*").alias("n"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("imgroup").orderBy(F.desc("n"), "species"))).where("rank <= 2")


@query("SELECT image, cls, name, round(v, 6) AS v FROM (UNPIVOT (SELECT image, cls, CAST(bands[1] AS DOUBLE) AS class1, CAST(bands[2] AS DOUBLE) AS class2, CAST(bands[3] AS DOUBLE) AS class3 FROM spectra) ON class1, class2, class3 INTO NAME name VALUE v)", "spectra")
def unpivot_classes(spark, sf_dir):
    """Columns to rows."""
    names = ["class1", "class2", "class3"]
    wide = spectra(spark, sf_dir).select("image", "cls", *(F.col("bands")[i].alias(n) for i, n in enumerate(names)))
    return wide.unpivot(["image", "cls"], names, "name", "v").withColumn("v", r6("v"))


@query("SELECT 'first' AS change, CAST(floor(green * 10) AS BIGINT) AS bin, count(*) AS n FROM scenes GROUP BY 2 UNION ALL SELECT 'last', CAST(floor(nir * 10) AS BIGINT), count(*) FROM scenes GROUP BY 2", "scenes")
def union_tagged(spark, sf_dir):
    """Two histograms end to end with a tag."""
    s = scenes(spark, sf_dir)
    tagged = lambda name, c: s.groupBy(F.floor(F.col(c) * 10).alias("bin")).agg(F.count("*").alias("n")).select(F.lit(name).alias("change"), "bin", "n")
    return tagged("first", "green").unionByName(tagged("last", "nir"))


@query("SELECT CAST(year(day) AS BIGINT) AS year FROM series UNION SELECT CAST(year(day) AS BIGINT) FROM camera ORDER BY 1", "series camera")
def union_distinct(spark, sf_dir):
    """Set union of years, in order."""
    years = lambda df: df.select(F.year("day").cast("long").alias("year"))
    return years(series(spark, sf_dir)).union(years(camera(spark, sf_dir))).distinct().orderBy("year")


@query("SELECT CAST(unnest(range(max(year(day)), min(year(day)) - 1, -1)) AS BIGINT) AS year FROM series", "series")
def years_descending(spark, sf_dir):
    """The years of the series from last to first."""
    ends = series(spark, sf_dir).agg(F.min(F.year("day")).alias("a"), F.max(F.year("day")).alias("b"))
    return ends.select(F.explode(F.sequence(F.col("b").cast("long"), F.col("a").cast("long"), F.lit(-1).cast("long"))).alias("year"))


@query("SELECT species, round(corr(green_ratio, x), 6) AS r, count(*) AS n FROM (SELECT species, green_ratio, plot * 1.0 + green_ratio * 40 AS x FROM camera) GROUP BY species", "camera")
def pearson_by_group(spark, sf_dir):
    """Correlation by group."""
    c = camera(spark, sf_dir).withColumn("x", F.col("plot") + F.col("green_ratio") * 40)
    return S.pearson(c, ("species",), "green_ratio", "x").select("species", r6("r").alias("r"), "n")


#: Student's distribution by its finite series: angle theta, coefficients of even or odd powers of its cosine by the gamma function.
_STUDENT = """
 fit AS (SELECT species, imgroup, count(*) AS n, corr(green_ratio, x) AS r FROM (SELECT species, imgroup, green_ratio, plot * 1.0 + green_ratio AS x FROM camera) GROUP BY ALL),
 ang AS (SELECT *, n - 2 AS df, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt((n - 2)::DOUBLE)) AS th FROM fit WHERE n > 2 AND abs(r) < 1),
 within AS (SELECT *, CASE WHEN df % 2 = 0 THEN sin(th) * (1 + coalesce(list_sum(list_transform(range(1, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos(th))))), 0))
   ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(1, (df + 1) // 2), lambda k: exp(lgamma(k::DOUBLE) - lgamma(k + 0.5) + 0.5 * ln(pi()) - ln(2) + (2 * k - 1) * ln(cos(th))))), 0)) END AS inside FROM ang)"""


@query("SELECT species, imgroup, n, round(r, 6) AS r, round(1 - inside, 6) AS p FROM within", "camera", _STUDENT.lstrip())
def pearson_p_value(spark, sf_dir):
    """Correlation by group with its two-sided probability."""
    c = camera(spark, sf_dir).withColumn("x", F.col("plot") + F.col("green_ratio"))
    out = S.pearson(c, ("species", "imgroup"), "green_ratio", "x")
    return out.withColumn("p", S.p_values("r", "n")).where("n > 2 and abs(r) < 1").select("species", "imgroup", "n", r6("r").alias("r"), r6("p").alias("p"))


@query(
    "SELECT species, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(sqrt((1 - r2) * syy / sxx / (n - 2)), 6) AS stderr FROM (SELECT species, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx FROM (SELECT species, green_ratio AS y, plot * 1.0 + green_ratio * 40 AS x FROM camera) GROUP BY species)", "camera"
)
def linregress(spark, sf_dir):
    """Least squares by group with the slope's error."""
    c = camera(spark, sf_dir).withColumn("x", F.col("plot") + F.col("green_ratio") * 40)
    out = S.linear_fit(c, ("species",), "x", "green_ratio")
    return out.select("species", "n", *(r6(x).alias(x) for x in ("slope", "intercept", "r2", "stderr")))
