"""Group statistics, fences, histograms, correlation and regression."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import ratio


def mean_std(df: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], count: bool = False, population: bool = False) -> DataFrame:
    """``<value>_mean``, ``<value>_std`` and, if asked for, ``<value>_count`` by key."""
    std = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), std(v).alias(f"{v}_std")]
        if count:
            aggs.append(F.count(v).alias(f"{v}_count"))
    return df.groupBy(*keys).agg(*aggs)


def quartiles(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Exact, linearly interpolated quartiles ``q1, q2, q3`` by key."""
    q = df.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*keys, *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)))


def outside_iqr(df: DataFrame, keys: tuple[str, ...], value: str, reach: float = 1.5) -> DataFrame:
    """Rows strictly beyond ``reach`` interquartile ranges from the quartiles of their key."""
    q = quartiles(df, keys, value)
    joined = df.join(q, list(keys)) if keys else df.crossJoin(F.broadcast(q))  # one row
    span = reach * (F.col("q3") - F.col("q1"))
    return joined.where((F.col(value) < F.col("q1") - span) | (F.col(value) > F.col("q3") + span))


def outside_mad(df: DataFrame, keys: tuple[str, ...], value: str, factor: float = 1.4826) -> DataFrame:
    """Rows strictly beyond the scaled median absolute deviation of their key, with ``m`` and ``mad``."""
    m = df.groupBy(*keys).agg(F.median(F.col(value).cast("double")).alias("m"))
    with_m = df.join(m, list(keys)).withColumn("d", F.abs(F.col(value) - F.col("m")))
    mad = with_m.groupBy(*keys).agg((F.median("d") * factor).alias("mad"))
    return with_m.join(mad, list(keys)).where((F.col(value) > F.col("m") + F.col("mad")) | (F.col(value) < F.col("m") - F.col("mad")))


def box_plot(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Quartiles and whiskers: the outermost values within 1.5 interquartile ranges."""
    q = quartiles(df, keys, value)
    span = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - span) & (F.col(value) <= F.col("q3") + span)
    return df.join(q, list(keys)).groupBy(*keys, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))


def equal_bins(df: DataFrame, keys: tuple[str, ...], value: str, bins: int = 50) -> DataFrame:
    """``keys, bin, n``: equal-width bins between a key's extremes, the last one closed."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    place = F.floor((F.col(value) - F.col("__a")) * bins / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)))
    joined = df.where(F.col(value).isNotNull()).join(ends, list(keys))
    return joined.groupBy(*keys, F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def entropy(hist: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Natural-log entropy of binned counts."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return hist.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


def linear_fit(df: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """Least squares by key: ``n, slope, intercept, r, r2, stderr``."""
    X, Y = F.col(x), F.col(y)
    out = df.where(X.isNotNull() & Y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"), F.corr(X, Y).alias("r"), F.regr_r2(Y, X).alias("r2"), F.regr_sxx(Y, X).alias("sxx"), F.regr_syy(Y, X).alias("syy")
    )
    err = F.sqrt((1 - F.col("r2")) * F.col("syy") / F.nullif(F.col("sxx"), F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0)))
    return out.withColumn("stderr", err).drop("sxx", "syy")


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def p_value(r: float | None, n: int | None) -> float | None:
    """Two-sided probability of a correlation under no relation (Student's t with n - 2 degrees)."""
    if r is None or n is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return _beta((n - 2) / 2, 0.5, 1 - r * r)


@F.pandas_udf(T.DoubleType())
def p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    """:func:`p_value` of columns."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else p_value(float(a), int(b)) for a, b in zip(r, n)], dtype="float64")


def pearson(df: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """``n, r`` by key over rows with both values."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def variation(x: Column | str) -> Column:
    """Population deviation over mean, NULL if the mean is zero."""
    return ratio(F.stddev_pop(x), F.avg(x))


def choose_rows(df: DataFrame, by: tuple[str, ...], rows: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``rows`` rows at most without replacement: those of least hash of ``by``, whatever the partitions."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *by)), *by).limit(rows)


def draw_rows(df: DataFrame, by: tuple[str, ...], share: float, most: int, seed: int = 42) -> DataFrame:
    """``min(int(share * n), most)`` draws with replacement of the rows that ``by`` names, numbered by ``draw`` within a row.

    Each row gets a Poisson number of copies from a hash, a few more in all than
    asked for; the draws of least hash stay, so they do not depend on partitions.
    """
    n = df.count()
    wanted = min(int(share * n), most)
    if wanted == 0:
        return df.withColumn("draw", F.lit(1).cast("long")).limit(0)
    rate = (wanted + 5 * math.sqrt(wanted) + 10) / n
    below, term, total = [], math.exp(-rate), 0.0
    for k in range(30):
        total += term
        below.append(total)
        term *= rate / (k + 1)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *by)), 1, 8), 16, 10).cast("double") / 4294967296.0
    copies = sum((u >= F.lit(b)).cast("long") for b in below)
    drawn = df.withColumn("__n", copies).where("__n > 0").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n")
    return choose_rows(drawn, (*by, "draw"), wanted, seed)
