"""Ordered series: filling, smoothing, derivatives, phenology dates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill_both_ways(df: DataFrame, keys: tuple[str, ...], order: str, value: str, out: str = "filled") -> DataFrame:
    """The last value so far, else the first one to come, over each key's whole series.

    The first to come is the last so far from the other end, so both frames only grow.
    """
    so_far = lambda by: F.last(value, True).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(so_far(F.col(order)), so_far(F.desc(order))))


def savgol_rows(window: int = 11, degree: int = 3) -> np.ndarray:
    """Weights of local least squares: row i gives the fitted value at place i of a window."""
    x = np.arange(window) - window // 2
    a = np.vander(x, degree + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def savgol(df: DataFrame, keys: tuple[str, ...], order: str, value: str, out: str = "smooth", window: int = 11, degree: int = 3) -> DataFrame:
    """Savitzky-Golay smoothing by row order; ends take the fit of the first and last full window.

    Series shorter than the window stay as they are.  ``value`` must not hold NULLs.
    """
    rows = savgol_rows(window, degree)
    half = window // 2
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    # Places from either end say which weights hold; all need the same values around.
    df = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n)
    around = F.collect_list(value).over(w.rowsBetween(-(window - 1), window - 1))
    first = F.col("__i") - F.least(F.col("__i"), F.lit(window - 1))  # place of the first value collected
    start = F.least(F.greatest(F.col("__i") - half, F.lit(0)), F.col("__n") - window)
    part = F.slice(F.col("__v"), (start - first + 1).cast("int"), F.lit(window))
    weights = F.array(*[F.array(*[F.lit(float(c)) for c in r]) for r in rows])
    pick = F.element_at(weights, (F.col("__i") - start + 1).cast("int"))
    smooth = F.aggregate(F.zip_with(pick, part, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("__v", around).withColumn(out, F.when(F.col("__n") < window, F.col(value)).otherwise(smooth)).drop("__i", "__n", "__v")


def gradient(df: DataFrame, keys: tuple[str, ...], order: str, value: str, out: str = "slope") -> DataFrame:
    """Central differences with one-sided ends, unit spacing; NULL for a single row."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return df.withColumn(out, F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2))


def phenology(df: DataFrame, keys: tuple[str, ...], day: str, value: str, least_rows: int = 5, least_std: float = 1e-9) -> DataFrame:
    """Start (greatest slope), peak (greatest value) and end (least slope) of each key's season; the first day on ties.

    Keys with few rows or no variation are left out; ``ordered`` says whether the dates follow each other.
    """
    sloped = gradient(df, keys, day, value, "__slope").withColumn("__r", F.datediff(F.lit("2200-01-01"), day))
    at = lambda c, sign: F.max(F.struct((sign * F.round(c, 9)).alias("c"), F.col("__r"), F.col(day).alias("day")))["day"]
    out = sloped.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.stddev_pop(value).alias("__s"), at(F.col("__slope"), 1).alias("sos_date"), at(F.col(value), 1).alias("pos_date"), at(F.col("__slope"), -1).alias("eos_date")
    )
    out = out.where((F.col("__n") >= least_rows) & (F.col("__s") >= least_std)).drop("__n", "__s")
    ordered = (F.col("sos_date") < F.col("pos_date")) & (F.col("pos_date") < F.col("eos_date"))
    doys = {f"{c}_doy": F.dayofyear(f"{c}_date").cast("long") for c in ("sos", "pos", "eos")}
    return out.withColumns(doys).withColumn("ordered", ordered)
