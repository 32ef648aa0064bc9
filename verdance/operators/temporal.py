"""Aggregation by day, month and year, and the anomaly rules built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import ratio


def day_spine(df: DataFrame, day: str = "day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every day between each key's first and last, made from two values per key."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("__a"), F.max(day).alias("__b")).where("__a is not null")
    return ends.select(*keys, F.explode(F.sequence("__a", "__b", F.expr("INTERVAL 1 DAY"))).alias(day))


def daily_mean(df: DataFrame, values: dict[str, Column], day: str = "day", keys: tuple[str, ...] = (), fill: bool = False) -> DataFrame:
    """Means by key and day; ``fill`` adds the days without rows, with NULL means."""
    means = df.groupBy(*keys, day).agg(*(F.avg(c).alias(n) for n, c in values.items()))
    return day_spine(df, day, keys).join(means, [*keys, day], "left") if fill else means


def annual_mean(df: DataFrame, value: Column, keys: tuple[str, ...], day: str = "day", months: tuple[int, int] | None = (6, 8)) -> DataFrame:
    """``keys, year, value``: means by year of the given months."""
    if months:
        df = df.where(F.month(day).between(*months))
    return df.groupBy(*keys, F.year(day).cast("long").alias("year")).agg(F.avg(value).alias("value"))


def monthly_climatology(df: DataFrame, value: str, keys: tuple[str, ...], before: int, day: str = "day") -> DataFrame:
    """``keys, month, predicted``: means by calendar month of the years before ``before``, a stand-in for a fitted model."""
    base = df.where(F.year(day) < before)
    return base.groupBy(*keys, F.month(day).alias("month")).agg(F.avg(value).alias("predicted"))


def deviations(df: DataFrame, value: str, keys: tuple[str, ...], before: int, day: str = "day") -> DataFrame:
    """Daily means with their climatology: ``keys, day, value, predicted, rd``; months without a base year are left out.

    Daily means are dealt by ``keys`` once; the climatology is a window over key and
    month, so neither it nor later aggregates and windows by key shuffle again.
    """
    daily = daily_mean(df, {"value": F.col(value)}, day, keys).repartition(*keys)
    daily = daily.withColumns({"__m": F.month(day), "__base": F.year(day) < before})
    w = Window.partitionBy(*keys, "__m")
    out = daily.withColumns({"predicted": F.avg(F.when(F.col("__base"), F.col("value"))).over(w), "__n": F.count(F.when(F.col("__base"), 1)).over(w)})
    out = out.where("__n > 0").drop("__m", "__base", "__n")
    return out.withColumn("rd", ratio(F.col("value") - F.col("predicted"), F.col("predicted")))


def beyond_sigma(df: DataFrame, value: str, keys: tuple[str, ...], strict: bool = False, negative: bool = True, sample: bool = False) -> DataFrame:
    """``value`` kept where it reaches its key's deviation, else NULL, with ``sigma``.

    strict: above, not at, the deviation.  negative: losses only (zero kept unless strict).
    """
    w = Window.partitionBy(*keys)
    sigma = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    df = df.withColumn("sigma", sigma)
    size = F.abs(F.col(value))
    keep = size > F.col("sigma") if strict else size >= F.col("sigma")
    if negative:
        keep = keep & ((F.col(value) < 0) if strict else (F.col(value) <= 0))
    return df.withColumn("kept", F.when(keep, F.col(value)))


def extent(df: DataFrame, by: tuple[str, ...], kept: str = "kept", valid_only: str | None = None) -> DataFrame:
    """Mean, population deviation and share of kept pixels by key; the share is of all rows unless ``valid_only`` names a column."""
    of = F.count(valid_only) if valid_only else F.count(F.lit(1))
    return df.groupBy(*by).agg(F.avg(kept).alias("mean"), F.stddev_pop(kept).alias("std"), (F.count(kept) / of).alias("extent"))
