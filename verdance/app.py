"""What the map application asks: a series at a point, a map on a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.temporal import daily_mean, monthly_climatology
from .functions.bands import condition_score, relative_deviation


def pixel_of(x: float, y: float, transform: tuple[float, float, float, float]) -> tuple[int, int]:
    """Row and column that hold a point, by ``(x0, y0, width, height)`` of the raster's upper left pixel."""
    x0, y0, w, h = transform
    return int((y0 - y) // h), int((x - x0) // w)


def series_at(observed: DataFrame, predicted: DataFrame, x: float, y: float, transform: tuple[float, float, float, float], value: str = "gcc") -> DataFrame:
    """``day, value, predicted, rd, score`` of the pixel that holds a point; days without observation keep the prediction.

    ``predicted`` has ``prow, pcol, day, predicted, rmse``.
    """
    row, col = pixel_of(x, y, transform)
    here = (F.col("prow") == row) & (F.col("pcol") == col)
    obs = daily_mean(observed.where(here), {"value": F.col(value)})
    out = predicted.where(here).select("day", "predicted", "rmse").join(obs, "day", "left")
    return out.select("day", "value", "predicted", relative_deviation(F.col("value"), F.col("predicted")).alias("rd"), condition_score(F.col("value"), F.col("predicted"), F.col("rmse")).alias("score"))


def map_on(observed: DataFrame, day: str, value: str = "gcc", days: int = 1, base_year: int = 1999) -> DataFrame:
    """``prow, pcol, value, predicted, rd`` of the mean composite of ``days`` days from ``day``, against the monthly base."""
    start = F.lit(day).cast("date")
    part = observed.where((F.col("day") >= start) & (F.col("day") < F.date_add(start, days)))
    now = part.groupBy("prow", "pcol").agg(F.avg(value).alias("value"))
    base = monthly_climatology(observed, value, ("prow", "pcol"), base_year).where(F.col("month") == F.month(start)).drop("month")
    return now.join(base, ["prow", "pcol"], "left").withColumn("rd", relative_deviation(F.col("value"), F.col("predicted")))
