"""Breaks of segmented series, kept as one array of segments per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def breaks_in(segments: str, low: float, high: float) -> Column:
    """Segments that end in a certain break within ``(low, high]`` (fractional years)."""
    return F.filter(segments, lambda s: (s["t_break"] > low) & (s["t_break"] <= high) & (s["prob"] == 1))


def break_stats(df: DataFrame, keys: tuple[str, ...], segments: str = "segments", low: float = 2014.0, high: float = 2021.0) -> DataFrame:
    """Count, first, last and greatest break (by absolute magnitude, earlier on ties) of each row's array."""
    found = df.withColumn("__b", F.array_sort(breaks_in(segments, low, high)))
    ranked = F.transform("__b", lambda s: F.struct(F.abs(s["magnitude"]).alias("size"), (-s["t_break"]).alias("early"), s["magnitude"].alias("magnitude"), s["t_break"].alias("t_break")))
    top = F.array_max(ranked)
    return found.select(
        *keys, F.size("__b").cast("long").alias("n_breaks"), F.try_element_at("__b", F.lit(1))["t_break"].alias("first_break"), F.try_element_at("__b", F.lit(-1))["t_break"].alias("last_break"),
        top["magnitude"].alias("max_magnitude"), top["t_break"].alias("max_break"),
    )
