"""Shapes of the domain built from the test tables, each with the same shape in SQL.

``scenes``: pixel observations.  ``series``: site series over years.  ``camera``:
time-lapse rows.  ``chips``: 8 x 8 rasters.  ``mosaics``: 16 x 16 rasters.
``meadows``: colour images of two kinds of plants.  ``broken_series``: with breaks on known days.  ``spectra``: one array per vector.
``grid``: fine pixels under coarse cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import fractional_year


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("l_partkey") % 50
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene"),
        F.col("l_linenumber").cast("long").alias("part"),
        F.floor(px / 10).alias("prow"),
        (px % 10).alias("pcol"),
        F.col("l_shipdate").alias("ts"),
        F.to_date("l_shipdate").alias("day"),
        (F.col("l_quantity") / 50).alias("green"),
        (F.col("l_discount") * 5).alias("red"),
        (F.col("l_tax") * 5).alias("blue"),
        (F.col("l_extendedprice") / 1e5).alias("nir"),
        (F.col("l_orderkey") % 16).alias("fmask"),
        F.col("l_linestatus").alias("sensor"),
        F.col("l_returnflag").alias("orbit"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("site"),
        F.to_date("o_orderdate").alias("day"),
        (F.col("o_totalprice") / 5e5).alias("value"),
        F.col("o_orderkey").alias("obs"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("grp"),
    )


def camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.element_at(F.array(*map(F.lit, ("West", "North", "South", "East"))), (F.col("user_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("image"), "ts", F.to_date("ts").alias("day"), group.alias("imgroup"), (F.col("value") / 500).alias("green_ratio"), F.col("event_type").alias("species"), F.col("user_id").alias("plot")
    )


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.col("label").cast("long").alias("cls"), F.posexplode("embedding"))
    return flat.select("image", "cls", F.col("pos").cast("long").alias("pos"), F.floor(F.col("pos") / 8).alias("prow"), (F.col("pos") % 8).cast("long").alias("pcol"), F.col("col").cast("double").alias("v"))


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four chips each, side by side: 16 x 16 pixels."""
    c, quarter = chips(spark, sf_dir), F.col("image") % 4
    return c.select(F.floor(F.col("image") / 4).alias("image"), (F.floor(quarter / 2) * 8 + F.col("prow")).alias("prow"), (quarter % 2 * 8 + F.col("pcol")).alias("pcol"), "v")


def meadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 colour images: bare rows on top, then dark green on the left and light green on the right."""
    m = mosaics(spark, sf_dir)
    more = F.floor(F.abs("v") * 40) % 3
    kind = F.when(F.col("prow") < F.col("image") % 4, 0).when(F.col("pcol") < 5 + F.col("image") % 6, 1).otherwise(2)
    pick = lambda bare, dark, light: F.when(kind == 0, bare).when(kind == 1, dark).otherwise(light).cast("double")
    return m.select("image", "prow", "pcol", pick(90, 30, 80).alias("r"), (pick(90, 70, 190) + F.when(kind > 0, more).otherwise(0)).alias("g"), pick(90, 30, 60).alias("b"))


def broken_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site, day, t, value``: seasonal daily series; three of four sites rise by 0.2 on a day of their own."""
    daily = series(spark, sf_dir).groupBy("site", "day").agg(F.avg("value").alias("x"))
    t = fractional_year(F.col("day"))
    risen = (F.col("site") % 4 != 3) & (F.datediff("day", F.lit("1997-01-01").cast("date")) >= F.col("site") * 20)
    level = 0.4 + 0.1 * F.cos(2 * math.pi * t) + F.when(risen, 0.2).otherwise(0.0) + 0.02 * (F.col("x") - 0.5)
    return daily.select("site", "day", t.alias("t"), level.alias("value"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.col("label").cast("long").alias("cls"), F.col("embedding").cast("array<double>").alias("bands"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.floor(F.col("l_partkey") / 10).alias("cx"), F.floor(F.col("l_suppkey") / 10).alias("cy"), (F.col("l_extendedprice") / 1e5).alias("v"), F.col("l_quantity").alias("dn")
    )


#: The same shapes as SQL expressions for a WITH clause.
SQL = {
    "scenes": """scenes AS (SELECT l_orderkey AS scene, CAST(l_linenumber AS BIGINT) AS part, (l_partkey % 50) // 10 AS prow, (l_partkey % 50) % 10 AS pcol,
        l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day, l_quantity / 50 AS green, l_discount * 5 AS red, l_tax * 5 AS blue, l_extendedprice / 1e5 AS nir,
        l_orderkey % 16 AS fmask, l_linestatus AS sensor, l_returnflag AS orbit FROM lineitem)""",
    "series": """series AS (SELECT o_custkey % 20 AS site, CAST(o_orderdate AS DATE) AS day, o_totalprice / 5e5 AS value, o_orderkey AS obs,
        o_orderstatus AS status, o_orderpriority AS grp FROM orders)""",
    "camera": """camera AS (SELECT event_id AS image, ts, CAST(ts AS DATE) AS day, ['West', 'North', 'South', 'East'][user_id % 4 + 1] AS imgroup,
        value / 500 AS green_ratio, event_type AS species, user_id AS plot FROM events)""",
    "chips": """chips AS (SELECT image, cls, pos, pos // 8 AS prow, pos % 8 AS pcol, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM
        (SELECT vec_id AS image, CAST(label AS BIGINT) AS cls, embedding, unnest(range(0, len(embedding))) AS pos FROM embeddings))""",
    "mosaics": """mosaics AS (SELECT vec_id // 4 AS image, (vec_id % 4) // 2 * 8 + pos // 8 AS prow, vec_id % 2 * 8 + pos % 8 AS pcol, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM
        (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS pos FROM embeddings))""",
    "meadows": """meadows AS (SELECT image, prow, pcol, kind, [90, 30, 80][kind + 1] AS r, [90, 70, 190][kind + 1] + CASE WHEN kind > 0 THEN more ELSE 0 END AS g, [90, 30, 60][kind + 1] AS b FROM
        (SELECT *, CAST(floor(abs(v) * 40) AS BIGINT) % 3 AS more, CASE WHEN prow < image % 4 THEN 0 WHEN pcol < 5 + image % 6 THEN 1 ELSE 2 END AS kind FROM mosaics))""",
    "spectra": """spectra AS (SELECT vec_id AS image, CAST(label AS BIGINT) AS cls, CAST(embedding AS DOUBLE[]) AS bands FROM embeddings)""",
    "grid": """grid AS (SELECT l_partkey AS x, l_suppkey AS y, l_partkey // 10 AS cx, l_suppkey // 10 AS cy, l_extendedprice / 1e5 AS v, l_quantity AS dn FROM lineitem)""",
}
