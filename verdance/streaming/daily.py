"""Daily means over a stream of camera rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import utc, utc_day
from ..sources.files import work_folder


def camera_stream(spark: SparkSession, path: str) -> DataFrame:
    """Camera rows from Parquet files as they arrive; ``path`` is a folder or a file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if "." in name else spark.readStream.schema(schema).parquet(path)
    group = F.element_at(F.array(*map(F.lit, ("West", "North", "South", "East"))), (F.col("user_id") % 4 + 1).cast("int"))
    return raw.select(utc(F.col("ts")).alias("ts"), group.alias("imgroup"), (F.col("value") / 500).alias("green_ratio"))


def daily_means(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Means by one-day window and group; rows later than ``late`` are dropped."""
    windowed = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "imgroup")
    return windowed.agg(F.avg("green_ratio").alias("green_ratio"), F.count("*").alias("n")).select(utc_day(F.unix_millis("window.start")).alias("day"), "imgroup", "green_ratio", "n")


def append_only(rows: DataFrame, path: str, checkpoint: str):
    """Write finished days to Parquet files, each once."""
    return daily_means(rows).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def run_batchwise(spark: SparkSession, path: str) -> DataFrame:
    """Run the stream through all there is now and return its result table.

    Each micro-batch writes the days it changed to files; of a day the last
    written state holds.  Nothing of the result passes through the driver.
    """
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/days/batch={number}")

    rows = daily_means(camera_stream(spark, path))
    rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(f"{folder}/days")
    return states.groupBy("day", "imgroup").agg(F.max(F.struct("batch", "green_ratio", "n")).alias("x")).select("day", "imgroup", "x.green_ratio", "x.n")
