"""Readers and writers of the file shapes in the field: delimited text, images, pixel tables.

Schemas are explicit; one missing-value text (``NA``) becomes NULL; NaN becomes NULL.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import no_nan



def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``; a temporary one for local sessions only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root}/verdance"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="verdance-work-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


# Columns of the files.
SCHEMAS = {
    "gcc_observed": "`system:time_start` string, GCC double",
    "gcc_predicted": "`system:time_start` string, GCC_predicted double",
    "s1_observed": "`system:time_start` string, S1ratio double",
    "s1_predicted": "`system:time_start` string, S1ratio_predicted double",
    "poi_export": "date string, GCC double, GCC_predicted double, timestamp bigint",
    "insects": "date date, total double",
    "bvoc": "Date string, Species string, Plot_ID string, Total_BVOC double, GreenRatio double",
    "aerosol": "date bigint, absorbing_aerosol_index double",
    "hcho": "date bigint, tropospheric_HCHO_column_number_density double, cloud_fraction double, HCHO_slant_column_number_density double",
    "class_precision": "`Class name` string, Images int, Precision double",
    "closeup_green_ratio": "filename string, green_ratio double",
    "closeup_threshold": "filename string, green_ratio double, threshold double",
    "tower_simple": "filename string, datetime string, green_ratio double, green_mean double, green_std double",
    "tower_kmeans": "filename string, datetime string, "
    + ", ".join(f"{part}_{m} double" for part in ("green", "class1", "class2") for m in ("ratio", "mean", "std", "norm"))
    + ", method string",
    "phenology": "year int, sos_date date, pos_date date, eos_date date, sos_doy int, pos_doy int, eos_doy int",
    "pixel_compare": "sat_row int, sat_col int, sat_x double, sat_y double, sat_value double, drone_pixel_count bigint, drone_valid_pixels bigint, "
    "drone_mean double, drone_median double, drone_min double, drone_max double, drone_std double",
    "polygon_stats": "polygon_id bigint, landcover_class string, band string, mean double, std double, count bigint",
    "homogeneity": "image string, resolution double, band string, index string, "
    + ", ".join(f"{m} double" for m in ("mean", "std", "cv", "min", "max", "entropy", "moran_i"))
    + ", "
    + ", ".join(f"glcm_{m} double" for m in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")),
}
#: Shapes whose files are parted by semicolons.
SEMICOLON = {"bvoc", "class_precision"}
IMAGE_NAMES = "*.{jpg,JPG,jpeg,JPEG,png,PNG}"


def without_nan(df: DataFrame) -> DataFrame:
    """NULL for NaN in every floating column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: no_nan(F.col(f"`{c}`")) for c in floats})


def read_table(spark: SparkSession, path: str | list[str], shape: str, file_name: bool = False) -> DataFrame:
    """Delimited files of a known shape; many files or folders are one table, if asked for with each row's file."""
    df = spark.read.csv(path, schema=SCHEMAS[shape], header=True, sep=";" if shape in SEMICOLON else ",", nullValue="NA")
    if file_name:
        df = df.select("*", F.col("_metadata.file_name").alias("source_file"))
    return without_nan(df)


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Delimited files with a header, NULL as ``NA``."""
    df.write.mode(mode).csv(path, header=True, sep=sep, nullValue="NA")


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """Images below a folder by Spark's image source; unreadable ones are left out or, if asked for, kept without pixels."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_NAMES).load(path)


def read_bytes(spark: SparkSession, path: str, names: str = IMAGE_NAMES) -> DataFrame:
    """Whole files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)


def write_raster(pixels: DataFrame, path: str, tile: int = 256, parameters: dict[str, str] | None = None) -> None:
    """A long pixel table by tiles, so that windows read few files; ``parameters`` go to a side table."""
    tiled = pixels.withColumn("tile_row", F.floor(F.col("prow") / tile)).withColumn("tile_col", F.floor(F.col("pcol") / tile))
    tiled.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)
    if parameters:
        rows = [(k, str(v)) for k, v in parameters.items()]
        pixels.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}_parameters")


def read_raster(spark: SparkSession, path: str, bands: Iterable[str] | None = None, window: tuple[int, int, int, int] | None = None, tile: int = 256) -> DataFrame:
    """Bands and window ``(row0, row1, col0, col1)``, ends left out, of a tiled table: other tiles aren't read."""
    df = spark.read.parquet(path)
    if window:
        r0, r1, c0, c1 = window
        df = df.where(F.col("tile_row").between(r0 // tile, (r1 - 1) // tile) & F.col("tile_col").between(c0 // tile, (c1 - 1) // tile))
        df = df.where((F.col("prow") >= r0) & (F.col("prow") < r1) & (F.col("pcol") >= c0) & (F.col("pcol") < c1))
    return df.select("prow", "pcol", *bands) if bands else df.drop("tile_row", "tile_col")
