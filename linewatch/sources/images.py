"""Image folders: listing frames and defect images, and raw planes to pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewatch import fixed

# Defect image name and its time stamp
DEFECT_NAME = r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}-\d{1,6})-([A-Z_]+)\.jpg$"
DEFECT_STAMP = "yyyy-MM-dd-HH-mm-ss-SSSSSS"


def scan_frames(spark: SparkSession, folder: str, pattern: str | None = None,
                content: bool = False) -> DataFrame:
    """Image files with their index in path order per directory.

    Without ``content`` the files are only listed, never opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder)
    if not content:
        files = files.drop("content")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = files.where(suffix.isin(*fixed.IMAGE_SUFFIXES)).withColumn(
        "directory", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    order = Window.partitionBy("directory").orderBy("path")
    return files.withColumn("frame_index", F.row_number().over(order) - 1)


def parse_defect_name(path: Column) -> dict[str, Column]:
    stamp = F.regexp_extract(path, DEFECT_NAME, 1)
    return {"taken": F.to_timestamp_ntz(F.when(stamp != "", stamp), F.lit(DEFECT_STAMP)),
            "verdict": F.regexp_extract(path, DEFECT_NAME, 2)}


def scan_defect_images(spark: SparkSession, folder: str) -> DataFrame:
    """Defect images with time and verdict from the name, newest first."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.jpg").load(folder).select("path", "modificationTime", "length"))
    return (files.withColumns(parse_defect_name(F.col("path")))
            .where(F.col("verdict") != "").orderBy(F.col("taken").desc(), "path"))


def gray(blue: Column, green: Column, red: Column) -> Column:
    # Luma weights
    return F.round(red * 0.299 + green * 0.587 + blue * 0.114).cast("int")


def array_to_pixels(df: DataFrame, plane: str, width: int, channels: int = 1) -> DataFrame:
    """Interleaved plane in an array column (1 = gray, 3 = BGR, 4 = BGRA) to pixels."""
    groups = F.transform(F.sequence(F.lit(0), F.expr(f"size({plane}) div {channels}") - 1),
                         lambda i: F.slice(plane, i * channels + 1, channels))
    out = df.select("line_id", "frame_id", F.posexplode(groups).alias("_p", "_c"))
    c = F.col("_c")
    value = c[0].cast("int") if channels == 1 else gray(c[0], c[1], c[2])
    return out.select("line_id", "frame_id", (F.col("_p") % width).alias("x"),
                      F.expr(f"_p div {width}").cast("int").alias("y"), value.alias("v"))


def bytes_to_pixels(df: DataFrame) -> DataFrame:
    """Raw 8-bit planes (``content, width, height, channels``) to pixels, one image at a time."""
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                plane = np.frombuffer(r.content, dtype=np.uint8).reshape(r.height, r.width, r.channels)
                if r.channels == 1:
                    v = plane[:, :, 0].astype(np.int32)
                else:
                    b, g, red = (plane[:, :, i].astype(np.float64) for i in range(3))
                    v = np.floor(red * 0.299 + g * 0.587 + b * 0.114 + 0.5).astype(np.int32)
                y, x = np.indices(v.shape)
                yield pd.DataFrame({"line_id": r.line_id, "frame_id": r.frame_id,
                                    "x": x.ravel(), "y": y.ravel(), "v": v.ravel()})
    return (df.select("line_id", "frame_id", "content", "width", "height", "channels")
            .mapInPandas(explode, "line_id long, frame_id long, x int, y int, v int"))
