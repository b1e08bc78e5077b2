"""Recipe tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.operators import profiles as pr

CROP = "STRUCT<top: INT, bottom: INT, left: INT, right: INT>"
SCHEMA = f"""name STRING, expected_area_px INT, expected_width_px INT, expected_height_px INT,
fused_threshold DOUBLE, noise_threshold DOUBLE, single_min_ratio DOUBLE, unknown_max_ratio DOUBLE,
belt_adaptive_block INT, camera_exposure_us INT, camera_gain DOUBLE, roi_split_x INT, transfer_line_x INT,
feed_darker BOOLEAN, belt_darker BOOLEAN, belt_crop {CROP}, feed_crop {CROP},
belt_min_solidity DOUBLE, belt_max_aspect_ratio DOUBLE, ref_circularity_mean DOUBLE, ref_circularity_min DOUBLE,
ref_solidity_mean DOUBLE, ref_solidity_min DOUBLE, circularity_tolerance DOUBLE, solidity_tolerance DOUBLE,
fused_merge_distance_factor DOUBLE, dilation_kernel_size INT, transfer_bridge_width_px INT,
tripwire_half_width_px INT, tripwire_occupancy_threshold DOUBLE, tripwire_debounce_frames INT"""
# Defaults of fields that no operator takes as a parameter
MORE_DEFAULTS = {"camera_exposure_us": 2000, "camera_gain": 0.0, "feed_darker": True, "belt_darker": False,
                 "dilation_kernel_size": 11}


def read(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Recipes with declared types; absent fields take their defaults."""
    from linewatch.fixed import RECIPE_DEFAULTS
    raw = spark.read.schema(SCHEMA).format(fmt).load(path)
    zero = F.struct(*[F.lit(0).alias(s) for s in pr.CROP_SIDES])
    filled = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in {**RECIPE_DEFAULTS, **MORE_DEFAULTS}.items()
              if k in raw.columns}
    filled |= {c: F.coalesce(F.col(c), zero) for c in pr.CROPS}
    return raw.withColumns(filled)


def check(df: DataFrame) -> DataFrame:
    """Violations of bounds, plus duplicate names and an empty table."""
    twice = df.groupBy("name").count().where("count > 1").select("name", F.lit("name.duplicate").alias("field"))
    none = (df.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
            .select(F.lit("").alias("name"), F.lit("profiles.empty").alias("field")))
    return pr.violations(df).unionByName(twice).unionByName(none)
