"""Inspection tables derived from the benchmark parquet tables.

Each view reads whole tables. ``pieces`` carries no id and needs no shuffle;
``detections`` adds ``det_id`` and is clustered by frame once, so that every
later per-frame window or aggregate reuses that exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME = ["line_id", "frame_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> F.Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("o_orderkey * 10 div 38")
    ids = table(spark, sf_dir, "orders").select((number % 4).alias("line_id"), number.alias("frame_id")).distinct()
    return ids.select(*FRAME, (F.col("frame_id") * 100).alias("t_ms"),
                      F.lit(3200).alias("width_px"), F.lit(2200).alias("height_px"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.floor(F.col("l_quantity") * F.col("l_quantity") / 4)
    tall = F.round(F.col("l_discount") * 100) * 25
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 4").alias("frame_id"),
        (F.expr("l_orderkey div 4") % 4).alias("line_id"),
        (F.col("l_partkey") * 37 % 1432).cast("double").alias("cx"),
        (F.col("l_suppkey") * 131 % 2200).cast("double").alias("cy"),
        (F.lit(120) + side).cast("int").alias("width_px"),
        (F.lit(240) + tall).cast("int").alias("height_px"),
        F.floor((F.lit(120) + side) * (F.lit(240) + tall) * 785 / 1000).cast("long").alias("area_px"),
        F.round(F.lit(0.5) + F.col("l_tax") * 6, 4).alias("circularity"),
        F.round(F.lit(0.69) + (F.col("l_partkey") % 31) / F.lit(100.0), 4).alias("solidity"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


_RAW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).drop(*_RAW)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    within = (Window.partitionBy(*FRAME, "l_orderkey")
              .orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return (_pieces(spark, sf_dir).repartition(*FRAME)
            .withColumn("det_id", F.col("l_orderkey") * 1000 + F.row_number().over(within))
            .drop(*_RAW))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("line_id"), epoch_ms("ts").alias("t_ms"),
        F.col("event_id").alias("seq"),
        kind.isin("click", "view", "purchase").alias("running"),
        (kind == "error").alias("fault"), (kind == "signup").alias("ack"),
        kind.isin("view", "error").alias("belt_running"),
        (F.col("value") / F.lit(500.0)).alias("occupancy"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, big = F.col("event_type"), F.col("value") > 30
    is_fault = kind == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("line_id"), epoch_ms("ts").alias("t_ms"),
        F.to_date("ts").alias("event_date"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", F.when(big, "startup").otherwise("shutdown"))
         .when(is_fault, "fault_raised").when(kind == "purchase", "fault_cleared")
         .when(kind == "click", "calibration_done").otherwise("profile_change").alias("event_type"),
        F.concat(F.lit("P"), (F.col("user_id") % 7).cast("string")).alias("profile_name"),
        F.when(~is_fault, "").when(big, "FAULT_ROW_FUSED").otherwise("FAULT_UNKNOWN").alias("fault_reason"),
        F.when(is_fault, F.concat(F.lit("img-"), F.col("event_id").cast("string"), F.lit(".jpg")))
         .otherwise("").alias("image_filename"),
        F.col("props").alias("extra_json"))


def defect_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, no = F.col("event_type"), F.col("event_id")
    return (table(spark, sf_dir, "events")
            .where(((kind == "error") & (no % 5 != 0)) | ((kind == "view") & (no % 50 == 0)))
            .select(F.concat(F.lit("img-"), no.cast("string"), F.lit(".jpg")).alias("filename"),
                    epoch_ms("ts").alias("t_ms"), F.col("user_id").alias("line_id")))


# Recipes used by the queries (name, width, area, fused, noise)
PROFILE_VALUES = """('Default', 290, 60000, 1.5D, 0.5D), ('P0', 290, 60000, 1.5D, 0.5D),
    ('P1', 260, 50000, 1.4D, 0.5D), ('P2', 320, 75000, 1.5D, 0.4D),
    ('P3', 240, 42000, 1.6D, 0.3D), ('P4', 300, 66000, 1.5D, 0.5D),
    ('P5', 280, 58000, 1.4D, 0.4D)"""


def profiles(spark: SparkSession) -> DataFrame:
    """Seven fixed recipes as an inline table: its exact size is known to the
    optimizer, so joins with it are broadcast without a hint."""
    return spark.sql(f"""
        SELECT name, width AS expected_width_px, width AS expected_height_px, area AS expected_area_px,
               fused AS fused_threshold, noise AS noise_threshold,
               0.5D AS single_min_ratio, 2.5D AS unknown_max_ratio
        FROM VALUES {PROFILE_VALUES} AS t(name, width, area, fused, noise)""")


BANDS = [(i * 275.0, (i + 1) * 275.0) for i in range(8)]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "embeddings")
            .select(F.col("vec_id").alias("frame_id"), (F.col("vec_id") % 4).alias("line_id"),
                    F.posexplode("embedding").alias("p", "e"))
            .select("frame_id", "line_id", (F.col("p") % 8).alias("x"),
                    F.expr("p div 8").cast("int").alias("y"),
                    F.least(F.lit(255), F.greatest(F.lit(0), F.floor(
                        F.lit(128) + F.col("e").cast("double") * 240))).cast("int").alias("v")))


def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_id"), (F.col("vec_id") % 4).alias("line_id"),
        F.transform("embedding", lambda e: e.cast("double") + 1.0).alias("profile"))


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe per part: grows with the data and holds out-of-range rows on purpose."""
    size, price, key = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    name = F.concat(F.when(key % 11 == 0, "R/").otherwise("R-"), key.cast("string"),
                    F.when(key % 13 == 0, " ").otherwise(""))
    return table(spark, sf_dir, "part").select(
        name.alias("name"),
        (size * 10 - 20).cast("int").alias("expected_width_px"),
        (size * 9 - 9).cast("int").alias("expected_height_px"),
        (size * size * 60).cast("int").alias("expected_area_px"),
        F.round(F.lit(0.98) + size / F.lit(50.0), 4).alias("fused_threshold"),
        F.round((key % 100) / F.lit(95.0), 4).alias("noise_threshold"),
        F.lit(0.5).alias("single_min_ratio"),
        F.round(F.lit(0.99) + (key % 7) / F.lit(2.0), 4).alias("unknown_max_ratio"),
        (F.lit(1800) - size * 36).cast("int").alias("roi_split_x"),
        F.lit(2400).alias("transfer_line_x"),
        (key % 50).cast("int").alias("camera_gain"),
        F.struct((size - 2).alias("top"), F.lit(0).alias("bottom"),
                 (size - 1).alias("left"), F.lit(0).alias("right")).alias("belt_crop"))
