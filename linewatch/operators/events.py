"""Event log: pairing, lookup, restarts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.operators.scan import LastKnown, NextKnown, Previous, scan

LIFECYCLE = ("startup", "shutdown")


def profile_at(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Recipe in force at each row: the latest change at or before it."""
    probe = rows.withColumns({"_kind": F.lit(1), "_to": F.lit(None).cast("string")})
    marks = changes.select("line_id", "t_ms", "seq", F.lit(0).alias("_kind"),
                           F.col("profile_name").alias("_to"))
    both = probe.unionByName(marks, allowMissingColumns=True)
    out = scan(both, {"active_profile": LastKnown("_to")}, order=("t_ms", "_kind", "seq"))
    return out.where(F.col("_kind") == 1).drop("_kind", "_to")


def fault_intervals(log: DataFrame) -> DataFrame:
    """Each raise with the next clear of its line; open if there is none."""
    faults = log.where(F.col("event_type").isin("fault_raised", "fault_cleared"))
    faults = faults.withColumn("_clear", F.when(F.col("event_type") == "fault_cleared", F.col("t_ms")))
    out = scan(faults, {"cleared_ms": NextKnown("_clear")})
    return out.where(F.col("event_type") == "fault_raised").select(
        "line_id", "seq", "fault_reason", F.col("t_ms").alias("raised_ms"), "cleared_ms",
        (F.col("cleared_ms") - F.col("t_ms")).alias("duration_ms"),
        F.col("cleared_ms").isNull().alias("is_open"))


def with_images(log: DataFrame, images: DataFrame) -> DataFrame:
    faults = log.where(F.col("image_filename") != "")
    found = images.select(F.col("filename").alias("image_filename"), F.col("t_ms").alias("image_ms"))
    return faults.join(found, "image_filename", "left")


def without_image(log: DataFrame, images: DataFrame) -> DataFrame:
    faults = log.where(F.col("image_filename") != "")
    return faults.join(images, F.col("image_filename") == F.col("filename"), "left_anti")


def orphan_images(log: DataFrame, images: DataFrame) -> DataFrame:
    return images.join(log.where(F.col("image_filename") != ""),
                       F.col("filename") == F.col("image_filename"), "left_anti")


def unexpected_restarts(log: DataFrame) -> DataFrame:
    """Startups whose lifecycle event before is not a shutdown; the first counts."""
    life = log.where(F.col("event_type").isin(*LIFECYCLE))
    out = scan(life, {"previous": Previous("event_type")})
    unplanned = F.coalesce(F.col("previous") != "shutdown", F.lit(True))
    return out.where((F.col("event_type") == "startup") & unplanned).select("line_id", "t_ms", "seq", "previous")


def events_by(log: DataFrame) -> DataFrame:
    """Counts by day, type and profile with all subtotals."""
    return (log.cube("event_date", "event_type", "profile_name")
            .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("events")))


def deduplicate(log: DataFrame) -> DataFrame:
    return log.dropDuplicates(["line_id", "t_ms", "seq", "event_type"])


def uptime(log: DataFrame) -> DataFrame:
    """Fault time and longest fault per line from the closed intervals."""
    closed = fault_intervals(log).where(~F.col("is_open"))
    return closed.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("faults"), F.sum("duration_ms").alias("fault_ms"),
        F.max("duration_ms").alias("longest_ms"))


def retain(log: DataFrame, days: int, today) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and number of rows removed per day; a partition predicate."""
    if days < 1:
        raise ValueError("days must be at least 1")
    limit = F.date_sub(today, days)
    kept = log.where(F.col("event_date") >= limit)
    removed = log.where(F.col("event_date") < limit).groupBy("event_date").agg(F.count(F.lit(1)).alias("removed"))
    return kept, removed
