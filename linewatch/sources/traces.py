"""Trace log lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line head, then the fields it carries as (key, type)
KINDS = {
    "FIRE-TRACE": [("frame_id", "long"), ("state", "string"), ("active_row", "int"), ("tangent", "int"),
                   ("transfer_x", "int"), ("boundary", "int"), ("pieces_total", "int"),
                   ("pieces_excluded", "int"), ("fire_eligible", "boolean"), ("fired", "boolean")],
    "FIRE OVERSHOOT": [("row", "int"), ("fired_tangent", "int"), ("transfer_x", "int"), ("overshoot_px", "int"),
                       ("clearing_duration_ms", "int"), ("clearing_exit_reason", "string")],
    "INTER-ROW-STOP-GAP": [("row_prev", "int"), ("row_curr", "int"), ("gap_ms", "int")],
    "ROW DETECTION QUALITY": [("row", "int"), ("total_frames", "int"), ("frames_with_full_group", "int"),
                              ("frames_fallback", "int")],
    "CYCLE-SUMMARY": [("rows_fired", "string"), ("fire_tangents", "string"), ("boundaries", "string"),
                      ("clearing_durations_ms", "string"), ("armed_reasons", "string"), ("total_cycle_ms", "int")],
    "STOP-LATENCY": [("fire_to_falling_edge", "int")],
    "FRAME-GAP": [("dt", "int")],
    "SLOW FRAME": [("total", "int"), ("detect", "int"), ("rowgroup", "int"), ("display", "int")],
    "CLUSTER-TRACK": [("id", "int"), ("front", "int")],
}
STATE_LINE = r"STATE: (\S+): (.*) -> (.*) \(trigger=([^)]*)\)"
CLUSTER_OUTCOME = r"CLUSTER-TRACK: .* (matched|new|lost)$"
LINE_TIME = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})"


def kind_of(line: Column) -> Column:
    heads = [F.when(line.contains(h), h) for h in KINDS] + [F.when(line.contains("STATE: "), "STATE")]
    return F.coalesce(*heads)


def field(line: Column, key: str, kind: str) -> Column:
    """Value after ``key=``; lists run to their closing bracket; 'none' and units drop out."""
    raw = F.regexp_extract(line, rf"(?:^|\s){key}=(\[[^\]]*\]|\S+)", 1)
    if kind in ("int", "long"):
        return F.regexp_extract(raw, r"^(-?\d+)", 1).try_cast(kind)
    return F.when(raw != "", raw).try_cast(kind)


def parse(lines: DataFrame) -> DataFrame:
    """One row per known line: time, kind and its fields as a map of text."""
    line = F.col("value")
    parsed = lines.withColumn("kind", kind_of(line)).where(F.col("kind").isNotNull())
    return parsed.withColumn("ts", F.try_to_timestamp(F.regexp_extract(line, LINE_TIME, 1),
                                                      F.lit("yyyy-MM-dd HH:mm:ss.SSS")))


def typed(parsed: DataFrame, kind: str) -> DataFrame:
    """The lines of one kind with one column per field."""
    line = F.col("value")
    rows = parsed.where(F.col("kind") == kind)
    if kind == "STATE":
        names = ("field", "old", "new", "trigger")
        return rows.select("ts", *[F.regexp_extract(line, STATE_LINE, i + 1).alias(n) for i, n in enumerate(names)])
    fields = [field(line, k, ty).alias(k) for k, ty in KINDS[kind]]
    if kind == "CLUSTER-TRACK":
        fields.append(F.regexp_extract(line, CLUSTER_OUTCOME, 1).alias("outcome"))
    return rows.select("ts", *fields)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
