"""Summaries of stops, rows, frames and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.operators.scan import Previous, Total, scan


def cycle_summary(df: DataFrame, positions: Sequence[str] = ()) -> DataFrame:
    """Ordered lists per cycle. A cycle holds at most one stop per grid row, so
    the lists stay short. Columns named in ``positions`` (tangents, boundaries) become
    arrays ``<name>_list`` in the same order, nulls kept."""
    items = F.array_sort(F.collect_list(F.struct("t_ms", "seq", "row_no", "clearing_ms", "reason", *positions)))
    out = df.groupBy("line_id", "cycle").agg(items.alias("x"), (F.max("t_ms") - F.min("t_ms")).alias("total_ms"))

    def joined(field):
        return F.array_join(F.transform("x", lambda s: s[field].cast("string")), ",")
    return out.select("line_id", "cycle", F.size("x").cast("long").alias("rows_fired"), joined("row_no").alias("row_list"),
                      joined("clearing_ms").alias("clearing_list"), joined("reason").alias("reasons"), "total_ms",
                      *[F.col(f"x.{c}").alias(f"{c}_list") for c in positions])


def perf_summary(df: DataFrame, seconds: int = 1, stages: Sequence[str] = ()) -> DataFrame:
    """Timing per line and window; a window holds the frames of its seconds only.
    Every stage column named adds its own mean."""
    start = F.floor(F.col("t_ms") / (seconds * 1000)) * (seconds * 1000)
    return df.groupBy("line_id", start.alias("start_ms")).agg(
        F.count(F.lit(1)).alias("frames"), (F.count(F.lit(1)) / float(seconds)).alias("fps"),
        F.round(F.avg("total_ms"), 4).alias("mean_ms"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in stages],
        (F.count_if("detected") / float(seconds)).alias("detections_per_s"),
        F.median("total_ms").alias("median_ms"), F.max("total_ms").alias("max_ms"))


def drop_summary(df: DataFrame, period_ms: int = 100, window_ms: int = 5000) -> DataFrame:
    """Frames missing from a steady rate, counted per window."""
    out = scan(df, {"_p": Previous("t_ms")})
    missed = F.floor((F.col("t_ms") - F.col("_p")) / period_ms) - 1
    return (out.withColumn("dropped", F.greatest(F.lit(0), F.coalesce(missed, F.lit(0))))
            .groupBy("line_id", (F.floor(F.col("t_ms") / window_ms) * window_ms).alias("start_ms"))
            .agg(F.count(F.lit(1)).alias("frames"), F.sum("dropped").alias("dropped")))


def session_summary(fires: DataFrame) -> DataFrame:
    """Per line: stops, overshoot, and the row of the largest overshoot (first on ties)."""
    worst = F.struct("overshoot_px", -F.col("t_ms"), -F.col("seq"))
    return fires.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("rows_fired"), F.count(F.lit(1)).alias("latches"),
        F.round(F.avg("overshoot_px"), 4).alias("avg_overshoot_px"),
        F.max("overshoot_px").alias("max_overshoot_px"), F.max_by("row_no", worst).alias("max_row"))


def row_quality(frames: DataFrame, fired: str, full: str, value: str) -> DataFrame:
    """Frames a row needed until it fired; the firing frame belongs to that row."""
    shot = F.when(F.col(fired), 1).otherwise(0).cast("long")
    out = scan(frames, {"_n": Total(shot)}).withColumn("fire_no", F.col("_n") - shot)
    return out.groupBy("line_id", "fire_no").agg(
        F.count(F.lit(1)).alias("total_frames"), F.count_if(full).alias("full_frames"),
        F.count_if(F.col(value).isNull()).alias("fallback_frames"))


def inspection_counts(windows: DataFrame) -> DataFrame:
    bad = F.count_if("latched")
    return windows.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("inspected"), F.count_if(~F.col("latched")).alias("good"), bad.alias("defects"),
        F.round(bad / F.count(F.lit(1)) * 100, 4).alias("defect_rate"))


def verdict_counts(verdicts: DataFrame, distinct: str | None = None) -> DataFrame:
    """Verdicts by line and hour with subtotals, one column per verdict.

    Frames may be delivered twice: ``distinct`` adds their distinct number,
    "exact" or "approx" (a sketch, which shuffles no frame ids).
    """
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in fixed.VERDICTS]
    if distinct is not None:
        number = {"exact": F.count_distinct, "approx": F.approx_count_distinct}[distinct]
        counts.append(number(F.col("frame_id")).alias("distinct_frames"))
    return (verdicts.rollup("line_id", "hour")
            .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("frames"), *counts))


def starvation(front_rows: DataFrame, line) -> DataFrame:
    """Frames in which the row would fire but a column has no piece at its pointer."""
    would_fire = F.col("tangent") <= line
    return front_rows.groupBy("line_id").agg(
        F.count_if(would_fire).alias("would_fire"),
        F.count_if(would_fire & F.col("any_column_empty")).alias("starved_frames"),
        F.sum(F.when(would_fire, F.col("columns") - F.col("columns_used")).otherwise(0)).alias("starved_columns"))


def _mode(signals: DataFrame) -> Column:
    return F.col("mode") if "mode" in signals.columns else F.lit("production")


def status_snapshot(log: DataFrame, signals: DataFrame) -> DataFrame:
    """Latest values per line; both sides reduce to one row per line before the join.
    A line that only logs or only has signals is there too. ``signals`` may carry the
    operating ``mode``; without one a line is in production."""
    last = F.struct("t_ms", "seq")
    faults = F.col("event_type") == "fault_raised"
    events = log.groupBy("line_id").agg(
        F.max_by("profile_name", last).alias("profile_name"),
        F.max_by("event_type", last).alias("last_event"),
        F.count_if(faults).alias("faults"), F.count(F.lit(1)).alias("events"))
    now = signals.groupBy("line_id").agg(
        F.max_by(F.struct("running", "fault", "ack", "t_ms", _mode(signals).alias("mode")), last).alias("s"))
    zero = F.lit(0).cast("long")
    return events.join(now, "line_id", "full").select(
        "line_id", "profile_name", "last_event", F.coalesce("faults", zero).alias("faults"), F.coalesce("events", zero).alias("events"),
        F.when(F.col("s.fault"), fixed.FAULT).when(F.col("s.running"), fixed.TRACKING)
        .otherwise(fixed.WAITING).alias("state"),
        F.coalesce("s.mode", F.lit("production")).alias("mode"), F.struct("s.running", "s.fault", "s.ack").alias("signals"),
        F.col("s.t_ms").alias("last_ms"))


def status_json(snapshot: DataFrame) -> DataFrame:
    body = F.struct("state", "mode", F.col("profile_name").alias("profile"), "signals",
                    F.struct("events", "faults").alias("counts"), "last_ms")
    return snapshot.select("line_id", F.to_json(body).alias("status"))
