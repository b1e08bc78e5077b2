"""Batch twins of the line state machine and the row phase, and stop input rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.operators import rows
from linewatch.operators import signals as sg
from linewatch.operators.scan import DAY_MS, LastKnown, Total, scan
from linewatch.sources.tables import FRAME
from linewatch.streaming import machines as mc
from linewatch.streaming.run import build_table, finite_scan, fold, fold_chained


def _index(value: Column, names) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), value).cast("int") - 1


def _name(number: Column, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), number + 1)


def line_state(events: DataFrame, clear_frames: int = 5) -> DataFrame:
    """State machine of a line over ``line_id, t_ms, seq, event [, reason]``.

    State, clean count and flags are one automaton with few states; the two
    counters and the last reason follow from its transitions by one scan.
    """
    if clear_frames < 1:
        raise ValueError("clear_frames must be at least 1")
    states, table = build_table(lambda s, e: mc.line_step_flags(s, e, clear_frames),
                                (fixed.WAITING, 0, False, False, False), mc.LINE_EVENTS)
    reasons = F.col("reason") if "reason" in events.columns else F.lit("")
    numbered = events.select("line_id", "t_ms", "seq", "event", reasons.alias("reason"),
                             _index(F.col("event"), mc.LINE_EVENTS).alias("symbol"))
    out = finite_scan(numbered, table)
    event, fields = F.col("event"), list(zip(*states))
    after = F.col("state_after")
    out = out.withColumns({
        "clean_frames": _name(after, fields[1]), "running": _name(after, fields[2]), "stop": _name(after, fields[3]),
        "fault_active": _name(after, fields[4]), "state_after": _name(after, fields[0]),
        "state_before": _name(F.col("state_before"), fields[0])})
    was, now = F.col("state_before"), F.col("state_after")
    raised = event.isin("belt_fault", "verdict_fault") & (was != fixed.FAULT) & (now == fixed.FAULT)
    stopped = (event == "emergency") & (now == fixed.FAULT)
    pulse = (event == "verdict_ok") & (was == fixed.INSPECTING)
    why = F.when(raised, F.col("reason")).when(stopped, "emergency_stop")
    out = scan(out, {"fault_count": Total(sg.flag(raised).cast("long")), "pulse_count": Total(sg.flag(pulse).cast("long")),
                     "fault_reason": LastKnown(why)})
    return (out.withColumns({"fault_reason": F.coalesce("fault_reason", F.lit("")), "ignored": late_result(event, was)})
            .drop("symbol", "reason"))


def late_result(event: Column, state_before: Column) -> Column:
    """A verdict outside inspection is a late result and has no effect."""
    return event.isin("verdict_ok", "verdict_fault") & (state_before != fixed.INSPECTING)


def row_phase(df: DataFrame, occupied: Column, debounce: int = 2, clear_frames: int = 3,
              forget_on_rising: bool = True) -> DataFrame:
    """Phase of the row at the line, with stop set and stop clear commands."""
    symbols = [(e, r, o) for e, r in ((None, True), (None, False), ("rising", True), ("falling", False))
               for o in (False, True)]
    states, table = build_table(lambda s, x: mc.phase_step(s, x, debounce, clear_frames, forget_on_rising),
                                mc.PHASE_START, symbols)
    edge = F.coalesce("edge", F.lit("-"))
    code = (F.when(edge == "rising", 4).when(edge == "falling", 6).when(F.col("running"), 0).otherwise(2)
            + sg.flag(occupied))
    edged = sg.with_edges(df.withColumn("_occ", occupied)).withColumn("symbol", code.cast("int"))
    out = finite_scan(edged, table)
    names = [s[0] for s in states]
    was, now = _name(F.col("state_before"), names), _name(F.col("state_after"), names)
    out = out.withColumns({"phase_before": was, "phase_after": now})
    stop = (F.col("phase_before") == mc.IDLE) & (F.col("phase_after") == mc.AT_LINE)
    clear = (F.col("phase_before") == mc.AT_LINE) & (F.col("phase_after") == mc.IDLE)
    return (out.withColumn("command", F.when(stop, "stop").when(clear, "clear"))
            .drop("symbol", "state_before", "state_after", "_occ"))


def row_fronts(detections: DataFrame, frames: DataFrame, gap: float, columns: int) -> DataFrame:
    """Front of every cleaned row as an array per frame; empty frames included."""
    cleaned = rows.reject_outliers(rows.group_by_gap(detections, gap), columns).where(~F.col("rejected"))
    fronts = cleaned.groupBy(*FRAME, "row_id").agg(F.min("edge").alias("front"))
    lists = fronts.groupBy(*FRAME).agg(F.array_sort(F.collect_list("front")).alias("fronts"))
    return (frames.join(lists, FRAME, "left")
            .withColumn("fronts", F.coalesce("fronts", F.array().cast("array<double>"))))


def row_xs(detections: DataFrame, frames: DataFrame) -> DataFrame:
    lines = rows.group_into_rows(detections)
    lists = lines.groupBy(*FRAME).agg(F.array_sort(F.collect_list("row_x")).alias("row_xs"))
    return (frames.join(lists, FRAME, "left")
            .withColumn("row_xs", F.coalesce("row_xs", F.array().cast("array<double>"))))


def frame_edges(detections: DataFrame, frames: DataFrame, bands=None) -> DataFrame:
    """Leading edges (and columns) of a frame as arrays sorted front-first."""
    col = rows.column_index(F.col("cy"), bands) if bands else F.lit(0)
    piece = F.struct(rows.edge_of().alias("edge"), col.alias("col"))
    lists = detections.groupBy(*FRAME).agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    joined = frames.join(lists, FRAME, "left")
    empty = F.array().cast("array<struct<edge: double, col: int>>")
    p = F.coalesce("_p", empty)
    return joined.withColumns({"edges": F.transform(p, lambda x: x["edge"]),
                               "cols": F.transform(p, lambda x: x["col"])}).drop("_p")


def track_clusters(fronts: DataFrame, **limits) -> DataFrame:
    return fold(fronts, mc.Clusters(**limits), ["line_id", "cycle"], ["t_ms", "frame_id"])


def track_row_lines(xs: DataFrame, line_x: float, **limits) -> DataFrame:
    return fold(xs, mc.RowLines(line_x, **limits), ["line_id", "cycle"], ["t_ms", "frame_id"])


def row_stops(edges: DataFrame, machine: mc.Stops, chunk_ms: int = DAY_MS) -> DataFrame:
    """State lasts until the machine's own full reset, over any number of days; the
    length of a chunk does not change the result."""
    return fold_chained(edges, machine, ["line_id"], ["t_ms", "frame_id"], chunk_ms)


def rate_limit(frames: DataFrame, interval_ms: int = 100) -> DataFrame:
    """The limiter starts afresh in every cycle, as detection does."""
    return fold(frames, mc.RateLimit(interval_ms), ["line_id", "cycle"], ["t_ms", "frame_id"])


def fault_events(states: DataFrame) -> DataFrame:
    """Event log rows from the transitions, with the real previous state."""
    was, now = F.col("state_before"), F.col("state_after")
    kind = (F.when((now == fixed.FAULT) & (was != fixed.FAULT), "fault_raised")
            .when((was == fixed.FAULT) & (now == fixed.WAITING), "fault_cleared"))
    return (states.withColumn("event_type", kind).where(F.col("event_type").isNotNull())
            .select("line_id", "t_ms", "seq", "event_type",
                    F.when(F.col("event_type") == "fault_raised", F.col("fault_reason")).otherwise("").alias("fault_reason"),
                    "state_before", "state_after"))
