"""Signal histories: edges, debounce, gaps, latches, windows.

Inputs carry ``line_id, t_ms, seq``; ``(t_ms, seq)`` orders the rows of a line.
Every function is exact over the whole history and is built on ``scan``, so one
busy line is spread over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.operators.scan import (DAY_MS, Following, Highest, LastKnown, NextKnown, Previous, Rises, Run,
                                      Since, scan)
from linewatch.streaming.run import build_table, finite_scan

KEY = ["line_id", "t_ms", "seq"]


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def with_edges(df: DataFrame, signal: str = "running", chunk_ms: int = DAY_MS) -> DataFrame:
    """``edge`` is rising, falling or NULL; the first sample of a line has none."""
    now, was = F.col(signal), F.col("_was")
    return (scan(df, {"_was": Previous(signal)}, chunk_ms=chunk_ms)
            .withColumn("edge", F.when(now & ~was, "rising").when(~now & was, "falling"))
            .drop("_was"))


def edges(df: DataFrame, signal: str = "running") -> DataFrame:
    return (with_edges(df, signal).where(F.col("edge").isNotNull()))


def edge_gaps(edge_rows: DataFrame) -> DataFrame:
    out = scan(edge_rows, {"_prev": Previous("t_ms")})
    return out.withColumn("since_edge_ms", F.col("t_ms") - F.col("_prev")).drop("_prev")


def cycles(df: DataFrame) -> DataFrame:
    """Cycle number: rising edges so far."""
    return scan(df, {"cycle": Rises("running")})


def runs(df: DataFrame, value: Column) -> DataFrame:
    """``run_pos``: how many rows in a row hold the present value (from 1);
    ``run_since_ms``: when that run began. Runs may span many chunks."""
    return (scan(df, {"_run": Run(value)})
            .withColumns({"run_pos": F.col("_run.pos"), "run_since_ms": F.col("_run.start.t_ms")}).drop("_run"))


def debounce(df: DataFrame, value: Column, n: int) -> DataFrame:
    """The stable value follows the raw one after ``n`` equal rows; it starts false."""
    def step(state, raw):
        stable, seen, held = state
        held = min(held + 1, n) if raw == seen else 1
        return (raw if held >= n else stable, raw, held)

    states, table = build_table(step, (False, None, 0), (False, True))
    out = finite_scan(df.withColumn("symbol", flag(value).cast("int")), table)
    return (out.withColumn("stable", F.element_at(F.array(*[F.lit(s[0]) for s in states]), F.col("state_after") + 1))
            .drop("symbol", "state_before", "state_after"))


def frame_gaps(df: DataFrame, limit_ms: int = fixed.FRAME_GAP_MS) -> DataFrame:
    """Long steps between successive running rows; standing still resets."""
    out = scan(df, {"_t": Previous("t_ms"), "_r": Previous("running")})
    gap = F.col("t_ms") - F.col("_t")
    return (out.where(F.col("running") & F.col("_r") & (gap > limit_ms))
                .withColumn("gap_ms", gap).drop("_t", "_r"))


def inter_stop_gap(fires: DataFrame) -> DataFrame:
    out = scan(fires, {"_t": Previous("t_ms"), "row_prev": Previous("row_no")})
    return (out.where(F.col("_t").isNotNull())
                .withColumn("gap_ms", F.col("t_ms") - F.col("_t")).drop("_t"))


def stale_frames(df: DataFrame, value: str, full: str, cap: int, struggling_at: int = 11) -> DataFrame:
    """Rows since the last fresh value and since the last full group, each flagged once."""
    out = scan(df, {"stale": Since(F.col(value).isNotNull()), "since_full": Since(F.col(full))})
    return out.withColumns({"exceeded": F.col("stale") == cap + 1, "struggling": F.col("since_full") == struggling_at})


def carry_forward(df: DataFrame, value: str, most: int = 5) -> DataFrame:
    """Hold the last value for at most ``most`` missing rows and mark it fallback."""
    out = scan(df, {"_stale": Since(F.col(value).isNotNull()), "_last": LastKnown(value)})
    usable = F.col("_last").isNotNull() & (F.col("_stale") <= most)
    return (out.withColumns({"held": F.when(usable, F.col("_last")), "fallback": usable & F.col(value).isNull()})
            .drop("_stale", "_last"))


def state_changes(df: DataFrame, state: str, trigger: str) -> DataFrame:
    out = scan(df, {"old": Previous(state)})
    return (out.where(F.col("old") != F.col(state))
                .select(*KEY, "old", F.col(state).alias("new"), F.col(trigger).alias("trigger")))


def heartbeat_gaps(df: DataFrame, alive: str, limit_ms: int = 1000) -> DataFrame:
    """Silences of a bit that must keep toggling."""
    out = scan(df, {"_was": Previous(alive)})
    toggles = out.where(F.col("_was").isNull() | (F.col("_was") != F.col(alive))).select(*KEY)
    out = scan(toggles, {"from_ms": Previous("t_ms")})
    gap = F.col("t_ms") - F.col("from_ms")
    return (out.where(gap > limit_ms)
            .select("line_id", "from_ms", F.col("t_ms").alias("to_ms"), gap.alias("silent_ms")))


def stop_latency(df: DataFrame, stop: Column, hold_ms: int = fixed.STOP_HOLD_MS) -> DataFrame:
    """From each stop to the next falling edge, or to the end of the hold time.

    A stop is only set while running, so the next falling edge is the next row
    that does not run.
    """
    out = scan(df, {"_next": NextKnown(F.when(~F.col("running"), F.col("t_ms")))})
    acked = F.coalesce(F.col("_next") - F.col("t_ms") <= hold_ms, F.lit(False))
    return out.where(stop & F.col("running")).select(
        *KEY, F.when(acked, F.col("_next") - F.col("t_ms")).otherwise(F.lit(hold_ms)).cast("long").alias("latency_ms"),
        F.when(acked, "plc_ack").otherwise("timeout").alias("reason"))


def stop_releases(df: DataFrame, stop: Column, hold_ms: int = fixed.STOP_HOLD_MS) -> DataFrame:
    """One release per held stop: every further stop while it is held sets the
    time again, so the hold counts from the last one. Batch twin of ``StopLatch``.

    Only stops and rows that do not run matter, so the row after a stop tells
    whether it is set again, acknowledged or runs out.
    """
    marks = df.where(~F.col("running") | stop).select(*KEY, "running")
    out = scan(marks, {"_next": Following(F.struct("t_ms", "running"))})
    soon = F.coalesce(F.col("_next.t_ms") - F.col("t_ms") <= hold_ms, F.lit(False))
    acked = soon & ~F.col("_next.running")
    return out.where(F.col("running") & (~soon | acked)).select(
        *KEY, F.when(acked, F.col("_next.t_ms")).otherwise(F.col("t_ms") + hold_ms).alias("released_ms"),
        F.when(acked, "plc_ack").otherwise("timeout").alias("reason"))


def latch_table(n: int, m: int, windowed: bool) -> tuple[list, list[list[int]]]:
    """States ``(armed, count, latched now, belt before)``; symbols ``belt * 2 + faulty``.

    ``n`` faulty rows in a row while armed latch; ``m`` clean rows in a row arm
    again. With ``windowed``, rows count only while the belt runs, an opening window
    arms and forgets, and a window that has latched is spent: it latches once.
    """
    def step(state, symbol):
        armed, count, _, belt_before = state
        belt, faulty = divmod(symbol, 2)
        if windowed:
            if not belt:
                return (armed, count, False, 0)
            if not belt_before:
                armed, count = True, 0
            if not armed:
                return (False, 0, False, belt)
        # Only faults count while armed and only clean rows while not.
        count = count + 1 if bool(faulty) == armed else 0
        if count < (n if armed else m):
            return (armed, count, False, belt if windowed else 0)
        return (not armed, 0, armed, belt if windowed else 0)

    return build_table(step, (True, 0, False, 0), range(4))


def with_latch(df: DataFrame, faulty: Column, n: int = 3, m: int = 3, belt: Column | None = None) -> DataFrame:
    """``latched`` marks rows on which a fault latches; see ``latch_table``."""
    states, table = latch_table(n, m, belt is not None)
    symbol = flag(faulty) + (0 if belt is None else flag(belt) * 2)
    out = finite_scan(df.withColumn("symbol", symbol.cast("int")), table)
    return (out.withColumn("latched", F.element_at(F.array(*[F.lit(s[2]) for s in states]), F.col("state_after") + 1))
            .drop("symbol", "state_before", "state_after"))


def latch(df: DataFrame, faulty: Column, n: int = 3, m: int = 3, belt: Column | None = None) -> DataFrame:
    """Rows on which a fault latches; with ``belt``, at most one per window in which it is true."""
    # Python sees the columns it needs
    thin = df.select(*KEY, faulty.alias("_bad"), F.lit(True).alias("_belt") if belt is None else belt.alias("_belt"))
    return with_latch(thin, F.col("_bad"), n, m, None if belt is None else F.col("_belt")).where("latched").select(*KEY)


def self_clear(df: DataFrame, faulty: Column, n: int = 5) -> DataFrame:
    """Rows on which an active fault clears by ``n`` clean rows in a row."""
    def step(state, bad):
        active, clean, _ = state
        if bad:
            return (True, 0, False)
        if not active:
            return (False, 0, False)
        return (True, clean + 1, False) if clean + 1 < n else (False, 0, True)

    states, table = build_table(step, (False, 0, False), (False, True))
    out = finite_scan(df.select(*KEY, flag(faulty).cast("int").alias("symbol")), table)
    cleared = F.element_at(F.array(*[F.lit(s[2]) for s in states]), F.col("state_after") + 1)
    return out.where(cleared).select(*KEY)


def islands(df: DataFrame, active: Column) -> DataFrame:
    """One row per stretch of ``active`` rows: first row, last row, first row after it."""
    out = scan(df.withColumn("_on", active), {"_run": Run(F.col("_on")), "_then": Following("t_ms")})
    # Partial aggregation per (line, opening) runs before the shuffle.
    return (out.where("_on").groupBy("line_id", F.col("_run.start").alias("_start"))
            .agg(F.min("t_ms").alias("open_ms"), F.max("t_ms").alias("last_ms"), F.max_by("_then", F.struct("t_ms", "seq")).alias("close_ms"),
                 F.count(F.lit(1)).alias("frames")))


def inspection_windows(df: DataFrame, n: int, m: int) -> DataFrame:
    """Belt windows with whether a fault latched inside; opening resets the latch."""
    thin = df.select(*KEY, "belt_running", "fault")
    # The scan goes below the automaton: what is worked out twice is then JVM work.
    scanned = scan(thin, {"_run": Run(F.col("belt_running")), "_then": Following("t_ms")})
    flat = scanned.select(*KEY, "belt_running", "fault", "_then", F.col("_run.start.seq").alias("_start"))
    out = with_latch(flat, F.col("fault"), n, m, F.col("belt_running"))
    return (out.where("belt_running").groupBy("line_id", "_start")
            .agg(F.min("t_ms").alias("open_ms"), F.max_by("_then", F.struct("t_ms", "seq")).alias("close_ms"),
                 F.count(F.lit(1)).alias("frames"), F.bool_or("latched").alias("latched")).drop("_start"))


def in_window(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows inside ``[open_ms, close_ms)`` of a window of their line, each once.

    Windows may overlap and nest. Of those opened so far the one that closes
    last decides (of several the latest opening), carried on as a running
    maximum: no range join that pairs rows with windows. An open end (NULL)
    lasts for good.
    """
    window = F.struct(F.col("close_ms").isNull().alias("for_good"), "close_ms", "open_ms")
    marks = windows.select("line_id", F.col("open_ms").alias("t_ms"), F.lit(-1).cast("long").alias("seq"),
                           window.alias("_win"))
    both = df.unionByName(marks, allowMissingColumns=True)
    out = scan(both, {"_in": Highest("_win")})
    inside = F.col("_in.for_good") | (F.col("t_ms") < F.col("_in.close_ms"))
    return (out.where(F.col("_win").isNull() & inside)
                .withColumn("window_open_ms", F.col("_in.open_ms")).drop("_win", "_in"))


def transfer_timeouts(df: DataFrame, transferring: Column, limit_ms: int = 5000) -> DataFrame:
    """First row of each transfer that has lasted longer than the limit."""
    out = scan(df.withColumn("_on", transferring), {"_run": Run(F.col("_on")), "_prev": Previous("t_ms")})
    since = F.col("_run.start.t_ms")
    late = F.col("_on") & (F.col("t_ms") - since > limit_ms)
    # The row before was in the same transfer and not late yet.
    first = late & (F.col("_run.pos") > 1) & (F.col("_prev") - since <= limit_ms)
    return out.where(first).select(*KEY, since.alias("since_ms"), (F.col("t_ms") - since).alias("lasted_ms"))


def sticky(df: DataFrame, result: Column, hold_ms: int = 3000) -> DataFrame:
    """Last result while it is not older than the hold time."""
    known = F.when(result.isNotNull(), F.struct(F.col("t_ms").alias("t"), result.alias("r")))
    out = scan(df.withColumn("_known", known), {"_last": LastKnown("_known")})
    fresh = F.col("t_ms") - F.col("_last")["t"] <= hold_ms
    return out.withColumn("shown", F.when(fresh, F.col("_last")["r"])).drop("_known", "_last")


def running_sessions(df: DataFrame, gap_ms: int) -> DataFrame:
    """Activity sessions: running rows no further apart than the gap."""
    out = scan(df.where("running"), {"_t": Previous("t_ms")})
    starts = F.col("_t").isNull() | (F.col("t_ms") - F.col("_t") >= gap_ms)
    out = scan(out.withColumn("_s", F.when(starts, F.struct("t_ms", "seq"))), {"_start": LastKnown("_s")})
    return (out.groupBy("line_id", "_start")
            .agg(F.min("t_ms").alias("start_ms"), (F.max("t_ms") + gap_ms).alias("end_ms"), F.count(F.lit(1)).alias("rows")).drop("_start"))


def profile_bumps(df: DataFrame, profile: str = "profile", smooth: int = 5, frac: float = 0.25) -> DataFrame:
    """Bump count and deepest valley of a column profile.

    Works inside one array per frame, whose length is the image width.
    """
    back, ahead = smooth // 2, (smooth - 1) // 2
    p = F.col(profile)
    smoothed = F.transform(p, lambda _, i: F.aggregate(
        F.slice(p, F.greatest(i - back + 1, F.lit(1)),
                F.least(i + ahead + 1, F.size(p)) - F.greatest(i - back + 1, F.lit(1)) + 1),
        F.lit(0.0), lambda acc, v: acc + v) / smooth)
    out = df.withColumn("_s", smoothed).withColumn("_peak", F.array_max("_s"))
    out = out.withColumn("_on", F.transform("_s", lambda v: v >= F.col("_peak") * frac))
    starts = F.size(F.filter(F.transform("_on", lambda v, i: v & ((i == 0) | ~F.get("_on", i - 1))), lambda v: v))
    first, last = F.array_position("_on", True), F.size("_on") - F.array_position(F.reverse("_on"), True) + 1
    inner = F.slice(F.col("_s"), first.cast("int"), (last - first + 1).cast("int"))
    below = F.filter(inner, lambda v: v < F.col("_peak") * frac)
    depth = F.when(F.size(below) > 0, (F.col("_peak") - F.array_min(below)) / F.col("_peak") * 100.0).otherwise(0.0)
    flat = F.col("_peak").isNull() | (F.col("_peak") <= 0)
    return (out.withColumns({"bumps": F.when(flat, 0).otherwise(starts),
                             "valley_pct": F.when(flat, 0.0).otherwise(F.round(depth, 4))})
            .drop("_s", "_peak", "_on"))


def newest(df: DataFrame, k: int) -> DataFrame:
    """Newest ``k`` rows per line; the limit is applied before the shuffle too."""
    order = Window.partitionBy("line_id").orderBy(F.col("t_ms").desc(), F.col("seq").desc())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

