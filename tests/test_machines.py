"""Golden sequences for the stateful operators, rule by rule."""

import json
import random

import pytest
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.operators import automata as am
from linewatch.operators import signals as sg
from linewatch.streaming import machines as mc
from linewatch.streaming.run import fold

W, T, I, X, S = fixed.WAITING, fixed.TRACKING, fixed.INSPECTING, fixed.FAULT, fixed.SERVICE


def states(events, n=5):
    s, out = (W, 0), []
    for e in events:
        s = mc.line_step(s, e, n)
        out.append(s[0])
    return out


@pytest.mark.parametrize("events,want", [
    (["running_rises", "running_falls", "inspection_start", "verdict_ok"], [T, T, I, W]),
    (["running_rises", "inspection_start", "verdict_fault", "ack"], [T, I, X, W]),
    (["inspection_start", "verdict_fault", "clean_frame", "ack"], [W, W, W, W]),
    (["running_rises", "belt_fault", "running_rises", "belt_fault"], [T, X, X, X]),
    (["belt_fault", "clean_frame", "clean_frame", "dirty_frame", "clean_frame", "clean_frame", "clean_frame"], [X, X, X, X, X, X, W]),
    (["emergency", "enter_service", "emergency", "belt_fault", "exit_service"], [X, S, S, S, W]),
    (["exit_service", "reset_tracking", "reset_waiting"], [W, T, W]),
    (["running_rises", "inspection_start", "running_rises", "verdict_ok", "verdict_ok"], [T, I, I, W, W])])
def test_line_transitions(events, want):
    assert states(events, 3) == want


def line_rows(spark, events):
    return spark.createDataFrame([(1, i * 40_000_000, i, e, f"r{i}") for i, e in enumerate(events)],
                                 "line_id long, t_ms long, seq long, event string, reason string")


def test_line_flags_and_counters(spark):
    events = ["row_at_line", "running_rises", "row_at_line", "line_clear", "row_at_line", "running_falls", "belt_fault",
              "emergency", "ack", "running_rises", "inspection_start", "verdict_ok", "verdict_fault", "reset_tracking",
              "row_at_line", "enter_service", "exit_service"]
    rows = am.line_state(line_rows(spark, events), 3).orderBy("seq").collect()
    assert [r["stop"] for r in rows] == [False, False, True, False, True, False, False, False, False, False, False, False,
                                         False, False, True, False, False]
    assert [r["running"] for r in rows][:6] == [False, True, True, True, True, False]
    assert [r["fault_count"] for r in rows][6:9] == [1, 1, 1]
    assert [r["fault_reason"] for r in rows][5:8] == ["", "r6", "emergency_stop"]
    assert [r["fault_active"] for r in rows][6:9] == [True, True, False]
    assert [r["pulse_count"] for r in rows][10:13] == [0, 1, 1]
    assert [r["ignored"] for r in rows][12] is True


def test_line_state_rejects_zero_clear_frames(spark):
    with pytest.raises(ValueError):
        am.line_state(line_rows(spark, ["ack"]), 0)
    with pytest.raises(ValueError):
        mc.LineState(0)


def test_line_state_over_chunks_equals_plain_loop(spark):
    rnd = random.Random(5)
    events = [rnd.choice(mc.LINE_EVENTS) for _ in range(300)]
    rows = am.line_state(line_rows(spark, events), 3).orderBy("seq").collect()
    assert [r["state_after"] for r in rows] == states(events, 3)


def test_fault_events_carry_the_real_previous_state(spark):
    rows = am.fault_events(am.line_state(line_rows(spark, ["belt_fault", "ack", "running_rises", "belt_fault"]))).orderBy("seq").collect()
    assert [(r["event_type"], r["state_before"]) for r in rows] == [
        ("fault_raised", W), ("fault_cleared", X), ("fault_raised", T)]


def phases(steps, **kw):
    s, out, was = mc.PHASE_START, [], None
    for running, occupied in steps:
        edge = None if was is None or was == running else ("rising" if running else "falling")
        was = running
        s = mc.phase_step(s, (edge, running, occupied), **kw)
        out.append(s[0])
    return out


def test_row_phase_cycle():
    on, off, still, clear = (True, True), (True, False), (False, True), (False, False)
    assert phases([off, on, on]) == ["IDLE", "IDLE", "AT_LINE"]
    assert phases([off, on, on, still, on, on, off, off, off, off]) == [
        "IDLE", "IDLE", "AT_LINE", "AT_LINE", "TRANSFERRING", "TRANSFERRING", "TRANSFERRING", "TRANSFERRING", "TRANSFERRING", "IDLE"]
    assert phases([off, on, on, off, off]) == ["IDLE", "IDLE", "AT_LINE", "AT_LINE", "IDLE"]
    # stopped again during the transfer: back at the line while it counts as occupied
    assert phases([off, on, on, still, on, still], forget_on_rising=False)[-1] == "AT_LINE"
    # unless the rising edge forgets, which is the rule
    assert phases([off, on, on, still, on, clear])[-1] == "IDLE"


def test_clusters_keep_ids():
    m = mc.Clusters(speed=350, max_dist=120, max_missed=1)
    s = m.start()
    assert [(r[3], r[5]) for r in m.step(s, 0, 0, [500.0, 800.0])] == [(1, "new"), (2, "new")]
    # 100 ms later both moved 35 px
    assert [r[3] for r in m.step(s, 100, 1, [465.0, 765.0])] == [1, 2]
    # the front one is missed once and found again, then lost for good
    assert [r[3] for r in m.step(s, 200, 2, [730.0])] == [2]
    assert [r[3] for r in m.step(s, 300, 3, [430.0, 695.0])] == [1, 2]
    assert [r[3] for r in m.step(s, 400, 4, [660.0])] == [2]
    assert [r[2:] for r in m.step(s, 500, 5, [625.0])] == [(0, 2, 625.0, "matched"), (None, 1, 430.0, "lost")]
    assert m.step(s, 600, 6, [395.0, 590.0])[0][3:6:2] == (3, "new")


def test_clusters_nearest_pair_first():
    m = mc.Clusters(speed=350)
    s = m.start()
    m.step(s, 0, 0, [100.0, 200.0])
    # 150 is within reach of both; 195 is nearer to the second, so the first gets 150
    assert [r[3] for r in m.step(s, 0, 1, [150.0, 195.0])] == [1, 2]


def test_row_lines_fire_once():
    m = mc.RowLines(600.0)
    s = m.start()
    fired = [m.step(s, i, xs)[0][2] for i, xs in enumerate([[650.0, 900.0], [620.0, 870.0], [590.0, 840.0], [560.0, 810.0], [530.0, 590.0]])]
    # a new track never fires at first sight; 810 -> 590 is beyond the tolerance
    assert fired == [0, 0, 1, 0, 0]


def stops(frames, **kw):
    m = mc.Stops(**{"line_x": 600.0, "grid_rows": 2, "grid_columns": 2, "row_gap": 50.0, **kw})
    s, out = m.start(), []
    for i, (running, edges) in enumerate(frames):
        out += m.step(s, i * 100, i, running, [float(e) for e in edges])
    names = [c.split()[0] for c in mc.STOP_SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in out], s


def test_stop_fires_at_the_line_and_only_once_until_restart():
    out, s = stops([(True, [700, 705]), (True, [600, 605]), (True, [580, 585])])
    assert [r["fired"] for r in out] == [False, True, False]
    assert out[1]["boundary"] == 625.0 and out[1]["overshoot_px"] == 0.0 and out[2]["phase"] == "CLEARING"
    assert s["status"] == ["STOPPED", "WAITING"]


def test_standing_line_gives_no_rows():
    assert stops([(False, [500, 505])])[0] == []


def test_no_grid_rows_never_fires():
    out, _ = stops([(True, [500, 505])] * 3, grid_rows=0)
    assert [(r["phase"], r["fired"]) for r in out] == [("IDLE", False)] * 3


def test_fallback_never_fires():
    out, _ = stops([(True, [601, 605]), (True, []), (True, []), (True, [599, 603])])
    assert [(r["fallback"], r["fired"]) for r in out] == [(False, False), (True, False), (True, False), (False, True)]


def test_memory_is_limited():
    out, _ = stops([(True, [650, 655])] + [(True, [])] * 4, max_memory=2)
    assert [r["tangent"] for r in out] == [650.0, 650.0, 650.0, None, None]


def test_far_past_needs_company_and_a_second_look():
    assert [r["fired"] for r in stops([(True, [500]), (True, [500])])[0]] == [False, False]
    assert [r["fired"] for r in stops([(True, [500, 505]), (True, [490, 495])])[0]] == [False, True]
    assert [r["fired"] for r in stops([(True, [500, 505]), (True, [470, 475]), (True, [440, 445])])[0]] == [False, False, False]


def test_far_past_times_out():
    frames = [(True, [500 - 30 * i, 505 - 30 * i]) for i in range(5)]
    out, _ = stops(frames, far_past_timeout_ms=300)
    assert [r["fired"] for r in out] == [False, False, False, True, False]


def test_within_reasonable_overshoot_a_lone_piece_fires():
    assert stops([(True, [560])])[0][0]["fired"]


def test_clearing_ends_when_leftovers_are_gone_or_after_a_while():
    base = [(True, [600, 605]), (False, [])]
    out, _ = stops(base + [(True, [590, 700]), (True, [560, 690]), (True, [680, 685])])
    assert [(r["phase"], r["pieces_excluded"]) for r in out[1:]] == [("CLEARING", 1), ("CLEARING", 1), ("ARMED", 0)]
    out, s = stops(base + [(True, [590, 700])] * 6)
    # given up after 400 ms; the piece at 590 then stops the next row
    assert [r["phase"] for r in out[1:]] == ["CLEARING"] * 4 + ["ARMED", "CLEARING"] and s["clear_why"] == "timeout"
    assert out[5]["fired"] and out[5]["clearing_ms"] == 400


def test_full_round_resets_and_wants_a_fresh_row():
    out, s = stops([(True, [600, 605]), (False, []), (True, [700, 705]), (True, [598, 603]), (False, []),
                    (True, [590, 595]), (True, [801, 806]), (True, [599, 604])])
    # the second row fires, the third start is a full reset, 590 is not fresh, 801 is
    assert [r["fired"] for r in out] == [True, False, True, False, False, True]
    assert out[3]["boundary"] is None and s["status"] == ["STOPPED", "WAITING"]


def test_anchor_follows_the_second_row():
    out, s = stops([(True, [600, 605, 760, 765])], grid_rows=3)
    assert out[0]["fired"] and s["anchor"] == 1 and s["anchor_id"] == 2
    _, s = stops([(True, [600, 605, 760, 765]), (False, []), (True, [700, 705])], grid_rows=3)
    assert s["anchor"] == 1 and s["anchor_id"] is None  # ids restart with the cycle


def test_quality_counts_until_fire():
    out, _ = stops([(True, [650]), (True, []), (True, [598, 603])])
    assert (out[2]["row_frames"], out[2]["row_full_frames"], out[2]["row_fallback_frames"]) == (3, 1, 1)


def column_stops(frames):
    m = mc.ColumnStops(line_x=600.0, grid_rows=2, grid_columns=2)
    s = m.start()
    return [m.step(s, i * 100, i, True, [float(e) for e, _ in ps], [c for _, c in ps])[0][11] for i, ps in enumerate(frames)], s


def test_columns_must_all_be_there():
    assert column_stops([[(590, 0)], [(590, 0), (640, 1)]])[0] == [False, True]
    fired, s = column_stops([[(500, 0), (640, 1)]])
    assert fired == [True] and s["pointers"] == [1, 1]  # no far-past rule here


def test_states_survive_json():
    m = mc.Stops(line_x=600.0, grid_rows=2, grid_columns=2)
    s = m.start()
    frames = [(True, [700.0, 705.0]), (True, [600.0, 760.0]), (False, []), (True, [590.0])]
    plain = [m.step(s, i * 100, i, r, e) for i, (r, e) in enumerate(frames)]
    s, out = m.start(), []
    for i, (r, e) in enumerate(frames):
        s = json.loads(json.dumps(s))
        out.append(m.step(s, i * 100, i, r, e))
    assert out == plain


def test_fold_orders_rows_and_separates_keys(spark):
    rows = [(k, 1, t, t // 100, bool(t % 300 == 0)) for k in (1, 2) for t in range(0, 1500, 50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "line_id long, cycle long, t_ms long, frame_id long, belt_due boolean")
    got = {}
    for r in fold(df, mc.RateLimit(100), ["line_id", "cycle"], ["t_ms"]).collect():
        got.setdefault(r["line_id"], []).append((r["t_ms"], r["accepted"]))
    assert sorted(got[1]) == sorted(got[2])
    taken = [t for t, ok in sorted(got[1]) if ok]
    # due belt work puts a frame off, unless it is late by twice the interval
    assert taken[0] == 0 and all(100 <= b - a <= 200 for a, b in zip(taken, taken[1:]))
    assert not any(t % 300 == 0 for t in taken[1:])


@pytest.mark.parametrize("chunk_ms", [2_000, 60_000, 10**9])
def test_stops_do_not_depend_on_chunks(spark, chunk_ms):
    machine = mc.Stops(line_x=600.0, grid_rows=2, grid_columns=2)
    rnd = random.Random(4)
    frames = [(i * 500, i, i % 9 < 6, sorted(rnd.uniform(450, 900) for _ in range(rnd.randrange(4)))) for i in range(300)]
    s, want = machine.start(), []
    for t_ms, i, running, edges in frames:
        want += [(i, r[2], r[11]) for r in machine.step(s, t_ms, i, running, edges)]
    df = spark.createDataFrame([(k, *f, [0] * len(f[3])) for k in (1, 2) for f in frames],
                               "line_id long, t_ms long, frame_id long, running boolean, edges array<double>, cols array<int>")
    got = am.row_stops(df, machine, chunk_ms).select("line_id", "frame_id", "phase", "fired").collect()
    for k in (1, 2):
        assert sorted(tuple(r)[1:] for r in got if r["line_id"] == k) == want
    assert any(fired for _, _, fired in want)


def test_stop_releases_equal_the_machine(spark):
    rnd = random.Random(3)
    rows, at = [], 0
    for i in range(500):
        at += rnd.choice([0, 500, 1000, 2000])
        rows.append((1, at, i, rnd.random() < 0.8, rnd.random() < 0.5))
    rows.append((1, at + 9000, 500, False, False))
    m, want = mc.StopLatch(2000), []
    s = m.start()
    for r in rows:
        want += m.step(s, *r[1:])
    df = spark.createDataFrame(rows, "line_id long, t_ms long, seq long, running boolean, stop boolean")
    got = sg.stop_releases(df, F.col("running") & F.col("stop"), 2000).orderBy("seq").collect()
    assert [tuple(r)[1:] for r in got] == want
    two = df.limit(0).union(spark.createDataFrame(
        [(1, 1000, 0, True, True), (1, 2000, 1, True, True), (1, 4000, 2, False, False)], df.schema))
    assert [tuple(r)[1:] for r in sg.stop_releases(two, F.col("running") & F.col("stop"), 5000).collect()] == [(2000, 1, 4000, "plc_ack")]


def test_a_window_latches_once(spark):
    marks = "FFcccFF.FFcF"  # a point: the belt stands still, then a new window opens
    df = spark.createDataFrame([(1, i * 100, i, c == "F", c != ".") for i, c in enumerate(marks)],
                               "line_id long, t_ms long, seq long, fault boolean, belt boolean")
    assert sorted(r["seq"] for r in sg.latch(df, F.col("fault"), 2, 3, F.col("belt")).collect()) == [1, 9]
    assert sorted(r["seq"] for r in sg.latch(df, F.col("fault"), 2, 3).collect()) == [1, 6]


def test_windows_may_nest(spark):
    rows = spark.createDataFrame([(1, t, t) for t in (5, 15, 50, 100, 150)] + [(2, 50, 6)], "line_id long, t_ms long, seq long")
    windows = spark.createDataFrame([(1, 0, 100), (1, 10, 20), (1, 120, None)], "line_id long, open_ms long, close_ms long")
    got = sg.in_window(rows, windows).orderBy("t_ms").collect()
    assert [(r["t_ms"], r["window_open_ms"]) for r in got] == [(5, 0), (15, 0), (50, 0), (150, 120)]


def test_row_phase_batch_equals_machine(spark):
    rnd = random.Random(9)
    steps = [(rnd.random() < 0.7, rnd.random() < 0.6) for _ in range(400)]
    df = spark.createDataFrame([(1, i * 30_000_000, i, r, o) for i, (r, o) in enumerate(steps)],
                               "line_id long, t_ms long, seq long, running boolean, occupied boolean")
    rows = am.row_phase(df, F.col("occupied")).orderBy("seq").collect()
    assert [r["phase_after"] for r in rows] == phases(steps)
