"""Transition functions of the stateful operators, as plain data in, data out.

A machine has ``start()`` (a JSON-like state), ``columns`` (what it reads of a
row, in order), ``schema`` (what it emits) and ``step(state, *row)`` which
changes the state in place and returns the rows to emit. The same machine runs
over a sorted table (``run.fold``) and on a stream (``keyed.on_stream``).
"""

from __future__ import annotations

from statistics import median

from linewatch import fixed

# Events of the line state machine
LINE_EVENTS = ("running_rises", "running_falls", "inspection_start", "row_at_line", "line_clear",
               "belt_fault", "verdict_fault", "verdict_ok", "clean_frame", "dirty_frame", "ack",
               "emergency", "enter_service", "exit_service", "reset_waiting", "reset_tracking")


def line_step(state: tuple[str, int], event: str, clear_frames: int = 5) -> tuple[str, int]:
    """State and clean-frame count after one event."""
    name, clean = state
    faulted, serviced = name == fixed.FAULT, name == fixed.SERVICE
    if event == "running_rises" and name in (fixed.WAITING, fixed.READY):
        return fixed.TRACKING, clean
    if event == "inspection_start" and name == fixed.TRACKING:
        return fixed.INSPECTING, clean
    if event == "belt_fault" and not (faulted or serviced) or event == "emergency" and not serviced:
        return fixed.FAULT, 0
    if name == fixed.INSPECTING and event == "verdict_fault":
        return fixed.FAULT, 0
    if name == fixed.INSPECTING and event == "verdict_ok":
        return fixed.WAITING, 0
    if faulted and event == "clean_frame":
        return (fixed.FAULT, clean + 1) if clean + 1 < clear_frames else (fixed.WAITING, 0)
    if faulted and event == "dirty_frame":
        return fixed.FAULT, 0
    if faulted and event == "ack" or serviced and event == "exit_service":
        return fixed.WAITING, 0
    if event == "enter_service":
        return fixed.SERVICE, clean
    if event == "reset_waiting":
        return fixed.WAITING, 0
    if event == "reset_tracking":
        return fixed.TRACKING, 0
    return state


def line_step_flags(state: tuple, event: str, clear_frames: int = 5) -> tuple:
    """As ``line_step`` with the flags ``running, stop, fault active``."""
    name, clean, running, stop, fault = state
    after, clean = line_step((name, clean), event, clear_frames)
    if event in ("row_at_line", "line_clear") and running:
        stop = event == "row_at_line"
    if event in ("running_falls", "enter_service", "reset_waiting"):
        stop = False
    if event in ("running_rises", "running_falls", "reset_tracking"):
        running = event != "running_falls"
    left = name == fixed.FAULT and after == fixed.WAITING or name == fixed.SERVICE and event == "exit_service"
    if after == fixed.FAULT:
        fault = True
    elif left or event in ("reset_waiting", "reset_tracking"):
        fault = False
    return after, clean, running, stop, fault


# Phases of the row at the line
IDLE, AT_LINE, TRANSFERRING = "IDLE", "AT_LINE", "TRANSFERRING"
PHASE_START = (IDLE, False, 0, 0, False)


def phase_step(state: tuple, symbol: tuple, debounce: int = 2, clear_frames: int = 3,
               forget_on_rising: bool = True) -> tuple:
    """One frame: ``symbol`` is (edge or None, running, occupied).

    State: phase, occupancy candidate, its run length (capped), clear frames,
    last stable occupancy. A rising edge restarts the debounce and, with
    ``forget_on_rising``, forgets that the line was occupied.
    """
    phase, candidate, held, clear, occupied_before = state
    edge, running, occupied = symbol
    if edge == "rising":
        phase = TRANSFERRING if phase == AT_LINE else phase
        candidate, held, clear = False, 0, 0
        occupied_before = occupied_before and not forget_on_rising
    elif edge == "falling" and phase == TRANSFERRING:
        phase, clear = (AT_LINE, clear) if occupied_before else (IDLE, 0)
    if running:
        if occupied == candidate:
            held = min(held + 1, debounce)
        else:
            candidate, held, clear = occupied, 1, 0
        if held >= debounce:
            if candidate:
                if phase == IDLE:
                    phase, occupied_before = AT_LINE, True
            elif phase == TRANSFERRING:
                clear += 1
                if clear >= clear_frames:
                    phase, clear, occupied_before = IDLE, 0, False
            elif occupied_before:
                phase, occupied_before = IDLE, False
    return phase, candidate, held, clear, occupied_before


class Clusters:
    """Ids for row fronts, matched to predicted positions, nearest pairs first."""
    columns = ("t_ms", "frame_id", "fronts")
    schema = "t_ms long, frame_id long, row_id int, cluster_id int, front double, outcome string"

    def __init__(self, speed: float = 350.0, max_dist: float = 120.0, max_missed: int = 3):
        self.speed, self.max_dist, self.max_missed = speed or 350.0, max_dist, max_missed

    def start(self) -> dict:
        return {"known": [], "next": 1, "t": None}

    def step(self, s: dict, t_ms, frame_id, fronts) -> list[tuple]:
        ids, fresh, lost = self.assign(s, t_ms, fronts)
        found = [(t_ms, frame_id, i, cid, x, "new" if i in fresh else "matched")
                 for i, (cid, x) in enumerate(zip(ids, fronts))]
        return found + [(t_ms, frame_id, None, cid, x, "lost") for cid, x in lost]

    def assign(self, s: dict, t_ms, fronts) -> tuple[list[int], set[int], list[tuple[int, float]]]:
        """Ids of the fronts, which of them are new, and what was missed too often (id, last front)."""
        dt = 0.0 if s["t"] is None else max(t_ms - s["t"], 0) / 1000.0
        s["t"] = t_ms
        shift = max(self.speed, 0.0) * dt
        known = s["known"]  # [id, front, missed]
        pairs = sorted(((abs(x - (k[1] - shift)), i, j) for i, x in enumerate(fronts)
                        for j, k in enumerate(known) if abs(x - (k[1] - shift)) <= self.max_dist))
        ids, taken = [None] * len(fronts), set()
        for _, i, j in pairs:
            if ids[i] is None and j not in taken:
                taken.add(j)
                ids[i], known[j][1], known[j][2] = known[j][0], fronts[i], 0
        for j, k in enumerate(known):
            if j not in taken:
                k[2] += 1
        fresh = {i for i, cid in enumerate(ids) if cid is None}
        for i in sorted(fresh):
            ids[i] = s["next"]
            known.append([s["next"], fronts[i], 0])
            s["next"] += 1
        s["known"] = [k for k in known if k[2] <= self.max_missed]
        return ids, fresh, [(k[0], k[1]) for k in known if k[2] > self.max_missed]


class RowLines:
    """Row lines that fire once when they cross the transfer line."""
    columns = ("frame_id", "row_xs")
    schema = "frame_id long, rows int, fired int"

    def __init__(self, line_x: float, factor: float = fixed.MATCH_TOLERANCE, max_missed: int = 5):
        self.line, self.factor, self.max_missed = line_x, factor, max_missed

    def start(self) -> dict:
        return {"tracks": []}  # [x, previous x, fired, missed]

    def tolerance(self, xs: list[float]) -> float:
        xs = sorted(xs)
        if len(xs) < 2:
            return float("inf")
        return max(median(b - a for a, b in zip(xs, xs[1:])) * self.factor, fixed.MIN_GAP_PX)

    def step(self, s: dict, frame_id, row_xs) -> list[tuple]:
        tracks, tol, used = s["tracks"], self.tolerance(row_xs), set()
        for x in row_xs:
            near = [(abs(tr[0] - x), -i) for i, tr in enumerate(tracks) if i not in used and abs(tr[0] - x) <= tol]
            if near:
                i = -min(near)[1]  # the later track wins a tie
                tracks[i] = [x, tracks[i][0], tracks[i][2], 0]
            else:
                i = len(tracks)
                tracks.append([x, x, False, 0])
            used.add(i)
        fired, kept = 0, []
        for i, (x, before, done, missed) in enumerate(tracks):
            if i not in used:
                before, missed = x, missed + 1
            if missed > self.max_missed:
                continue
            if not done and before != x and (before - self.line) * (x - self.line) <= 0:
                done, fired = True, fired + 1
            kept.append([x, before, done, missed])
        s["tracks"] = kept
        return [(frame_id, len(row_xs), fired)]


STOP_SCHEMA = ("t_ms long, frame_id long, phase string, active_row int, row_no int, tangent double, "
               "boundary double, pieces_total int, pieces_excluded int, fallback boolean, eligible boolean, "
               "fired boolean, overshoot_px double, row_frames int, row_full_frames int, row_fallback_frames int, "
               "gap_ms long, row_prev int, clearing_ms long, clearing_reason string")
ARMED, CLEARING = "ARMED", "CLEARING"


class Stops:
    """Stop commands per row: WAITING, STOPPED, DONE; one emitted row per running frame."""
    columns = ("t_ms", "frame_id", "running", "edges", "cols")
    schema = STOP_SCHEMA

    def __init__(self, line_x: float = 632.0, grid_rows: int = 3, grid_columns: int = 8, row_gap: float = 150.0,
                 boundary_offset: float = 25.0, clearing_timeout_ms: int = 400, fresh_margin: float = 200.0,
                 far_past: float = fixed.FAR_PAST_PX, far_past_timeout_ms: int = 3000, far_past_near: float = 20.0,
                 max_memory: int = 5, speed: float = 350.0):
        self.line, self.grid_rows, self.grid_columns, self.row_gap = line_x, grid_rows, grid_columns, row_gap
        self.offset, self.clearing_timeout, self.fresh_margin = boundary_offset, clearing_timeout_ms, fresh_margin
        self.far_past, self.far_timeout, self.far_near = far_past, far_past_timeout_ms, far_past_near
        self.max_memory, self.tracker = max_memory, Clusters(speed)

    def start(self) -> dict:
        return {"was_running": False, "index": 0, "status": ["WAITING"] * self.grid_rows, "phase": ARMED,
                "boundary": None, "since": None, "anchor": None, "anchor_id": None, "need_fresh": False,
                "quality": {}, "last_stop": None, "last_row": None, "clear_ms": None, "clear_why": None,
                "pointers": [0] * self.grid_columns, **self.per_cycle()}

    def per_cycle(self) -> dict:
        return {"clusters": self.tracker.start(), "mem_x": None, "mem_n": 0,
                "far_x": None, "far_n": 0, "far_since": None}

    def step(self, s: dict, t_ms, frame_id, running, edges, cols=None) -> list[tuple]:
        rising = running and not s["was_running"]
        s["was_running"] = running
        if not running:
            return []
        if rising:
            self.on_rising(s, t_ms)
        edges = list(edges)
        self.leave_clearing(s, t_ms, edges)
        limit = s["boundary"] if s["phase"] == CLEARING else None
        keep = [i for i, e in enumerate(edges) if limit is None or e > limit]
        out = {"phase": s["phase"], "active": s["index"], "total": len(edges), "excluded": len(edges) - len(keep)}
        found = self.select(s, t_ms, [edges[i] for i in keep], None if cols is None else [cols[i] for i in keep])
        if s["index"] >= self.grid_rows:
            return [self.emit(s, t_ms, frame_id, {**out, "phase": "IDLE"})]
        tangent, full = found["tangent"], found["full"]
        row = s["index"] if s["anchor"] is None else s["anchor"]
        fallback = False
        if tangent is not None:
            s["mem_x"], s["mem_n"] = tangent, 0
        elif s["mem_x"] is not None and s["mem_n"] < self.max_memory:
            s["mem_n"] += 1
            tangent, fallback = s["mem_x"], True
        q = s["quality"].setdefault(str(row), [0, 0, 0])
        q[0] += 1
        q[1] += full
        q[2] += fallback
        out |= {"row": row + 1, "tangent": tangent, "fallback": fallback,
                "eligible": s["phase"] == ARMED and tangent is not None}
        if s["phase"] == ARMED and row < len(s["status"]) and s["status"][row] == "WAITING" \
                and self.may_fire(s, t_ms, tangent, fallback, found):
            out |= self.fire(s, t_ms, row, tangent, found)
        return [self.emit(s, t_ms, frame_id, out)]

    # -- rule 1: rising edge
    def on_rising(self, s: dict, t_ms) -> None:
        s.update(self.per_cycle())
        s["anchor_id"] = None  # ids restart, so an old id would name another row
        i = s["index"]
        if i == 0:  # a fresh round of rows
            s["clear_ms"] = s["clear_why"] = None
        if i < self.grid_rows and s["status"][i] == "STOPPED":
            s["status"][i], s["index"] = "DONE", i + 1
            if s["phase"] == CLEARING and s["since"] is None:
                s["since"] = t_ms
        if s["index"] >= self.grid_rows:
            s.update(index=0, status=["WAITING"] * self.grid_rows, need_fresh=True, anchor=None, phase=ARMED,
                     since=None, boundary=None, pointers=[0] * self.grid_columns)

    # -- rule 2: the boundary is given up when clear or after a while
    def leave_clearing(self, s: dict, t_ms, edges) -> None:
        if s["phase"] != CLEARING or s["since"] is None or s["boundary"] is None:
            return
        waited = t_ms - s["since"]
        clear = not any(e <= s["boundary"] for e in edges)
        if clear or waited >= self.clearing_timeout:
            s.update(phase=ARMED, clear_ms=waited, clear_why="leftovers_cleared" if clear else "timeout")

    # -- rules 3 to 5: group, clean, identify, choose
    def select(self, s: dict, t_ms, edges: list[float], cols) -> dict:
        rows = self.clean(group(edges, self.row_gap))
        ids, *_ = self.tracker.assign(s["clusters"], t_ms, [r[0] if r else float("inf") for r in rows])
        if s["anchor_id"] is not None and rows:
            chosen = next((r for cid, r in zip(ids, rows) if cid == s["anchor_id"]), [])
            second = None
        else:
            chosen, second = (rows[0] if rows else []), (1 if len(rows) > 1 and rows[1] else None)
        return {"tangent": chosen[0] if chosen else None, "pieces": len(chosen),
                "full": len(chosen) >= self.grid_columns, "next_id": ids[second] if second is not None else None,
                "has_next": second is not None, "ready": True, "used": []}

    def clean(self, rows: list[list[float]]) -> list[list[float]]:
        if len(rows) == 1:  # one oversized row may be a staggered layout
            return rows
        return [without_outliers(r) if len(r) > self.grid_columns else r for r in rows]

    # -- rule 7: guards
    def may_fire(self, s: dict, t_ms, tangent, fallback, found) -> bool:
        if tangent is None:
            s["far_n"], s["far_x"], s["far_since"] = 0, None, None
            return False
        blocked = False
        if s["anchor"] is None and s["need_fresh"]:
            s["need_fresh"] = blocked = tangent <= self.line + self.fresh_margin
        reached = not blocked and tangent <= self.line
        return self.plausible(s, t_ms, tangent, fallback, found, reached) and reached and not fallback and found["ready"]

    def plausible(self, s: dict, t_ms, tangent, fallback, found, reached) -> bool:
        """A row far past the line needs company and a second fresh look, or time."""
        if not (reached and self.line - tangent > self.far_past):
            s["far_n"], s["far_x"], s["far_since"] = 0, None, None
            return True
        if not fallback:
            near = s["far_x"] is not None and abs(tangent - s["far_x"]) <= self.far_near
            s["far_n"], s["far_x"] = (s["far_n"] + 1 if near else 1), tangent
        timed_out = False
        if s["far_n"] >= 2:
            s["far_since"] = None
        else:
            s["far_since"] = t_ms if s["far_since"] is None else s["far_since"]
            timed_out = self.far_timeout > 0 and t_ms - s["far_since"] >= self.far_timeout
        return found["pieces"] >= 2 and (s["far_n"] >= 2 or timed_out)

    # -- rule 8: fire
    def fire(self, s: dict, t_ms, row, tangent, found) -> dict:
        total, full, fallback = s["quality"].pop(str(row))
        gap = None if s["last_stop"] is None else t_ms - s["last_stop"]
        details = {"fired": True, "overshoot": self.line - tangent, "quality": (total, full, fallback),
                   "gap": gap, "prev": s["last_row"], "clear_ms": s["clear_ms"], "clear_why": s["clear_why"]}
        s["status"][row] = "STOPPED"
        s.update(last_stop=t_ms, last_row=row + 1, boundary=tangent + self.offset, phase=CLEARING, since=None)
        self.advance(s, row, found)
        return details

    def advance(self, s: dict, row, found) -> None:
        if s["anchor"] is not None:
            s["anchor"] = s["anchor_id"] = None
        elif found["has_next"] and row + 1 < len(s["status"]):
            s["anchor"], s["anchor_id"] = row + 1, found["next_id"]

    def emit(self, s: dict, t_ms, frame_id, o: dict) -> tuple:
        total, full, fallback = o.get("quality", (None, None, None))
        return (t_ms, frame_id, o["phase"], o["active"], o.get("row"), o.get("tangent"), s["boundary"], o["total"],
                o["excluded"], o.get("fallback", False), o.get("eligible", False), o.get("fired", False),
                o.get("overshoot"), total, full, fallback, o.get("gap"), o.get("prev"), o.get("clear_ms"), o.get("clear_why"))


class ColumnStops(Stops):
    """As ``Stops`` with a row made of the next piece of every column."""

    def select(self, s: dict, t_ms, edges, cols) -> dict:
        by_col = [sorted(e for e, c in zip(edges, cols) if c == k) for k in range(self.grid_columns)]
        used = [k for k, (have, at) in enumerate(zip(by_col, s["pointers"])) if at < len(have)]
        row = [by_col[k][s["pointers"][k]] for k in used]
        complete = len(used) == self.grid_columns
        return {"tangent": min(row) if row else None, "pieces": len(row), "full": bool(row) and complete,
                "next_id": None, "has_next": True, "ready": complete, "used": used}

    def plausible(self, *_) -> bool:
        return True

    def fire(self, s: dict, t_ms, row, tangent, found) -> dict:
        out = super().fire(s, t_ms, row, tangent, found)
        for k in found["used"]:
            s["pointers"][k] += 1
        return out


def group(edges: list[float], gap: float) -> list[list[float]]:
    rows: list[list[float]] = []
    for e in sorted(edges):
        if rows and e - rows[-1][-1] <= gap:
            rows[-1].append(e)
        else:
            rows.append([e])
    return rows


def without_outliers(row: list[float], limit: float = fixed.OUTLIER_DISTANCE_PX) -> list[float]:
    if len(row) < 2:
        return row
    return [e for i, e in enumerate(row) if abs(e - median(row[:i] + row[i + 1:])) <= limit]


class RateLimit:
    """At most one accepted frame per interval; belt work may push it back by one frame."""
    columns = ("t_ms", "frame_id", "belt_due")
    schema = "t_ms long, frame_id long, accepted boolean"

    def __init__(self, interval_ms: int = 100):
        self.interval = interval_ms

    def start(self) -> dict:
        return {"last": None}

    def step(self, s: dict, t_ms, frame_id, belt_due) -> list[tuple]:
        waited = float("inf") if s["last"] is None else t_ms - s["last"]
        ok = waited >= self.interval and not (belt_due and waited < 2 * self.interval)
        if ok:
            s["last"] = t_ms
        return [(t_ms, frame_id, ok)]


class FaultLatch:
    """Streaming form of the latch: n faulty rows while armed, m clean rows to re-arm."""
    columns = ("t_ms", "seq", "fault")
    schema = "t_ms long, seq long"

    def __init__(self, n: int = 3, m: int = 3):
        self.n, self.m = n, m

    def start(self) -> dict:
        return {"armed": True, "run": 0}

    def step(self, s: dict, t_ms, seq, fault) -> list[tuple]:
        # Only faults count while armed and only clean rows while not.
        s["run"] = s["run"] + 1 if fault == s["armed"] else 0
        if s["run"] < (self.n if s["armed"] else self.m):
            return []
        was_armed, s["armed"], s["run"] = s["armed"], not s["armed"], 0
        return [(t_ms, seq)] if was_armed else []


class LineState:
    """Streaming form of the line state machine: flags, counters and reason as in batch."""
    columns = ("t_ms", "seq", "event", "reason")
    schema = ("t_ms long, seq long, event string, state_before string, state_after string, clean_frames int, running boolean, "
              "stop boolean, fault_active boolean, fault_count long, pulse_count long, fault_reason string, ignored boolean")

    def __init__(self, clear_frames: int = 5, through: str = ""):
        """``through``: further columns ("name type, ...") handed to a machine that follows."""
        if clear_frames < 1:
            raise ValueError("clear_frames must be at least 1")
        self.clear_frames = clear_frames
        if through:
            self.columns = (*self.columns, *(c.split()[0] for c in through.split(",")))
            self.schema = f"{self.schema}, {through}"

    def start(self) -> dict:
        return {"at": [fixed.WAITING, 0, False, False, False], "faults": 0, "pulses": 0, "why": ""}

    def step(self, s: dict, t_ms, seq, event, reason, *through) -> list[tuple]:
        before = s["at"][0]
        s["at"] = list(line_step_flags(tuple(s["at"]), event, self.clear_frames))
        after = s["at"][0]
        if after == fixed.FAULT and before != fixed.FAULT and event in ("belt_fault", "verdict_fault"):
            s["faults"] += 1
            s["why"] = reason or s["why"]
        elif event == "emergency" and after == fixed.FAULT:
            s["why"] = "emergency_stop"
        s["pulses"] += event == "verdict_ok" and before == fixed.INSPECTING
        late = event in ("verdict_ok", "verdict_fault") and before != fixed.INSPECTING
        return [(t_ms, seq, event, before, *s["at"], s["faults"], s["pulses"], s["why"], late, *through)]


class RowPhase:
    """Streaming form of the row phase, with the commands it gives."""
    columns = ("t_ms", "seq", "running", "occupied")
    schema = "t_ms long, seq long, phase_before string, phase_after string, command string"

    def __init__(self, debounce: int = 2, clear_frames: int = 3, forget_on_rising: bool = True):
        self.debounce, self.clear_frames, self.forget_on_rising = debounce, clear_frames, forget_on_rising

    def start(self) -> dict:
        return {"at": list(PHASE_START), "was": None}

    def step(self, s: dict, t_ms, seq, running, occupied) -> list[tuple]:
        edge = None if s["was"] is None or s["was"] == running else ("rising" if running else "falling")
        s["was"] = running
        before = s["at"][0]
        s["at"] = list(phase_step(tuple(s["at"]), (edge, running, occupied), self.debounce, self.clear_frames, self.forget_on_rising))
        command = {(IDLE, AT_LINE): "stop", (AT_LINE, IDLE): "clear"}.get((before, s["at"][0]))
        return [(t_ms, seq, before, s["at"][0], command)]


class SelfClear:
    """An active fault clears by ``n`` clean rows in a row; any fault starts again."""
    columns = ("t_ms", "seq", "fault")
    schema = "t_ms long, seq long"

    def __init__(self, n: int = 5):
        self.n = n

    def start(self) -> dict:
        return {"active": False, "clean": 0}

    def step(self, s: dict, t_ms, seq, fault) -> list[tuple]:
        if fault:
            s.update(active=True, clean=0)
        elif s["active"]:
            s["clean"] += 1
            if s["clean"] >= self.n:
                s.update(active=False, clean=0)
                return [(t_ms, seq)]
        return []


class AckEdge:
    """A pressed acknowledge button acts once and clears error and fault together."""
    columns = ("t_ms", "seq", "ack", "fault")
    schema = "t_ms long, seq long, cleared_error boolean, cleared_fault boolean"

    def start(self) -> dict:
        return {"was": None, "error": False, "fault": False}

    def step(self, s: dict, t_ms, seq, ack, fault) -> list[tuple]:
        rising = bool(ack) and s["was"] is False
        s["was"] = bool(ack)
        if fault:  # a raised fault sets the error code too
            s["error"] = s["fault"] = True
        if not rising:
            return []
        out = (t_ms, seq, s["error"], s["fault"])
        s["error"] = s["fault"] = False
        return [out]


class Inspection:
    """Belt windows with their latch, and event log rows, from the states of a line.

    Follows ``LineState`` in one query: its columns are that machine's output and what it hands
    through. A window opens and closes with the belt; opening arms and forgets; a window latches once.
    """
    columns = ("t_ms", "seq", "state_before", "state_after", "fault_reason", "belt_running", "fault", "profile")
    schema = ("kind string, t_ms long, seq long, open_ms long, close_ms long, frames long, latched boolean, "
              "fault_reason string, state_before string, state_after string, profile string")

    def __init__(self, n: int = 3):
        self.n = n

    def start(self) -> dict:
        return {"window": None, "run": 0, "profile": None}

    def step(self, s: dict, t_ms, seq, before, after, why, belt, fault, profile) -> list[tuple]:
        out = self.window(s, t_ms, seq, belt, fault)
        kind = None
        if after == fixed.FAULT and before != fixed.FAULT:
            kind = "fault_raised"
        elif before == fixed.FAULT and after == fixed.WAITING:
            kind = "fault_cleared"
        if kind:
            out.append((kind, t_ms, seq, None, None, None, None, why if kind == "fault_raised" else "", before, after, None))
        if profile is not None and profile != s["profile"]:
            if s["profile"] is not None:
                out.append(("profile_change", t_ms, seq, None, None, None, None, "", None, None, profile))
            s["profile"] = profile
        return out

    def window(self, s: dict, t_ms, seq, belt, fault) -> list[tuple]:
        if not belt:
            closed, s["window"] = s["window"], None
            return [self.row(closed, t_ms)] if closed else []
        if s["window"] is None:
            s["window"] = {"open": t_ms, "seq": seq, "frames": 0, "latched": False}
            s["run"] = 0
        w = s["window"]
        w["frames"] += 1
        if not w["latched"]:
            s["run"] = s["run"] + 1 if fault else 0
            w["latched"] = s["run"] >= self.n
        return []

    @staticmethod
    def row(w: dict, close_ms) -> tuple:
        return ("window", w["open"], w["seq"], w["open"], close_ms, w["frames"], w["latched"], None, None, None, None)


class StopLatch:
    """Holds a stop until the falling edge or the end of the hold time (a timer),
    which a further stop sets again."""
    columns = ("t_ms", "seq", "running", "stop")
    schema = "t_ms long, seq long, released_ms long, reason string"

    def __init__(self, hold_ms: int = fixed.STOP_HOLD_MS):
        self.hold = hold_ms

    def start(self) -> dict:
        return {"set": None, "was": None}

    def deadline(self, s: dict):
        return None if s["set"] is None else s["set"][0] + self.hold

    def expire(self, s: dict, now) -> list[tuple]:
        if s["set"] is None or now < s["set"][0] + self.hold:
            return []
        (t, seq), s["set"] = s["set"], None
        return [(t, seq, t + self.hold, "timeout")]

    def step(self, s: dict, t_ms, seq, running, stop) -> list[tuple]:
        out = self.expire(s, t_ms - 1)  # a falling edge exactly at the limit still counts as acknowledged
        if s["was"] and not running and s["set"] is not None:
            (t, q), s["set"] = s["set"], None
            out.append((t, q, t_ms, "plc_ack"))
        s["was"] = running
        if running and stop:
            s["set"] = [t_ms, seq]
        return out


class TransferTimeout:
    """One warning per transfer that lasts too long."""
    columns = ("t_ms", "seq", "transferring")
    schema = "t_ms long, seq long, since_ms long, lasted_ms long"

    def __init__(self, limit_ms: int = 5000):
        self.limit = limit_ms

    def start(self) -> dict:
        return {"since": None, "warned": False}

    def step(self, s: dict, t_ms, seq, transferring) -> list[tuple]:
        if not transferring:
            s.update(since=None, warned=False)
            return []
        s["since"] = t_ms if s["since"] is None else s["since"]
        if s["warned"] or t_ms - s["since"] <= self.limit:
            return []
        s["warned"] = True
        return [(t_ms, seq, s["since"], t_ms - s["since"])]


class StickyResult:
    """The last result stays for the hold time, then goes (a timer)."""
    columns = ("t_ms", "seq", "result")
    schema = "at_ms long, shown string"

    def __init__(self, hold_ms: int = 3000):
        self.hold = hold_ms

    def start(self) -> dict:
        return {"until": None}

    def deadline(self, s: dict):
        return s["until"]

    def expire(self, s: dict, now) -> list[tuple]:
        if s["until"] is None or now < s["until"]:
            return []
        at, s["until"] = s["until"], None
        return [(at, None)]

    def step(self, s: dict, t_ms, seq, result) -> list[tuple]:
        out = self.expire(s, t_ms)
        if result is not None:
            s["until"] = t_ms + self.hold
            out.append((t_ms, result))
        return out
