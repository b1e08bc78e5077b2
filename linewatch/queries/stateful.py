"""Batch twins of the stateful operators."""

from pyspark.sql import functions as F

from linewatch.operators import automata as am
from linewatch.queries import query
from linewatch.queries.signals import EDGES, OVER
from linewatch.queries.sql import with_views
from linewatch.sources import tables as t
from linewatch.streaming import machines as mc

EVENT_SQL = """CASE event_type
  WHEN 'click' THEN CASE WHEN value <= 20 THEN 'running_rises' ELSE 'running_falls' END
  WHEN 'view' THEN CASE event_id % 5 WHEN 0 THEN 'inspection_start' WHEN 1 THEN 'row_at_line' WHEN 2 THEN 'line_clear' WHEN 3 THEN 'verdict_ok' ELSE 'verdict_fault' END
  WHEN 'purchase' THEN CASE WHEN event_id % 6 = 0 THEN 'dirty_frame' ELSE 'clean_frame' END
  WHEN 'error' THEN CASE WHEN event_id % 8 = 7 THEN 'emergency' ELSE 'belt_fault' END
  ELSE CASE event_id % 10 WHEN 0 THEN 'enter_service' WHEN 1 THEN 'exit_service' WHEN 2 THEN 'exit_service' WHEN 3 THEN 'exit_service' WHEN 4 THEN 'exit_service'
    WHEN 7 THEN 'reset_waiting' WHEN 8 THEN 'reset_tracking' ELSE 'ack' END END"""


def line_events(spark, d):
    e = t.table(spark, d, "events")
    return e.select(F.col("user_id").alias("line_id"), t.epoch_ms("ts").alias("t_ms"), F.col("event_id").alias("seq"),
                    F.expr(EVENT_SQL).alias("event"),
                    F.concat(F.lit("r"), (F.col("event_id") % 9).cast("string")).alias("reason"))


_STEP = """SELECT line_id, i, t_ms, seq, event, reason, st AS state_before,
  CASE WHEN event = 'running_rises' AND st IN ('WAITING','READY') THEN 'TRACKING'
       WHEN event = 'inspection_start' AND st = 'TRACKING' THEN 'INSPECTING'
       WHEN event = 'belt_fault' AND st NOT IN ('FAULT','SERVICE') THEN 'FAULT'
       WHEN event = 'emergency' AND st <> 'SERVICE' THEN 'FAULT'
       WHEN event = 'verdict_fault' AND st = 'INSPECTING' THEN 'FAULT'
       WHEN event = 'verdict_ok' AND st = 'INSPECTING' THEN 'WAITING'
       WHEN event = 'clean_frame' AND st = 'FAULT' AND cl + 1 >= 3 THEN 'WAITING'
       WHEN event = 'ack' AND st = 'FAULT' THEN 'WAITING'
       WHEN event = 'enter_service' THEN 'SERVICE'
       WHEN event = 'exit_service' AND st = 'SERVICE' THEN 'WAITING'
       WHEN event = 'reset_waiting' THEN 'WAITING' WHEN event = 'reset_tracking' THEN 'TRACKING' ELSE st END AS st,
  CASE WHEN event = 'clean_frame' AND st = 'FAULT' THEN CASE WHEN cl + 1 >= 3 THEN 0 ELSE cl + 1 END
       WHEN event IN ('reset_waiting','reset_tracking') OR (event = 'belt_fault' AND st NOT IN ('FAULT','SERVICE')) OR (event = 'emergency' AND st <> 'SERVICE')
         OR (event IN ('verdict_fault','verdict_ok') AND st = 'INSPECTING') OR (event IN ('dirty_frame','ack') AND st = 'FAULT')
         OR (event = 'exit_service' AND st = 'SERVICE') THEN 0 ELSE cl END AS cl,
  CASE WHEN event IN ('running_rises','reset_tracking') THEN TRUE WHEN event = 'running_falls' THEN FALSE ELSE rn END AS rn,
  CASE WHEN event = 'row_at_line' AND rn THEN TRUE WHEN event = 'line_clear' AND rn THEN FALSE
       WHEN event IN ('running_falls','enter_service','reset_waiting') THEN FALSE ELSE sp END AS sp,
  CASE WHEN (event = 'belt_fault' AND st NOT IN ('FAULT','SERVICE')) OR (event = 'emergency' AND st <> 'SERVICE') OR (event = 'verdict_fault' AND st = 'INSPECTING') THEN TRUE
       WHEN event IN ('reset_waiting','reset_tracking') OR (st = 'FAULT' AND (event = 'ack' OR (event = 'clean_frame' AND cl + 1 >= 3))) OR (event = 'exit_service' AND st = 'SERVICE') THEN FALSE ELSE fa END AS fa,
  fc + CASE WHEN (event = 'belt_fault' AND st NOT IN ('FAULT','SERVICE')) OR (event = 'verdict_fault' AND st = 'INSPECTING') THEN 1 ELSE 0 END AS fc,
  pc + CASE WHEN event = 'verdict_ok' AND st = 'INSPECTING' THEN 1 ELSE 0 END AS pc,
  CASE WHEN event = 'emergency' AND st <> 'SERVICE' THEN 'emergency_stop'
       WHEN (event = 'belt_fault' AND st NOT IN ('FAULT','SERVICE')) OR (event = 'verdict_fault' AND st = 'INSPECTING') THEN reason ELSE why END AS why,
  event IN ('verdict_ok','verdict_fault') AND st <> 'INSPECTING' AS ignored"""
STATE_CTES = {
    "ev": f"SELECT user_id AS line_id, epoch_us(ts)//1000 AS t_ms, event_id AS seq, {EVENT_SQL} AS event, CONCAT('r', CAST(event_id % 9 AS VARCHAR)) AS reason FROM events",
    "n0": f"SELECT *, ROW_NUMBER() {OVER} AS i FROM ev",
    "fold": f"""{_STEP} FROM (SELECT *, 'WAITING' AS st, 0 AS cl, FALSE AS rn, FALSE AS sp, FALSE AS fa, CAST(0 AS BIGINT) AS fc, CAST(0 AS BIGINT) AS pc, '' AS why FROM n0 WHERE i = 1)
UNION ALL {_STEP} FROM (SELECT n0.*, p.st, p.cl, p.rn, p.sp, p.fa, p.fc, p.pc, p.why FROM fold p JOIN n0 ON n0.line_id = p.line_id AND n0.i = p.i + 1)"""}
_STATES = """SELECT line_id, t_ms, seq, event, state_before, st AS state_after, cl AS clean_frames, rn AS running, sp AS stop,
  fa AS fault_active, fc AS fault_count, pc AS pulse_count, why AS fault_reason, ignored FROM fold"""


@query("s1_line_state", with_views(recursive=True, ctes=STATE_CTES, body=_STATES))
def s1(spark, d):
    return am.line_state(line_events(spark, d), 3)


@query("s18_late_results", with_views(recursive=True, ctes=STATE_CTES, body="SELECT line_id, t_ms, seq, event, state_before AS state FROM fold WHERE ignored"))
def s18(spark, d):
    return am.line_state(line_events(spark, d), 3).where("ignored").select(
        "line_id", "t_ms", "seq", "event", F.col("state_before").alias("state"))


@query("s20_events_from_states", with_views(recursive=True, ctes=STATE_CTES, body="""SELECT line_id, t_ms, seq,
  CASE WHEN st = 'FAULT' THEN 'fault_raised' ELSE 'fault_cleared' END AS event_type, CASE WHEN st = 'FAULT' THEN why ELSE '' END AS fault_reason,
  state_before, st AS state_after FROM fold WHERE (st = 'FAULT' AND state_before <> 'FAULT') OR (state_before = 'FAULT' AND st = 'WAITING')"""))
def s20(spark, d):
    return am.fault_events(am.line_state(line_events(spark, d), 3))


_PHASE = """SELECT line_id, i, t_ms, seq, edge, running, occ, ph0 AS phase_before, ph3 AS ph, cand2 AS cand, held2 AS held,
  clr3 AS clr, ob3 AS ob FROM (SELECT *,
   CASE WHEN running AND held2 >= 2 THEN CASE WHEN cand2 THEN CASE WHEN ph1 = 'IDLE' THEN 'AT_LINE' ELSE ph1 END
        WHEN ph1 = 'TRANSFERRING' THEN CASE WHEN clr2 + 1 >= 3 THEN 'IDLE' ELSE ph1 END WHEN ob THEN 'IDLE' ELSE ph1 END ELSE ph1 END AS ph3,
   CASE WHEN running AND held2 >= 2 AND NOT cand2 AND ph1 = 'TRANSFERRING' THEN CASE WHEN clr2 + 1 >= 3 THEN 0 ELSE clr2 + 1 END ELSE clr2 END AS clr3,
   CASE WHEN running AND held2 >= 2 THEN CASE WHEN cand2 THEN ob OR ph1 = 'IDLE'
        WHEN ph1 = 'TRANSFERRING' THEN CASE WHEN clr2 + 1 >= 3 THEN FALSE ELSE ob END ELSE FALSE END ELSE ob END AS ob3 FROM (SELECT *,
     CASE WHEN running THEN CASE WHEN occ = cand1 THEN LEAST(held1 + 1, 2) ELSE 1 END ELSE held1 END AS held2,
     CASE WHEN running THEN occ ELSE cand1 END AS cand2, CASE WHEN running AND occ <> cand1 THEN 0 ELSE clr1 END AS clr2 FROM (SELECT *, ph AS ph0,
       CASE WHEN edge = 'rising' AND ph = 'AT_LINE' THEN 'TRANSFERRING' WHEN edge = 'falling' AND ph = 'TRANSFERRING' THEN CASE WHEN ob THEN 'AT_LINE' ELSE 'IDLE' END ELSE ph END AS ph1,
       CASE WHEN edge = 'rising' THEN FALSE ELSE cand END AS cand1, CASE WHEN edge = 'rising' THEN 0 ELSE held END AS held1,
       CASE WHEN edge = 'rising' OR (edge = 'falling' AND ph = 'TRANSFERRING' AND NOT ob) THEN 0 ELSE clr END AS clr1 FROM ({src}) u) v) w) x"""
_FORGET = _PHASE.replace("({src}) u", "(SELECT * REPLACE (ob AND edge IS DISTINCT FROM 'rising' AS ob) FROM ({src}) r) u")
_FIRST = "SELECT *, 'IDLE' AS ph, FALSE AS cand, 0 AS held, 0 AS clr, FALSE AS ob FROM n0 WHERE i = 1"
_LATER = "SELECT n0.*, p.ph, p.cand, p.held, p.clr, p.ob FROM fold p JOIN n0 ON n0.line_id = p.line_id AND n0.i = p.i + 1"


def _phases(step: str) -> str:
    return with_views("signals", recursive=True, ctes={
        **EDGES, "n0": f"SELECT line_id, t_ms, seq, edge, running, occupancy >= CAST(0.02 AS DOUBLE) AS occ, ROW_NUMBER() {OVER} AS i FROM e1",
        "fold": f"{step.format(src=_FIRST)} UNION ALL {step.format(src=_LATER)}"}, body="""
SELECT line_id, t_ms, seq, phase_before, ph AS phase_after, CASE WHEN phase_before = 'IDLE' AND ph = 'AT_LINE' THEN 'stop'
  WHEN phase_before = 'AT_LINE' AND ph = 'IDLE' THEN 'clear' END AS command FROM fold""")


def phases(spark, d, **options):
    signals = t.signals(spark, d).select("line_id", "t_ms", "seq", "running", "occupancy")
    out = am.row_phase(signals, F.col("occupancy") >= 0.02, **options)
    return out.select("line_id", "t_ms", "seq", "phase_before", "phase_after", "command")


@query("s2_row_phase", _phases(_FORGET))
def s2(spark, d):
    return phases(spark, d)


@query("s2_row_phase_remembering", _phases(_PHASE))
def s2_remembering(spark, d):
    return phases(spark, d, forget_on_rising=False)


def cycled(spark, d):
    """Frames with a pulling rhythm: 15 of every 20 frames of a line are running."""
    n = F.expr("frame_id div 4")
    return t.frames(spark, d).select(
        *t.FRAME, "t_ms", (n % 20 < 15).alias("running"), F.expr("frame_id div 80").alias("cycle"),
        F.expr("t_ms div 86400000").alias("session"), (n % 3 == 0).alias("belt_due"))


GAP, COLUMNS = 60.0, 3


@query("s5_track_clusters")
def s5(spark, d):
    return am.track_clusters(am.row_fronts(t.detections(spark, d), cycled(spark, d), GAP, COLUMNS))


@query("s6_track_row_lines")
def s6(spark, d):
    return am.track_row_lines(am.row_xs(t.detections(spark, d), cycled(spark, d)), 632.0)


@query("s7_row_stops")
def s7(spark, d):
    edges = am.frame_edges(t.detections(spark, d), cycled(spark, d))
    return am.row_stops(edges, mc.Stops(grid_rows=3, grid_columns=COLUMNS, row_gap=GAP))


@query("s8_column_stops")
def s8(spark, d):
    edges = am.frame_edges(t.detections(spark, d), cycled(spark, d), t.BANDS)
    return am.row_stops(edges, mc.ColumnStops(grid_rows=3, grid_columns=8))


@query("s12_rate_limit", with_views("frames", recursive=True, ctes={
    "c": "SELECT line_id, frame_id, t_ms, frame_id//80 AS cycle, (frame_id//4) % 3 = 0 AS due FROM frames",
    "n0": "SELECT *, ROW_NUMBER() OVER (PARTITION BY line_id, cycle ORDER BY t_ms, frame_id) AS i FROM c",
    "fold": """SELECT *, TRUE AS accepted, t_ms AS last FROM n0 WHERE i = 1 UNION ALL
      SELECT n0.*, n0.t_ms - p.last >= 500 AND NOT (n0.due AND n0.t_ms - p.last < 1000),
        CASE WHEN n0.t_ms - p.last >= 500 AND NOT (n0.due AND n0.t_ms - p.last < 1000) THEN n0.t_ms ELSE p.last END
      FROM fold p JOIN n0 ON n0.line_id = p.line_id AND n0.cycle = p.cycle AND n0.i = p.i + 1"""}, body="""
SELECT line_id, cycle, t_ms, frame_id, accepted FROM fold"""))
def s12(spark, d):
    return am.rate_limit(cycled(spark, d), 500)
