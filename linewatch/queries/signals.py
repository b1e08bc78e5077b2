"""Signal histories: edges, debounce, gaps, latches, windows."""

from pyspark.sql import functions as F

from linewatch.operators import reports as rp
from linewatch.operators import signals as sg
from linewatch.queries import query
from linewatch.queries.sql import with_views
from linewatch.sources import tables as t

OVER = "OVER (PARTITION BY line_id ORDER BY t_ms, seq)"
HELD = "OVER (PARTITION BY line_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
EDGES = {"e0": f"SELECT *, LAG(running) {OVER} AS was FROM signals",
         "e1": """SELECT *, CASE WHEN running AND NOT was THEN 'rising' WHEN NOT running AND was THEN 'falling' END AS edge FROM e0"""}


def sql(body: str, **ctes: str) -> str:
    return with_views("signals", ctes=ctes, body=body)


@query("w8_edges", sql("SELECT line_id, t_ms, seq, edge FROM e1 WHERE edge IS NOT NULL", **EDGES))
def w8(spark, d):
    return sg.edges(t.signals(spark, d)).select(*sg.KEY, "edge")


@query("s10_ack_edge", sql(f"""SELECT line_id, t_ms, seq FROM (SELECT *, LAG(ack) {OVER} AS was FROM signals) WHERE ack AND NOT was"""))
def s10(spark, d):
    return sg.edges(t.signals(spark, d), "ack").where(F.col("edge") == "rising").select(*sg.KEY)


@query("w9_edge_gaps", sql(f"""SELECT line_id, t_ms, seq, edge, t_ms - LAG(t_ms) {OVER} AS since_edge_ms FROM e1 WHERE edge IS NOT NULL""", **EDGES))
def w9(spark, d):
    return sg.edge_gaps(sg.edges(t.signals(spark, d))).select(*sg.KEY, "edge", "since_edge_ms")


@query("w16_cycles", sql(f"""SELECT line_id, t_ms, seq, CAST(COUNT(*) FILTER (WHERE edge = 'rising') {HELD} AS BIGINT) AS cycle FROM e1""", **EDGES))
def w16(spark, d):
    return sg.cycles(t.signals(spark, d)).select(*sg.KEY, "cycle")


RAW = {"r0": f"SELECT *, occupancy >= CAST(0.12 AS DOUBLE) AS raw FROM signals",
       "r1": f"SELECT *, CASE WHEN raw IS DISTINCT FROM LAG(raw) {OVER} THEN 1 ELSE 0 END AS chg FROM r0",
       "r2": f"SELECT *, SUM(chg) {HELD} AS run FROM r1",
       "r3": "SELECT *, ROW_NUMBER() OVER (PARTITION BY line_id, run ORDER BY t_ms, seq) AS pos FROM r2"}


@query("w10_debounce", sql(f"""SELECT line_id, t_ms, seq, raw,
  COALESCE(LAST_VALUE(CASE WHEN pos >= 2 THEN raw END IGNORE NULLS) {HELD}, FALSE) AS stable FROM r3""", **RAW))
def w10(spark, d):
    occupied = F.col("occupancy") >= 0.12
    raw = t.signals(spark, d).select(*sg.KEY, occupied.alias("raw"))
    return sg.debounce(raw, F.col("raw"), 2)


@query("w11_frame_gaps", sql(f"""SELECT line_id, t_ms, seq, gap_ms FROM (
  SELECT *, t_ms - LAG(t_ms) {OVER} AS gap_ms, LAG(running) {OVER} AS was FROM signals) WHERE running AND was AND gap_ms > 150"""))
def w11(spark, d):
    return sg.frame_gaps(t.signals(spark, d)).select(*sg.KEY, "gap_ms")


FIRES = {"f": """SELECT line_id, t_ms, seq, CAST(seq % 5 AS INT) + 1 AS row_no, 40 - value AS overshoot_px, event_type,
  CASE WHEN event_id % 4 = 0 THEN 'timeout' ELSE 'leftovers_cleared' END AS reason, CAST(FLOOR(value*10) AS BIGINT) AS clearing_ms
  FROM (SELECT *, user_id AS line_id, epoch_us(ts)//1000 AS t_ms, event_id AS seq FROM events) WHERE event_type IN ('view','purchase')"""}


def fires(spark, d):
    """Stops with their row number and overshoot, taken from the events."""
    return (t.table(spark, d, "events").where(F.col("event_type").isin("view", "purchase"))
            .select(F.col("user_id").alias("line_id"), t.epoch_ms("ts").alias("t_ms"), F.col("event_id").alias("seq"),
                    ((F.col("event_id") % 5).cast("int") + 1).alias("row_no"),
                    (F.lit(40.0) - F.col("value")).alias("overshoot_px"), "event_type",
                    F.when(F.col("event_id") % 4 == 0, "timeout").otherwise("leftovers_cleared").alias("reason"),
                    F.floor(F.col("value") * 10).alias("clearing_ms")))


@query("w12_inter_stop_gap", with_views(ctes=FIRES, body=f"""SELECT line_id, t_ms, seq, row_no, row_prev, gap_ms FROM (
  SELECT *, LAG(row_no) {OVER} AS row_prev, t_ms - LAG(t_ms) {OVER} AS gap_ms FROM f) WHERE gap_ms IS NOT NULL"""))
def w12(spark, d):
    return sg.inter_stop_gap(fires(spark, d)).select(*sg.KEY, "row_no", "row_prev", "gap_ms")


MISSING = {"m": f"""SELECT *, CASE WHEN running THEN ROUND(occupancy*1000, 3) END AS x, belt_running AS full_group,
  ROW_NUMBER() {OVER} AS i FROM signals""",
           "k": f"""SELECT *, LAST_VALUE(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) {HELD} AS li,
  LAST_VALUE(x IGNORE NULLS) {HELD} AS lx, LAST_VALUE(CASE WHEN full_group THEN i END IGNORE NULLS) {HELD} AS lg FROM m"""}


def with_missing(spark, d):
    return t.signals(spark, d).withColumns({
        "x": F.when(F.col("running"), F.round(F.col("occupancy") * 1000, 3)), "full_group": F.col("belt_running")})


@query("w17_stale_frames", sql("""SELECT line_id, t_ms, seq, i - COALESCE(li, 0) AS stale, i - COALESCE(lg, 0) AS since_full,
  i - COALESCE(li, 0) = 3 AS exceeded, i - COALESCE(lg, 0) = 11 AS struggling FROM k""", **MISSING))
def w17(spark, d):
    out = sg.stale_frames(with_missing(spark, d), "x", "full_group", cap=2)
    return out.select(*sg.KEY, "stale", "since_full", "exceeded", "struggling")


@query("w18_carry_forward", sql("""SELECT line_id, t_ms, seq, x, CASE WHEN i - li <= 2 THEN lx END AS held,
  COALESCE(i - li <= 2 AND x IS NULL, FALSE) AS fallback FROM k""", **MISSING))
def w18(spark, d):
    return sg.carry_forward(with_missing(spark, d), "x", most=2).select(*sg.KEY, "x", "held", "fallback")


_STATE = "CASE WHEN fault THEN 'FAULT' WHEN running THEN 'TRACKING' ELSE 'WAITING' END"


@query("w19_state_changes", sql(f"""SELECT line_id, t_ms, seq, old, new, trigger FROM (
  SELECT line_id, t_ms, seq, LAG({_STATE}) {OVER} AS old, {_STATE} AS new, CAST(seq AS VARCHAR) AS trigger FROM signals) WHERE old <> new"""))
def w19(spark, d):
    s = t.signals(spark, d).withColumns({
        "state": F.when(F.col("fault"), "FAULT").when(F.col("running"), "TRACKING").otherwise("WAITING"),
        "why": F.col("seq").cast("string")})
    return sg.state_changes(s, "state", "why")


@query("w20_heartbeat_gaps", sql(f"""SELECT line_id, from_ms, t_ms AS to_ms, t_ms - from_ms AS silent_ms FROM (
  SELECT *, LAG(t_ms) {OVER} AS from_ms FROM (SELECT *, LAG(running) {OVER} AS was FROM signals)
  WHERE was IS DISTINCT FROM running) WHERE t_ms - from_ms > 86400000"""))
def w20(spark, d):
    return sg.heartbeat_gaps(t.signals(spark, d), "running", 86_400_000)


HOLD = 43_200_000
LATENCY = f"""SELECT line_id, t_ms, seq, CAST(CASE WHEN nxt - t_ms <= {HOLD} THEN nxt - t_ms ELSE {HOLD} END AS BIGINT) AS latency_ms,
  CASE WHEN nxt - t_ms <= {HOLD} THEN 'plc_ack' ELSE 'timeout' END AS reason FROM (
  SELECT e.*, (SELECT MIN(f.t_ms) FROM e1 f WHERE f.line_id = e.line_id AND f.edge = 'falling' AND f.t_ms >= e.t_ms) AS nxt FROM e1 e)
  WHERE running AND occupancy >= CAST(0.06 AS DOUBLE)"""


@query("j7_stop_latency", sql(LATENCY, **EDGES))
def j7(spark, d):
    stop = F.col("running") & (F.col("occupancy") >= 0.06)
    return sg.stop_latency(t.signals(spark, d), stop, HOLD)


def fold_sql(start: str, step: str, emit: str, src: str = "n0", extra: dict | None = None) -> str:
    """A state machine as recursion over row numbers, one line at a time."""
    return with_views("signals", recursive=True, ctes={
        "n0": f"SELECT *, ROW_NUMBER() {OVER} AS i FROM signals", **(extra or {}),
        "fold": f"{start} UNION ALL {step}"}, body=emit)


def latch_sql(n: int, m: int) -> str:
    # fc = faults counted while armed, cc = clean rows counted while disarmed
    step = f"""SELECT line_id, i, t_ms, seq, fault,
      CASE WHEN fault AND armed AND fc + 1 >= {n} THEN FALSE WHEN NOT fault AND NOT armed AND cc + 1 >= {m} THEN TRUE ELSE armed END AS armed,
      CASE WHEN fault AND armed AND fc + 1 < {n} THEN fc + 1 ELSE 0 END AS fc,
      CASE WHEN NOT fault AND NOT armed AND cc + 1 < {m} THEN cc + 1 ELSE 0 END AS cc,
      fault AND armed AND fc + 1 >= {n} AS hit"""
    first = "(SELECT n0.line_id, n0.i, n0.t_ms, n0.seq, n0.fault, TRUE AS armed, 0 AS fc, 0 AS cc FROM n0 WHERE i = 1)"
    later = "(SELECT n0.line_id, n0.i, n0.t_ms, n0.seq, n0.fault, p.armed, p.fc, p.cc FROM fold p JOIN n0 ON n0.line_id = p.line_id AND n0.i = p.i + 1)"
    return fold_sql(f"{step} FROM {first}", f"{step} FROM {later}", "SELECT line_id, t_ms, seq FROM fold WHERE hit")


@query("s3_fault_latch", latch_sql(2, 3))
def s3(spark, d):
    return sg.latch(t.signals(spark, d), F.col("fault"), 2, 3)


@query("s3_fault_latch_in_windows", sql(f"""SELECT line_id, t_ms, seq FROM (
  SELECT *, NOT fault AND LAG(NOT fault) OVER (PARTITION BY line_id, grp ORDER BY t_ms, seq) AS hit FROM (
   SELECT *, SUM(CASE WHEN running IS DISTINCT FROM was THEN 1 ELSE 0 END) {HELD} AS grp FROM (SELECT *, LAG(running) {OVER} AS was FROM signals)) WHERE running)
  WHERE hit QUALIFY ROW_NUMBER() OVER (PARTITION BY line_id, grp ORDER BY t_ms, seq) = 1"""))
def s3_windows(spark, d):
    return sg.latch(t.signals(spark, d), ~F.col("fault"), 2, 1, F.col("running"))


@query("s4_fault_self_clear", fold_sql(
    """SELECT line_id, i, t_ms, seq, fault AS active, 0 AS clean, FALSE AS hit FROM n0 WHERE i = 1""",
    """SELECT n0.line_id, n0.i, n0.t_ms, n0.seq,
       CASE WHEN fault THEN TRUE WHEN active AND clean + 1 >= 3 THEN FALSE ELSE active END,
       CASE WHEN fault OR NOT active OR clean + 1 >= 3 THEN 0 ELSE clean + 1 END, active AND NOT fault AND clean + 1 >= 3
       FROM fold p JOIN n0 ON n0.line_id = p.line_id AND n0.i = p.i + 1""",
    "SELECT line_id, t_ms, seq FROM fold WHERE hit"))
def s4(spark, d):
    return sg.self_clear(t.signals(spark, d), F.col("fault"), 3)


BELT = {"b0": f"SELECT *, belt_running AND NOT COALESCE(LAG(belt_running) {OVER}, FALSE) AS opens, LEAD(t_ms) {OVER} AS nxt FROM signals",
        "b1": f"SELECT *, COUNT(*) FILTER (WHERE opens) {HELD} AS window_no FROM b0",
        "b2": """SELECT line_id, window_no, MIN(t_ms) AS open_ms, ARG_MAX(COALESCE(nxt, -1), t_ms) AS c, COUNT(*) AS frames
                 FROM b1 WHERE belt_running GROUP BY line_id, window_no""",
        "b3": """SELECT *, ROW_NUMBER() OVER (PARTITION BY line_id, window_no ORDER BY t_ms, seq) AS pos,
                 SUM(CASE WHEN fault THEN 0 ELSE 1 END) OVER (PARTITION BY line_id, window_no ORDER BY t_ms, seq) AS grp FROM b1 WHERE belt_running""",
        "b4": """SELECT line_id, window_no, grp, COUNT(*) FILTER (WHERE fault) AS f FROM b3 GROUP BY ALL"""}
WINDOWS = f"""SELECT b2.line_id, open_ms, CASE WHEN c >= 0 THEN c END AS close_ms, frames,
  (SELECT MAX(f) FROM b4 WHERE b4.line_id = b2.line_id AND b4.window_no = b2.window_no) >= 2 AS latched FROM b2"""


@query("s19_inspection_windows", sql(WINDOWS, **BELT))
def s19(spark, d):
    return sg.inspection_windows(t.signals(spark, d), 2, 3)


@query("d4_inspection_counts", sql("""SELECT line_id, COUNT(*) AS inspected, COUNT(*) FILTER (WHERE NOT latched) AS good,
  COUNT(*) FILTER (WHERE latched) AS defects, ROUND(COUNT(*) FILTER (WHERE latched)/CAST(COUNT(*) AS DOUBLE)*100, 4) AS defect_rate
  FROM wins GROUP BY line_id""", **BELT, wins=WINDOWS))
def d4(spark, d):
    return rp.inspection_counts(sg.inspection_windows(t.signals(spark, d), 2, 3))


@query("j10_in_window", sql("""SELECT s.line_id, s.t_ms, s.seq, w.open_ms AS window_open_ms FROM signals s
  JOIN wins w ON s.line_id = w.line_id AND s.t_ms >= w.open_ms AND (w.close_ms IS NULL OR s.t_ms < w.close_ms)""", **BELT, wins=WINDOWS))
def j10(spark, d):
    signals = t.signals(spark, d)
    windows = sg.islands(signals, F.col("belt_running"))
    return sg.in_window(signals, windows).select(*sg.KEY, "window_open_ms")


@query("j10_in_overlapping_windows", sql("""SELECT s.line_id, s.t_ms, s.seq, MAX((w.close_ms, w.open_ms))[2] AS window_open_ms FROM signals s
  JOIN (SELECT line_id, t_ms AS open_ms, t_ms + 3600000 * (1 + seq % 24) AS close_ms FROM signals WHERE fault) w
  ON s.line_id = w.line_id AND s.t_ms >= w.open_ms AND s.t_ms < w.close_ms GROUP BY s.line_id, s.t_ms, s.seq"""))
def j10_overlapping(spark, d):
    signals = t.signals(spark, d)
    windows = signals.where("fault").select(
        "line_id", F.col("t_ms").alias("open_ms"), (F.col("t_ms") + 3_600_000 * (1 + F.col("seq") % 24)).alias("close_ms"))
    return sg.in_window(signals, windows).select(*sg.KEY, "window_open_ms")


@query("s9_stop_latch", sql(f"""SELECT line_id, t_ms, seq, released_ms, reason FROM (SELECT line_id, t_ms, seq, t_ms + latency_ms AS released_ms, reason,
  LEAD(t_ms) {OVER} AS again_ms FROM ({LATENCY})) WHERE again_ms IS NULL OR again_ms > released_ms OR reason = 'plc_ack' AND again_ms >= released_ms""", **EDGES))
def s9(spark, d):
    stop = F.col("running") & (F.col("occupancy") >= 0.06)
    return sg.stop_releases(t.signals(spark, d), stop, HOLD)


@query("s11_transfer_timeout", sql(f"""SELECT line_id, t_ms, seq, since_ms, t_ms - since_ms AS lasted_ms FROM (
  SELECT *, MIN(t_ms) OVER (PARTITION BY line_id, grp) AS since_ms FROM (
   SELECT *, SUM(CASE WHEN running IS DISTINCT FROM was THEN 1 ELSE 0 END) {HELD} AS grp FROM (SELECT *, LAG(running) {OVER} AS was FROM signals)))
  WHERE running AND t_ms - since_ms > 86400000
  QUALIFY ROW_NUMBER() OVER (PARTITION BY line_id, grp ORDER BY t_ms, seq) = 1"""))
def s11(spark, d):
    return sg.transfer_timeouts(t.signals(spark, d), F.col("running"), 86_400_000)


@query("s13_sticky_result", sql(f"""SELECT line_id, t_ms, seq, CASE WHEN t_ms - lt <= 43200000 THEN lr END AS shown FROM (
  SELECT *, LAST_VALUE(CASE WHEN belt_running THEN t_ms END IGNORE NULLS) {HELD} AS lt,
  LAST_VALUE(CASE WHEN belt_running THEN CASE WHEN fault THEN 'FAULT_ROW_FUSED' ELSE 'OK' END END IGNORE NULLS) {HELD} AS lr FROM signals)"""))
def s13(spark, d):
    result = F.when(F.col("belt_running"), F.when(F.col("fault"), "FAULT_ROW_FUSED").otherwise("OK"))
    return sg.sticky(t.signals(spark, d), result, 43_200_000).select(*sg.KEY, "shown")


@query("s16_sliding_fault_rate", sql("""SELECT line_id, start_ms, COUNT(*) AS frames, COUNT(*) FILTER (WHERE fault) AS faults,
  ROUND(COUNT(*) FILTER (WHERE fault)/CAST(COUNT(*) AS DOUBLE)*100, 4) AS fault_rate FROM (
  SELECT *, (t_ms//60000 - k)*60000 AS start_ms FROM signals, RANGE(5) r(k)) GROUP BY line_id, start_ms"""))
def s16(spark, d):
    ts = F.timestamp_millis("t_ms")
    bad = F.count_if("fault")
    return (t.signals(spark, d).groupBy("line_id", F.window(ts, "5 minutes", "1 minute").alias("w"))
            .agg(F.count(F.lit(1)).alias("frames"), bad.alias("faults"),
                 F.round(bad / F.count(F.lit(1)) * 100, 4).alias("fault_rate"))
            .select("line_id", F.unix_millis("w.start").alias("start_ms"), "frames", "faults", "fault_rate"))


@query("s17_running_sessions", sql(f"""SELECT line_id, MIN(t_ms) AS start_ms, MAX(t_ms) + 21600000 AS end_ms, COUNT(*) AS "rows" FROM (
  SELECT *, CAST(SUM(CASE WHEN p IS NULL OR t_ms - p >= 21600000 THEN 1 ELSE 0 END) {HELD} AS BIGINT) AS session FROM (
  SELECT *, LAG(t_ms) {OVER} AS p FROM signals WHERE running)) GROUP BY line_id, session"""))
def s17(spark, d):
    return sg.running_sessions(t.signals(spark, d), 21_600_000)


@query("d6_session_summary", with_views(ctes=FIRES, body="""SELECT line_id, COUNT(*) AS rows_fired, COUNT(*) AS latches,
  ROUND(AVG(overshoot_px), 4) AS avg_overshoot_px, MAX(overshoot_px) AS max_overshoot_px,
  (SELECT g.row_no FROM f g WHERE g.line_id = f.line_id ORDER BY g.overshoot_px DESC, g.t_ms, g.seq LIMIT 1) AS max_row FROM f GROUP BY line_id"""))
def d6(spark, d):
    return rp.session_summary(fires(spark, d))


@query("d7_cycle_summary", with_views(ctes=FIRES, body="""SELECT line_id, t_ms//86400000 AS cycle, COUNT(*) AS rows_fired,
  STRING_AGG(CAST(row_no AS VARCHAR), ',' ORDER BY t_ms, seq) AS row_list,
  STRING_AGG(CAST(clearing_ms AS VARCHAR), ',' ORDER BY t_ms, seq) AS clearing_list,
  STRING_AGG(reason, ',' ORDER BY t_ms, seq) AS reasons, MAX(t_ms) - MIN(t_ms) AS total_ms FROM f GROUP BY ALL"""))
def d7(spark, d):
    return rp.cycle_summary(fires(spark, d).withColumn("cycle", F.expr("t_ms div 86400000")))


@query("d7_cycle_positions", with_views(ctes=FIRES, body="""SELECT line_id, t_ms//86400000 AS cycle,
  CAST(ROW_NUMBER() OVER (PARTITION BY line_id, t_ms//86400000 ORDER BY t_ms, seq) AS INT) AS place, 632 - overshoot_px AS tangent,
  CASE WHEN reason = 'timeout' THEN 657 - overshoot_px END AS boundary FROM f"""))
def d7_positions(spark, d):
    stops = fires(spark, d).withColumns({
        "cycle": F.expr("t_ms div 86400000"), "tangent": F.lit(632.0) - F.col("overshoot_px"),
        "boundary": F.when(F.col("reason") == "timeout", F.lit(657.0) - F.col("overshoot_px"))})
    lists = rp.cycle_summary(stops, ["tangent", "boundary"])
    return (lists.select("line_id", "cycle", F.posexplode(F.arrays_zip("tangent_list", "boundary_list")).alias("place", "at"))
            .select("line_id", "cycle", (F.col("place") + 1).alias("place"), "at.tangent_list", "at.boundary_list")
            .withColumnsRenamed({"tangent_list": "tangent", "boundary_list": "boundary"}))


@query("d8_row_quality", sql(f"""SELECT line_id, fire_no, COUNT(*) AS total_frames, COUNT(*) FILTER (WHERE belt_running) AS full_frames,
  COUNT(*) FILTER (WHERE x IS NULL) AS fallback_frames FROM (
  SELECT *, COUNT(*) FILTER (WHERE ack) OVER (PARTITION BY line_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fire_no FROM k) GROUP BY ALL""", **MISSING))
def d8(spark, d):
    return rp.row_quality(with_missing(spark, d), "ack", "belt_running", "x")


@query("d14_perf_summary", with_views(body="""SELECT line_id, start_ms, COUNT(*) AS frames, COUNT(*)/CAST(3600 AS DOUBLE) AS fps,
  ROUND(AVG(value), 4) AS mean_ms, COUNT(*) FILTER (WHERE event_type = 'view')/CAST(3600 AS DOUBLE) AS detections_per_s,
  MEDIAN(value) AS median_ms, MAX(value) AS max_ms
  FROM (SELECT *, user_id % 10 AS line_id, epoch_us(ts)//3600000000*3600000 AS start_ms FROM events) GROUP BY line_id, start_ms"""))
def d14(spark, d):
    e = t.table(spark, d, "events").select((F.col("user_id") % 10).alias("line_id"), t.epoch_ms("ts").alias("t_ms"),
                                           F.col("value").alias("total_ms"), (F.col("event_type") == "view").alias("detected"))
    return rp.perf_summary(e, 3600)


@query("d15_drop_summary", with_views(body="""SELECT line_id, t_ms//18000000*18000000 AS start_ms, COUNT(*) AS frames, CAST(SUM(dropped) AS BIGINT) AS dropped FROM (
  SELECT *, COALESCE(GREATEST(0, (t_ms - LAG(t_ms) OVER (PARTITION BY line_id ORDER BY t_ms, event_id))//3600000 - 1), 0) AS dropped
  FROM (SELECT *, user_id % 10 AS line_id, epoch_us(ts)//1000 AS t_ms FROM events)) GROUP BY ALL"""))
def d15(spark, d):
    e = t.signals(spark, d).select((F.col("line_id") % 10).alias("line_id"), "t_ms", "seq")
    return rp.drop_summary(e, period_ms=3_600_000, window_ms=18_000_000)


@query("w13_profile_bumps", with_views(ctes={
    "p": "SELECT vec_id AS frame_id, vec_id % 4 AS line_id, CAST(UNNEST(embedding) AS DOUBLE) + 1 AS v, UNNEST(RANGE(len(embedding))) AS x FROM embeddings",
    "s": """SELECT *, (COALESCE(LAG(v,2) OVER w,0) + COALESCE(LAG(v,1) OVER w,0) + v + COALESCE(LEAD(v,1) OVER w,0) + COALESCE(LEAD(v,2) OVER w,0))/5 AS m FROM p WINDOW w AS (PARTITION BY line_id, frame_id ORDER BY x)""",
    "o": "SELECT *, MAX(m) OVER (PARTITION BY line_id, frame_id) AS peak, m >= MAX(m) OVER (PARTITION BY line_id, frame_id)*0.9::DOUBLE AS up FROM s",
    "q": """SELECT *, up AND NOT COALESCE(LAG(up) OVER (PARTITION BY line_id, frame_id ORDER BY x), FALSE) AS st,
       MIN(x) FILTER (WHERE up) OVER (PARTITION BY line_id, frame_id) AS a, MAX(x) FILTER (WHERE up) OVER (PARTITION BY line_id, frame_id) AS b FROM o"""}, body="""
SELECT line_id, frame_id, CAST(COUNT(*) FILTER (WHERE st) AS INT) AS bumps,
  COALESCE(ROUND((MAX(peak) - MIN(m) FILTER (WHERE NOT up AND x BETWEEN a AND b))/MAX(peak)*100, 4), 0) AS valley_pct FROM q GROUP BY ALL"""))
def w13(spark, d):
    return sg.profile_bumps(t.column_profiles(spark, d), frac=0.9).select("line_id", "frame_id", "bumps", "valley_pct")
