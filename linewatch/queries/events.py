"""Event log: files, reports, pairing, lookup."""

from pyspark.sql import functions as F

from linewatch.functions import geometry as g
from linewatch.operators import events as ev
from linewatch.operators import reports as rp
from linewatch.operators import signals as sg
from linewatch.queries import query
from linewatch.queries.rows import V2_DEFAULT, v1, verdict_ctes
from linewatch.queries.signals import HELD, OVER
from linewatch.queries.sql import with_views
from linewatch.sources import event_log as files
from linewatch.sources import images as im
from linewatch.sources import profile_files, shared, traces
from linewatch.sources import tables as t


def log_sql(body: str, **ctes: str) -> str:
    return with_views("event_log", ctes=ctes, body=body)


_ISO = "strftime(make_timestamp(t_ms*1000), '%Y-%m-%dT%H:%M:%S.%g') AS timestamp_iso"
_TEXT = f"{_ISO}, event_type, profile_name, fault_reason, image_filename, extra_json"


def written_log(spark, d):
    path = shared.scratch(spark, "events")
    files.write(files.from_rows(t.event_log(spark, d)), path)
    return path


@query("a1_read_event_log", log_sql(f"SELECT {_TEXT}, event_date, FALSE AS quarantined FROM event_log"))
def a1(spark, d):
    return files.read(spark, written_log(spark, d)).select(
        "timestamp_iso", "event_type", "profile_name", "fault_reason", "image_filename", "extra_json",
        "event_date", "quarantined")


@query("a2_write_event_log", log_sql("SELECT event_date, COUNT(*) AS events FROM event_log GROUP BY event_date"))
def a2(spark, d):
    return files.read(spark, written_log(spark, d)).groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


@query("a4_export_event_log", log_sql(f"SELECT {_TEXT} FROM event_log WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"))
def a4(spark, d):
    out = shared.scratch(spark, "export")
    files.export(spark, written_log(spark, d), "2024-01-10", "2024-01-12", out)
    return spark.read.schema(files.SCHEMA).options(**files.CSV).csv(out).select(
        "timestamp_iso", "event_type", "profile_name", *[F.coalesce(c, F.lit("")).alias(c) for c in
                                                        ("fault_reason", "image_filename", "extra_json")])


@query("a5_apply_retention", log_sql("SELECT event_date, COUNT(*) AS events FROM event_log WHERE event_date >= DATE '2024-01-21' GROUP BY event_date"))
def a5(spark, d):
    path = written_log(spark, d)
    files.apply_retention(spark, path, 10, "2024-01-31")
    return files.read(spark, path).groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


@query("a5_removed_by_retention", log_sql("SELECT event_date, COUNT(*) AS removed FROM event_log WHERE event_date < DATE '2024-01-21' GROUP BY event_date"))
def a5_removed(spark, d):
    return ev.retain(t.event_log(spark, d), 10, F.lit("2024-01-31").cast("date"))[1]


_VERDICT_NAME = "CASE WHEN event_type = 'error' THEN 'FAULT_ROW_FUSED' ELSE 'FAULT_UNKNOWN' END"


@query("a7_defect_image_names", with_views(body=f"""SELECT event_id AS seq, epoch_us(ts) AS taken_us, {_VERDICT_NAME} AS verdict FROM events"""))
def a7(spark, d):
    """File names derived from the events, parsed back."""
    e = t.table(spark, d, "events")
    name = F.concat(F.lit("/images/"), F.date_format("ts", "yyyy-MM-dd-HH-mm-ss-SSSSSS"), F.lit("-"),
                    F.when(F.col("event_type") == "error", "FAULT_ROW_FUSED").otherwise("FAULT_UNKNOWN"), F.lit(".jpg"))
    parsed = im.parse_defect_name(F.col("path"))
    return e.select(F.col("event_id").alias("seq"), name.alias("path")).select(
        "seq", F.expr("1").alias("_one"), parsed["taken"].alias("taken"), parsed["verdict"].alias("verdict")).select(
        "seq", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', taken)").alias("taken_us"), "verdict")


def trace_lines(spark, d):
    """Trace text derived from the events: stops, gaps and state changes."""
    e = t.table(spark, d, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    px = F.floor(F.col("value")).cast("string")
    key = F.col("event_id").cast("string")
    body = (F.when(F.col("event_type") == "view", F.concat(
        F.lit("FIRE-TRACE frame_id="), key, F.lit(" state=ARMED active_row=1 tangent="),
        F.when(F.col("event_id") % 3 == 0, "none").otherwise(px),
        F.lit(" transfer_x=632 boundary=none pieces_total=9 pieces_excluded=2 fire_eligible=true fired=false")))
        .when(F.col("event_type") == "error", F.concat(
            F.lit("FIRE OVERSHOOT: row=2 fired_tangent="), px,
            F.lit(" transfer_x=632 overshoot_px=-7 clearing_duration_ms="), key, F.lit(" clearing_exit_reason=timeout")))
        .when(F.col("event_type") == "click", F.concat(F.lit("STOP-LATENCY fire_to_falling_edge="), px, F.lit("ms")))
        .when(F.col("event_type") == "purchase", F.concat(
            F.lit("STATE: row_status["), key, F.lit("]: WAITING -> STOPPED (trigger=fire)")))
        .otherwise(F.lit("unrelated line")))
    return e.select(F.concat(stamp, F.lit(" | INFO     | m:f:1 - "), body).alias("value"))


@query("a8_trace_fire", with_views(body="""SELECT event_id AS frame_id, 'ARMED' AS state,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(FLOOR(value) AS INT) END AS tangent, 632 AS transfer_x, FALSE AS fired FROM events WHERE event_type = 'view'"""))
def a8_fire(spark, d):
    return traces.typed(traces.parse(trace_lines(spark, d)), "FIRE-TRACE").select(
        "frame_id", "state", "tangent", "transfer_x", "fired")


@query("a8_trace_overshoot", with_views(body="""SELECT CAST(FLOOR(value) AS INT) AS fired_tangent, -7 AS overshoot_px,
  CAST(event_id AS INT) AS clearing_duration_ms, 'timeout' AS clearing_exit_reason FROM events WHERE event_type = 'error'"""))
def a8_overshoot(spark, d):
    return traces.typed(traces.parse(trace_lines(spark, d)), "FIRE OVERSHOOT").select(
        "fired_tangent", "overshoot_px", "clearing_duration_ms", "clearing_exit_reason")


@query("a8_trace_state", with_views(body="""SELECT CONCAT('row_status[', CAST(event_id AS VARCHAR), ']') AS field, 'WAITING' AS old,
  'STOPPED' AS new, 'fire' AS trigger FROM events WHERE event_type = 'purchase'"""))
def a8_state(spark, d):
    return traces.typed(traces.parse(trace_lines(spark, d)), "STATE").drop("ts")


@query("a8_trace_kinds", with_views(body="""SELECT CASE event_type WHEN 'view' THEN 'FIRE-TRACE' WHEN 'error' THEN 'FIRE OVERSHOOT'
  WHEN 'click' THEN 'STOP-LATENCY' ELSE 'STATE' END AS kind, COUNT(*) AS lines FROM events WHERE event_type <> 'signup' GROUP BY 1"""))
def a8_kinds(spark, d):
    return traces.parse(trace_lines(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))


@query("a9_read_profiles", with_views("recipes", body="""SELECT name, expected_width_px, fused_threshold, crop_top, crop_left,
  CAST(0.85 AS DOUBLE) AS solidity_tolerance, 15 AS tripwire_half_width_px FROM recipes"""))
def a9(spark, d):
    path = shared.scratch(spark, "recipes")
    t.recipes(spark, d).write.json(path, ignoreNullFields=True)
    return profile_files.read(spark, path).select(
        "name", "expected_width_px", "fused_threshold", F.col("belt_crop.top").alias("crop_top"),
        F.col("belt_crop.left").alias("crop_left"), "solidity_tolerance", "tripwire_half_width_px")


STATUS = {"last_log": f"""SELECT line_id, profile_name, event_type AS last_event FROM event_log
   QUALIFY ROW_NUMBER() OVER (PARTITION BY line_id ORDER BY t_ms DESC, seq DESC) = 1""",
          "tally": "SELECT line_id, COUNT(*) FILTER (WHERE event_type = 'fault_raised') AS faults, COUNT(*) AS events FROM event_log GROUP BY line_id",
          "last_sig": """SELECT * FROM signals QUALIFY ROW_NUMBER() OVER (PARTITION BY line_id ORDER BY t_ms DESC, seq DESC) = 1""",
          "snap": """SELECT line_id, profile_name, last_event, COALESCE(faults, 0) AS faults, COALESCE(events, 0) AS events, running, fault, ack, t_ms AS last_ms,
   CASE WHEN fault THEN 'FAULT' WHEN running THEN 'TRACKING' ELSE 'WAITING' END AS state
   FROM last_log JOIN tally USING (line_id) FULL JOIN last_sig USING (line_id)"""}


def snapshot(spark, d):
    return rp.status_snapshot(t.event_log(spark, d), t.signals(spark, d))


@query("d19_status_snapshot", with_views("event_log", "signals", ctes=STATUS, body="""
SELECT line_id, profile_name, last_event, faults, events, state, 'production' AS mode, running, fault, ack, last_ms FROM snap"""))
def d19(spark, d):
    return snapshot(spark, d).select("line_id", "profile_name", "last_event", "faults", "events", "state", "mode",
                                     "signals.running", "signals.fault", "signals.ack", "last_ms")


@query("a10_status_json", with_views("event_log", "signals", ctes=STATUS, body="""
SELECT line_id, CAST(to_json({'state': state, 'mode': 'production', 'profile': profile_name,
  'signals': {'running': running, 'fault': fault, 'ack': ack}, 'counts': {'events': events, 'faults': faults}, 'last_ms': last_ms}) AS VARCHAR) AS status FROM snap"""))
def a10(spark, d):
    return rp.status_json(snapshot(spark, d))


@query("p6_is_fault_verdict", with_views("detections", "frames", ctes=verdict_ctes(V2_DEFAULT), body="""
SELECT line_id, frame_id, verdict IN ('FAULT_ROW_FUSED', 'FAULT_UNKNOWN') AS fault FROM fv"""))
def p6(spark, d):
    return v1(spark, d).select("line_id", "frame_id", g.is_fault_verdict(F.col("verdict")).alias("fault"))


@query("p26_event_json_fields", log_sql("""SELECT line_id, seq, CAST(json_extract_string(extra_json, '$.k') AS INT) AS k,
  CASE WHEN CAST(json_extract_string(extra_json, '$.k') AS INT) > 50 THEN CONCAT('{"k":', json_extract_string(extra_json, '$.k'), '}') ELSE '' END AS extra FROM event_log"""))
def p26(spark, d):
    k = F.from_json("extra_json", "k INT")["k"]
    return t.event_log(spark, d).select(
        "line_id", "seq", k.alias("k"),
        F.when(k > 50, F.to_json(F.struct(k.alias("k")))).otherwise("").alias("extra"))


@query("p27_parse_iso", log_sql(f"SELECT line_id, seq, {_ISO}, event_date, t_ms FROM event_log"))
def p27(spark, d):
    iso = t.event_log(spark, d).select("line_id", "seq", files.format_iso(F.col("t_ms")).alias("timestamp_iso"))
    return iso.withColumn("_ts", files.parse_iso(F.col("timestamp_iso"))).select(
        "line_id", "seq", "timestamp_iso", files.event_date(F.col("timestamp_iso")).alias("event_date"),
        t.epoch_ms("_ts").alias("t_ms"))


@query("d5_events_by", log_sql("""SELECT event_date, event_type, profile_name, GROUPING(event_date, event_type, profile_name) AS level, COUNT(*) AS events
  FROM event_log GROUP BY CUBE (event_date, event_type, profile_name)"""))
def d5(spark, d):
    return ev.events_by(t.event_log(spark, d))


@query("d18_verdict_counts", with_views("detections", "frames", ctes={**verdict_ctes(V2_DEFAULT), "h":
  "SELECT fv.*, t_ms//3600000 AS hour FROM fv JOIN frames USING (line_id, frame_id)"}, body=
  "SELECT line_id, hour, GROUPING(line_id, hour) AS level, COUNT(*) AS frames, " + ", ".join(
      f"COUNT(*) FILTER (WHERE verdict = '{v}') AS {v.lower()}" for v in
      ("OK", "FAULT_ROW_FUSED", "FAULT_UNKNOWN", "INFO_COLUMN_FUSED", "INFO_INCOMPLETE_ROW", "INFO_UNKNOWN_NONFAULT"))
  + " FROM h GROUP BY ROLLUP (line_id, hour)"))
def d18(spark, d):
    # t_ms follows from the frame number, so no join back to the frames is needed.
    return rp.verdict_counts(v1(spark, d).withColumn("hour", F.expr("frame_id * 100 div 3600000")))


_CHANGES = "SELECT line_id, t_ms, seq, CONCAT('P', CAST(seq % 7 AS VARCHAR)) AS active_profile FROM event_log WHERE event_type = 'profile_change'"


@query("j6_profile_at", with_views("event_log", ctes={"ch": _CHANGES}, body="""
SELECT e.line_id, e.t_ms, e.seq, c.active_profile FROM event_log e ASOF LEFT JOIN ch c ON e.line_id = c.line_id AND e.t_ms >= c.t_ms"""))
def j6(spark, d):
    log = t.event_log(spark, d)
    changes = (log.where(F.col("event_type") == "profile_change")
               .withColumn("profile_name", F.concat(F.lit("P"), (F.col("seq") % 7).cast("string"))))
    return ev.profile_at(log.select(*sg.KEY), changes).select(*sg.KEY, "active_profile")


@query("j8_fault_intervals", log_sql("""SELECT line_id, seq, fault_reason, t_ms AS raised_ms, c AS cleared_ms, c - t_ms AS duration_ms, c IS NULL AS is_open FROM (
  SELECT e.*, (SELECT MIN(k.t_ms) FROM event_log k WHERE k.line_id = e.line_id AND k.event_type = 'fault_cleared' AND k.t_ms >= e.t_ms) AS c
  FROM event_log e WHERE event_type = 'fault_raised')"""))
def j8(spark, d):
    return ev.fault_intervals(t.event_log(spark, d))


@query("j8_uptime", log_sql("""SELECT line_id, COUNT(*) AS faults, CAST(SUM(c - t_ms) AS BIGINT) AS fault_ms, MAX(c - t_ms) AS longest_ms FROM (
  SELECT e.*, (SELECT MIN(k.t_ms) FROM event_log k WHERE k.line_id = e.line_id AND k.event_type = 'fault_cleared' AND k.t_ms >= e.t_ms) AS c
  FROM event_log e WHERE event_type = 'fault_raised') WHERE c IS NOT NULL GROUP BY line_id"""))
def j8_uptime(spark, d):
    return ev.uptime(t.event_log(spark, d))


IMAGES = ("event_log", "defect_images")


@query("j9_faults_with_image", with_views(*IMAGES, body="""SELECT e.line_id, e.seq, image_filename, i.t_ms AS image_ms
  FROM event_log e LEFT JOIN defect_images i ON filename = image_filename WHERE image_filename <> ''"""))
def j9(spark, d):
    out = ev.with_images(t.event_log(spark, d), t.defect_images(spark, d))
    return out.select("line_id", "seq", "image_filename", "image_ms")


@query("j9_faults_without_image", with_views(*IMAGES, body="""SELECT line_id, seq, image_filename FROM event_log
  WHERE image_filename <> '' AND image_filename NOT IN (SELECT filename FROM defect_images)"""))
def j9_without(spark, d):
    return ev.without_image(t.event_log(spark, d), t.defect_images(spark, d)).select("line_id", "seq", "image_filename")


@query("j9_orphan_images", with_views(*IMAGES, body="""SELECT line_id, filename FROM defect_images
  WHERE filename NOT IN (SELECT image_filename FROM event_log)"""))
def j9_orphans(spark, d):
    return ev.orphan_images(t.event_log(spark, d), t.defect_images(spark, d)).select("line_id", "filename")


@query("w14_recent_defects", log_sql("""SELECT line_id, t_ms, seq, fault_reason, CAST(r AS INT) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY line_id ORDER BY t_ms DESC, seq DESC) AS r FROM event_log WHERE event_type = 'fault_raised') WHERE r <= 20"""))
def w14(spark, d):
    faults = t.event_log(spark, d).where(F.col("event_type") == "fault_raised")
    return sg.newest(faults, 20).select(*sg.KEY, "fault_reason", "rank")


@query("w15_unexpected_restarts", log_sql(f"""SELECT line_id, t_ms, seq, previous FROM (
  SELECT *, LAG(event_type) {OVER} AS previous FROM event_log WHERE event_type IN ('startup','shutdown'))
  WHERE event_type = 'startup' AND previous IS DISTINCT FROM 'shutdown'"""))
def w15(spark, d):
    return ev.unexpected_restarts(t.event_log(spark, d))


@query("o2_newest_first", log_sql("SELECT t_ms, seq, event_type FROM event_log"))
def o2(spark, d):
    return t.event_log(spark, d).select("t_ms", "seq", "event_type").orderBy(F.desc("t_ms"), F.desc("seq"))


@query("o3_latest_faults", log_sql("""SELECT t_ms, seq, line_id, fault_reason FROM event_log WHERE event_type = 'fault_raised' ORDER BY t_ms DESC, seq DESC LIMIT 50"""))
def o3(spark, d):
    return (t.event_log(spark, d).where(F.col("event_type") == "fault_raised").orderBy(F.desc("t_ms"), F.desc("seq"))
            .select("t_ms", "seq", "line_id", "fault_reason").limit(50))


@query("o5_union_of_sources", with_views(*IMAGES, body="""SELECT line_id, t_ms, event_type AS what FROM event_log
  UNION ALL SELECT line_id, t_ms, 'image' FROM defect_images"""))
def o5(spark, d):
    log = t.event_log(spark, d).select("line_id", "t_ms", F.col("event_type").alias("what"))
    return log.unionByName(t.defect_images(spark, d).select("line_id", "t_ms", F.lit("image").alias("what")))


@query("o7_deduplicate", log_sql("SELECT line_id, t_ms, seq, event_type FROM event_log"))
def o7(spark, d):
    """The log and a second delivery of its faults."""
    log = t.event_log(spark, d)
    again = log.where(F.col("event_type").startswith("fault"))
    return ev.deduplicate(log.unionByName(again)).select("line_id", "t_ms", "seq", "event_type")


__all__ = ["HELD"]
