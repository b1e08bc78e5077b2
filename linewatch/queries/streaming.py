"""Streaming forms, over several files and batches, with the twins of their batch forms."""

from pyspark.sql import functions as F

from linewatch.operators import automata as am
from linewatch.queries import REGISTRY, query
from linewatch.queries import signals as batch
from linewatch.queries import stateful
from linewatch.queries.events import _TEXT, written_log
from linewatch.queries.sql import with_views
from linewatch.queries.stateful import cycled, line_events
from linewatch.sources import event_log as files
from linewatch.sources import shared
from linewatch.sources import tables as t
from linewatch.streaming import machines as mc
from linewatch.streaming import streams
from linewatch.streaming.keyed import on_stream

DAY = 86_400_000


def arriving(spark, df, parts=3, late="10 minutes", by="t_ms"):
    """A history as a stream that arrives in parts, a part a batch, closed at its end."""
    path = shared.scratch(spark, "arrivals")
    return streams.opened(spark, df.schema, path, late, maxFilesPerTrigger=streams.arrivals(df, path, parts, by))


def streamed(spark, df):
    """Work off a stream into a table and read that back."""
    path = shared.scratch(spark, "stream")
    streams.run_to_table(df, path, path + "-checkpoint")
    return spark.read.schema(df.schema).parquet(path)


def held(spark, df, machine, keys=("line_id",), order=("t_ms", "seq"), **options):
    """The machine over the whole history as a stream; rows wait in slots of a day."""
    return streamed(spark, on_stream(arriving(spark, df), machine, keys, list(order), hold=True, slot_ms=DAY, **options))


@query("a3_stream_event_log", with_views("event_log", body=f"SELECT {_TEXT}, event_date FROM event_log"))
def a3(spark, d):
    log = files.stream(spark, written_log(spark, d), 100)
    return streamed(spark, log.select("timestamp_iso", "event_type", "profile_name", "fault_reason", "image_filename",
                                      "extra_json", "event_date"))


def event_rows(spark, d):
    return t.table(spark, d, "events").select(
        F.col("user_id").alias("line_id"), t.epoch_ms("ts").alias("t_ms"), F.col("event_id").alias("seq"), "event_type", "value",
        F.col("event_type").isin("click", "view", "purchase").alias("running"), (F.col("event_type") == "error").alias("fault"))


@query("a11_command_sink", with_views("signals", body="SELECT line_id, seq, CASE WHEN running THEN 'set_stop' ELSE 'set_error' END AS command FROM signals WHERE running OR fault"))
def a11(spark, d):
    commands = arriving(spark, event_rows(spark, d)).where("running OR fault").select(
        "line_id", "seq", "ts", F.when(F.col("running"), "set_stop").otherwise("set_error").alias("command"))
    path = shared.scratch(spark, "commands")
    streams.command_sink(commands, path, path + "-checkpoint", "ts").awaitTermination()
    return spark.read.schema("line_id long, seq long, command string").parquet(f"{path}/batch=*")


@query("s14_perf_stream", with_views(body="""SELECT user_id AS line_id, epoch_us(ts)//3600000000*3600000 AS start_ms, COUNT(*) AS frames,
  ROUND(AVG(value), 4) AS mean_ms, MAX(value) AS max_ms, COUNT(*) FILTER (WHERE event_type = 'view') AS detections FROM events GROUP BY 1, 2"""))
def s14(spark, d):
    e = arriving(spark, event_rows(spark, d)).withColumns({"total_ms": F.col("value"), "detected": F.col("event_type") == "view"})
    return streamed(spark, streams.perf(e, "1 hour")).withColumn("mean_ms", F.round("mean_ms", 4))


_DROPS = """SELECT user_id AS line_id, epoch_us(ts)//3600000000*3600000 AS start_ms, COUNT(*) AS frames,
  CAST(SUM(event_id % 3) AS BIGINT) AS dropped FROM events GROUP BY 1, 2"""


@query("s15_drop_stream", with_views(body=_DROPS))
def s15(spark, d):
    return streamed(spark, streams.drops(arriving(spark, event_rows(spark, d)).withColumn("dropped", F.col("seq") % 3), "1 hour"))


@query("s15_drop_upserts", with_views(body=_DROPS))
def s15_upserts(spark, d):
    """The same tally in update mode: a window changes in several batches, its newest row counts."""
    tally = streams.drops(arriving(spark, event_rows(spark, d), by="seq").withColumn("dropped", F.col("seq") % 3), "1 hour")
    path = shared.scratch(spark, "upserts")
    streams.upsert_sink(tally, path, path + "-checkpoint").awaitTermination()
    return streams.upserted(spark, tally.schema, path, ["line_id", "start_ms"])


@query("s16_fault_rate_stream", with_views("signals", body="""SELECT line_id, start_ms, COUNT(*) AS frames, COUNT(*) FILTER (WHERE fault) AS faults,
  ROUND(COUNT(*) FILTER (WHERE fault)/CAST(COUNT(*) AS DOUBLE)*100, 4) AS fault_rate FROM (
  SELECT *, (t_ms//60000 - k)*60000 AS start_ms FROM signals, RANGE(5) r(k)) GROUP BY line_id, start_ms"""))
def s16_stream(spark, d):
    return streamed(spark, streams.fault_rate(arriving(spark, event_rows(spark, d)))).withColumn("fault_rate", F.round("fault_rate", 4))


@query("s17_session_stream", with_views("signals", body="""SELECT line_id, MIN(t_ms) AS start_ms, MAX(t_ms) + 21600000 AS end_ms, COUNT(*) AS "rows" FROM (
  SELECT *, SUM(CASE WHEN p IS NULL OR t_ms - p >= 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY t_ms, seq) AS session FROM (
  SELECT *, LAG(t_ms) OVER (PARTITION BY line_id ORDER BY t_ms, seq) AS p FROM signals WHERE running)) GROUP BY line_id, session"""))
def s17_stream(spark, d):
    return streamed(spark, streams.sessions(arriving(spark, event_rows(spark, d)), "6 hours"))


@query("s21_bounded_input", with_views(body="""SELECT part // 2 AS batch, COUNT(*) AS taken,
  CAST(SUM(COUNT(*)) OVER () - SUM(COUNT(*)) OVER (ORDER BY part // 2) AS BIGINT) AS waiting FROM (
  SELECT (t - MIN(t) OVER ()) * 20 // (MAX(t) OVER () + 1 - MIN(t) OVER ()) AS part FROM (SELECT epoch_us(ts)//1000 AS t FROM events)) GROUP BY 1"""))
def s21(spark, d):
    """Twenty files, two a batch: what each batch took and what waited in the source; nothing is dropped."""
    rows = event_rows(spark, d)
    path, taken = shared.scratch(spark, "arrivals"), shared.scratch(spark, "taken")
    streams.arrivals(rows, path, 20, closed=False, files=1)
    stream = streams.opened(spark, rows.schema, path, maxFilesPerTrigger=2)
    streams.admitted(stream, taken, taken + "-checkpoint").awaitTermination()
    return streams.admissions(spark, taken)


@query("o7_deduplicated_stream", with_views("event_log", body="SELECT line_id, seq, event_type FROM event_log"))
def o7_stream(spark, d):
    """Every event delivered twice in one stream; the second copy is dropped."""
    twice = arriving(spark, event_rows(spark, d).withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n"))
    out = streamed(spark, streams.deduplicated(twice, ["line_id", "seq"]).select("line_id", "seq"))
    return out.join(t.event_log(spark, d).select("line_id", "seq", "event_type"), ["line_id", "seq"])


def twin(name):
    """SQL of the batch form, which ``batch`` or ``stateful`` has registered."""
    return REGISTRY[name].sql


@query("s1_line_state_stream", twin("s1_line_state"))
def s1(spark, d):
    return held(spark, line_events(spark, d), mc.LineState(3))


@query("s2_row_phase_stream", twin("s2_row_phase"))
def s2(spark, d):
    return held(spark, t.signals(spark, d).withColumn("occupied", F.col("occupancy") >= 0.02), mc.RowPhase())


@query("s4_fault_self_clear_stream", twin("s4_fault_self_clear"))
def s4(spark, d):
    return held(spark, t.signals(spark, d), mc.SelfClear(3))


@query("s10_ack_clears_stream", with_views("signals", ctes={
    "a": "SELECT *, ack AND NOT COALESCE(LAG(ack) OVER (PARTITION BY line_id ORDER BY t_ms, seq), TRUE) AS rises, ROW_NUMBER() OVER (PARTITION BY line_id ORDER BY t_ms, seq) AS i FROM signals",
    "b": """SELECT *, COALESCE(MAX(CASE WHEN fault THEN i END) OVER (PARTITION BY line_id ORDER BY i), 0) AS raised,
      COALESCE(MAX(CASE WHEN rises THEN i END) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acked FROM a"""},
    body="SELECT line_id, t_ms, seq, raised > acked AS cleared_error, raised > acked AS cleared_fault FROM b WHERE rises"))
def s10(spark, d):
    return held(spark, t.signals(spark, d), mc.AckEdge())


@query("s12_rate_limit_stream", twin("s12_rate_limit"))
def s12(spark, d):
    return held(spark, cycled(spark, d), mc.RateLimit(500), ["line_id", "cycle"], ["t_ms", "frame_id"])


@query("s6_track_row_lines_stream")
def s6(spark, d):
    xs = am.row_xs(t.detections(spark, d), cycled(spark, d))
    return held(spark, xs.select("line_id", "cycle", "t_ms", "frame_id", "row_xs"), mc.RowLines(632.0), ["line_id", "cycle"], ["t_ms", "frame_id"])


@query("s8_column_stops_stream")
def s8(spark, d):
    edges = am.frame_edges(t.detections(spark, d), cycled(spark, d), t.BANDS)
    return held(spark, edges.select("line_id", "t_ms", "frame_id", "running", "edges", "cols"),
                mc.ColumnStops(grid_rows=3, grid_columns=8), order=["t_ms", "frame_id"])


def delivered(spark, d):
    """Events as a bad network delivers them: every seventh twice, every eleventh three days late."""
    e = line_events(spark, d)
    copies = F.when(F.col("seq") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    delay = F.when(F.col("seq") % 11 == 0, 3 * DAY).otherwise(0)
    return e.withColumn("copy", F.explode(copies)).withColumn("came_ms", F.col("t_ms") + delay)


_DELIVERED = {
    "e": "SELECT user_id AS line_id, epoch_us(ts)//1000 AS t_ms, event_id AS seq FROM events",
    "c": """SELECT e.*, t_ms + CASE WHEN seq % 11 = 0 THEN 259200000 ELSE 0 END AS came_ms FROM e JOIN RANGE(2) r(k) ON k = 0 OR seq % 7 = 0""",
    "p": "SELECT *, (came_ms - MIN(came_ms) OVER ()) * 5 // (MAX(came_ms) OVER () + 1 - MIN(came_ms) OVER ()) AS part FROM c",
    "m": "SELECT part, MAX(MAX(t_ms)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000 AS mark FROM p GROUP BY part",
    "o": """SELECT line_id, t_ms, seq, CASE WHEN late THEN 'late' WHEN ROW_NUMBER() OVER (PARTITION BY line_id, t_ms, seq, late) > 1 THEN 'duplicate' ELSE 'handled' END AS outcome
      FROM (SELECT p.*, COALESCE(t_ms <= mark, FALSE) AS late FROM p JOIN m USING (part))"""}


@query("s18_late_results_stream", with_views(ctes=_DELIVERED, body="SELECT line_id, t_ms, seq, outcome FROM o"))
def s18(spark, d):
    """Every delivered row has one outcome: handled, duplicate or late (beyond the watermark)."""
    stream = arriving(spark, delivered(spark, d), 5, by="came_ms")
    out = streamed(spark, on_stream(stream, mc.LineState(3), order=["t_ms", "seq"], hold=True, slot_ms=DAY, ledger=True))
    return out.select("line_id", "t_ms", "seq", "outcome")


def inspected(spark, d):
    """One query, two stateful operators: line states, then belt windows and event rows of those states."""
    e = line_events(spark, d)
    rows = t.signals(spark, d).select("line_id", "t_ms", "seq", "belt_running", "fault").join(e, ["line_id", "t_ms", "seq"])
    rows = rows.withColumn("profile", F.concat(F.lit("P"), (F.col("seq") % 3).cast("string")))
    states = on_stream(arriving(spark, rows), mc.LineState(3, "belt_running boolean, fault boolean, profile string"),
                       order=["t_ms", "seq"], hold=True, slot_ms=DAY, event_time="ts")
    return streamed(spark, on_stream(states, mc.Inspection(2), order=["t_ms", "seq"]))


@query("s19_inspection_windows_stream", batch.sql(f"SELECT * FROM ({batch.WINDOWS}) WHERE close_ms IS NOT NULL", **batch.BELT))
def s19(spark, d):
    """Windows that have closed; one still open at the end of the stream has not come out."""
    return inspected(spark, d).where("kind = 'window'").select("line_id", "open_ms", "close_ms", "frames", "latched")


@query("s20_events_from_states_stream", with_views(recursive=True, ctes={**stateful.STATE_CTES, "prof": """
  SELECT user_id AS line_id, epoch_us(ts)//1000 AS t_ms, event_id AS seq, CONCAT('P', CAST(event_id % 3 AS VARCHAR)) AS profile,
    LAG(CONCAT('P', CAST(event_id % 3 AS VARCHAR))) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000, event_id) AS before FROM events"""}, body="""
SELECT line_id, t_ms, seq, CASE WHEN st = 'FAULT' THEN 'fault_raised' ELSE 'fault_cleared' END AS event_type,
  CASE WHEN st = 'FAULT' THEN why ELSE '' END AS fault_reason, state_before, st AS state_after, NULL AS profile
FROM fold WHERE (st = 'FAULT' AND state_before <> 'FAULT') OR (state_before = 'FAULT' AND st = 'WAITING')
UNION ALL SELECT line_id, t_ms, seq, 'profile_change', '', NULL, NULL, profile FROM prof WHERE before <> profile"""))
def s20(spark, d):
    return inspected(spark, d).where("kind <> 'window'").select(
        "line_id", "t_ms", "seq", F.col("kind").alias("event_type"), "fault_reason", "state_before", "state_after", "profile")
