"""A stream over several files gives what the batch twin gives."""

import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linewatch.operators import automata as am
from linewatch.operators import signals as sg
from linewatch.queries.stateful import cycled, line_events
from linewatch.sources import tables as t
from linewatch.streaming import keyed, streams
from linewatch.streaming import machines as mc
from linewatch.streaming.keyed import on_stream

from .conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Every batch starts a worker per partition; the tables are small."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def as_stream(spark, tmp_path):
    def make(df, parts=4):
        """Rows split by time into files that arrive one per batch, oldest first."""
        lo, hi = df.agg(F.min("t_ms"), F.max("t_ms")).first()
        source = f"{tmp_path}/source"
        for i in range(parts):
            a, b = lo + (hi + 1 - lo) * i // parts, lo + (hi + 1 - lo) * (i + 1) // parts
            df.where((F.col("t_ms") >= a) & (F.col("t_ms") < b)).coalesce(1).write.mode("append").parquet(source)
        return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
                .withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", "1 second"))
    return make


@pytest.fixture()
def collected(spark, tmp_path):
    def run(df):
        out = f"{tmp_path}/out"
        streams.run_to_table(df, out, f"{tmp_path}/checkpoint")
        return spark.read.schema(df.schema).parquet(out)
    return run


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_line_state(spark, as_stream, collected):
    events = line_events(spark, SF)
    got = collected(on_stream(as_stream(events), mc.LineState(3), order=["t_ms", "seq"]))
    want = am.line_state(events, 3)
    assert sorted(got.columns) == sorted(want.columns)
    assert list(map(str, rows(got, *want.columns))) == list(map(str, rows(want, *want.columns)))


def test_fault_latch(spark, as_stream, collected):
    signals = t.signals(spark, SF)
    got = collected(on_stream(as_stream(signals), mc.FaultLatch(2, 3), order=["t_ms", "seq"]))
    want = sg.latch(signals, F.col("fault"), 2, 3)
    assert rows(got, *sg.KEY) == rows(want, *sg.KEY) != []


def test_row_phase(spark, as_stream, collected):
    signals = t.signals(spark, SF).withColumn("occupied", F.col("occupancy") >= 0.02)
    got = collected(on_stream(as_stream(signals), mc.RowPhase(), order=["t_ms", "seq"]))
    want = am.row_phase(signals, F.col("occupied"))
    columns = ["line_id", "seq", "phase_before", "phase_after", "command"]
    assert list(map(str, rows(got, *columns))) == list(map(str, rows(want, *columns)))


def test_transfer_timeout(spark, as_stream, collected):
    signals = t.signals(spark, SF)
    stream = as_stream(signals).withColumn("transferring", F.col("running"))
    got = collected(on_stream(stream, mc.TransferTimeout(86_400_000), order=["t_ms", "seq"]))
    want = sg.transfer_timeouts(signals, F.col("running"), 86_400_000)
    columns = [*sg.KEY, "since_ms", "lasted_ms"]
    assert rows(got, *columns) == rows(want, *columns) != []


def test_stop_latch_timer_and_acknowledge(spark, as_stream, collected):
    data = [(1, 0, 0, True, False), (1, 1000, 1, True, True), (1, 4000, 2, False, False),
            (1, 20_000, 3, True, True), (1, 25_000, 4, True, False), (2, 60_000, 5, True, False), (1, 90_000, 6, True, False),
            (2, 200_000, 7, True, False)]
    df = spark.createDataFrame(data, "line_id long, t_ms long, seq long, running boolean, stop boolean")
    got = collected(on_stream(as_stream(df), mc.StopLatch(10_000), order=["t_ms", "seq"]))
    assert rows(got, "line_id", "seq", "released_ms", "reason") == [(1, 1, 4000, "plc_ack"), (1, 3, 30_000, "timeout")]


EVENT = "line_id long, t_ms long, seq long, event string, reason string"


def test_stragglers_are_counted(spark, tmp_path, collected):
    source = f"{tmp_path}/source"
    for part in ([(1, 10, 0, "running_rises", ""), (1, 20, 1, "inspection_start", "")], [(1, 15, 2, "belt_fault", ""), (1, 30, 3, "verdict_ok", "")]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    got = collected(on_stream(stream, mc.LineState(), order=["t_ms", "seq"], ledger=True)).orderBy("seq").collect()
    assert [(r["seq"], r["state_after"], r["outcome"]) for r in got] == [
        (0, "TRACKING", "handled"), (1, "INSPECTING", "handled"), (2, None, "late"), (3, "WAITING", "handled")]


def sourced(spark, tmp_path, parts, schema=EVENT, late="1 second"):
    """Parts as files that come one a batch, then the row that closes the source."""
    source = f"{tmp_path}/source"
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, schema)
        streams.arrivals(df, f"{source}/{i:04d}", 1, closed=i == len(parts) - 1, files=1)
    return streams.opened(spark, df.schema, source, late, maxFilesPerTrigger=1)


def test_held_rows_take_their_place(spark, tmp_path, collected):
    parts = [[(1, 1000, 0, "running_rises", ""), (1, 3000, 3, "verdict_ok", "")],
             [(1, 2500, 1, "inspection_start", ""), (1, 2500, 2, "clean_frame", ""), (1, 4000, 4, "running_rises", "")],
             [(1, 20_000, 5, "belt_fault", "x")], [(1, 60_000, 6, "ack", "")]]
    got = collected(on_stream(sourced(spark, tmp_path, parts), mc.LineState(), order=["t_ms", "seq"], hold=True, slot_ms=500))
    want = am.line_state(spark.createDataFrame(sum(parts, []), EVENT))
    columns = ["seq", "state_before", "state_after", "fault_count", "fault_reason"]
    assert rows(got, *columns) == rows(want, *columns)


def test_every_row_in_has_an_outcome(spark, tmp_path, collected):
    """Shuffled, repeated and late deliveries: handled + duplicates + late = rows in."""
    parts = [[(1, 5000, 2, "inspection_start", ""), (1, 1000, 0, "running_rises", ""), (1, 1000, 0, "running_rises", "")],
             [(1, 4500, 1, "clean_frame", ""), (1, 9000, 3, "verdict_ok", "")],
             [(1, 2000, 9, "emergency", ""), (1, 9500, 4, "running_falls", ""), (1, 9000, 3, "verdict_ok", "")],
             [(2, 1500, 8, "emergency", ""), (1, 30_000, 5, "running_rises", "")]]
    got = collected(on_stream(sourced(spark, tmp_path, parts), mc.LineState(), order=["t_ms", "seq"], hold=True, slot_ms=1000, ledger=True))
    outcome = sorted((r["seq"], r["outcome"]) for r in got.collect())
    assert outcome == [(0, "duplicate"), (0, "handled"), (1, "handled"), (2, "handled"), (3, "duplicate"), (3, "handled"),
                       (4, "handled"), (5, "handled"), (8, "late"), (9, "late")]
    kept = spark.createDataFrame([(1, 1000, 0, "running_rises", ""), (1, 4500, 1, "clean_frame", ""), (1, 5000, 2, "inspection_start", ""),
                                  (1, 9000, 3, "verdict_ok", ""), (1, 9500, 4, "running_falls", ""), (1, 30_000, 5, "running_rises", "")], EVENT)
    assert rows(got.where("outcome = 'handled'"), "seq", "state_after") == rows(am.line_state(kept), "seq", "state_after")


def test_waiting_rows_cost_their_own_batch_only(spark, tmp_path):
    """100,000 rows wait; later batches of a few rows write a few entries each."""
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("line_id"), (F.col("id") * 10).alias("t_ms"), F.col("id").alias("seq"),
                                       F.lit("clean_frame").alias("event"), F.lit("").alias("reason"))
    source = f"{tmp_path}/source"
    streams.arrivals(many, f"{source}/0", 1, closed=False, files=1)
    for i in range(3):
        few = spark.range(5).select(F.lit(1).cast("long").alias("line_id"), (F.col("id") * 7 + 500_000 + i).alias("t_ms"), (F.col("id") + 200_000 + 10 * i).alias("seq"),
                                    F.lit("clean_frame").alias("event"), F.lit("").alias("reason"))
        streams.arrivals(few, f"{source}/{i + 1}", 1, closed=i == 2, files=1)
    stream = streams.opened(spark, many.schema, source, "1 day", maxFilesPerTrigger=1)
    progress, out = [], f"{tmp_path}/out"
    held = on_stream(stream, mc.LineState(), order=["t_ms", "seq"], hold=True, slot_ms=10_000)
    streams.run_to_table(held, out, f"{tmp_path}/checkpoint", progress)
    updated = [b["stateOperators"][0]["numRowsUpdated"] for b in progress]
    first = next(i for i, b in enumerate(progress) if b["numInputRows"] == 100_000)
    assert updated[first] >= 100 and all(u <= 12 for u in updated[first + 1:first + 4]), updated
    assert spark.read.parquet(out).count() == 100_015
    # the slots are forgotten when the watermark has passed them
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3


def test_windows_come_out_and_free_their_state(spark, tmp_path):
    signals = t.signals(spark, SF).select("line_id", "t_ms", "seq", "running", "fault")
    source, progress = f"{tmp_path}/source", []
    streams.arrivals(signals, source, 5, files=1)
    stream = streams.opened(spark, signals.schema, source, "1 minute", maxFilesPerTrigger=1)
    streams.run_to_table(streams.sessions(stream, "6 hours"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", progress)
    want = sg.running_sessions(signals, 21_600_000)
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "line_id", "start_ms", "end_ms", "rows") == rows(want, "line_id", "start_ms", "end_ms", "rows")
    kept = [b["stateOperators"][0]["numRowsTotal"] for b in progress]
    assert max(kept) < want.count() and kept[-1] == 0  # never all sessions at once, none at the end
    assert sum(b["stateOperators"][0]["numRowsRemoved"] for b in progress) >= want.count()


def test_upserts_survive_a_repeated_batch(spark, tmp_path):
    signals = t.signals(spark, SF).select("line_id", "t_ms", "seq", "running", "fault").withColumn("dropped", F.col("seq") % 3)
    source, out = f"{tmp_path}/source", f"{tmp_path}/out"
    streams.arrivals(signals, source, 3, by="seq", files=1)
    for attempt in ("a", "b"):  # a lost checkpoint repeats all batches
        stream = streams.opened(spark, signals.schema, source, "60 days", maxFilesPerTrigger=1)
        tally = streams.drops(stream, "1 day")
        streams.upsert_sink(tally, out, f"{tmp_path}/checkpoint-{attempt}").awaitTermination()
    got = streams.upserted(spark, tally.schema, out, ["line_id", "start_ms"])
    day = F.expr("t_ms div 86400000 * 86400000")
    want = signals.groupBy("line_id", day.alias("start_ms")).agg(F.count("*").alias("frames"), F.sum("dropped").alias("dropped"))
    assert rows(got, "line_id", "start_ms", "frames", "dropped") == rows(want, "line_id", "start_ms", "frames", "dropped")
    assert spark.read.parquet(out).count() > want.count()  # windows changed in several batches


def test_no_batch_takes_more_than_admitted(spark, tmp_path):
    signals = t.signals(spark, SF)
    source, taken = f"{tmp_path}/source", f"{tmp_path}/taken"
    streams.arrivals(signals, source, 20, closed=False, files=1)
    sizes = [r["n"] for r in spark.read.parquet(source).groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    stream = streams.opened(spark, signals.schema, source, maxFilesPerTrigger=2)
    streams.admitted(stream, taken, f"{tmp_path}/checkpoint").awaitTermination()
    got = [tuple(r) for r in streams.admissions(spark, taken).orderBy("batch").collect()]
    assert [n for _, n, _ in got] == [a + b for a, b in zip(sizes[::2], sizes[1::2])]
    assert got[-1][2] == 0 and sum(n for _, n, _ in got) == signals.count()


def test_self_clear_and_acknowledge(spark, tmp_path, collected):
    signals = t.signals(spark, SF).select("line_id", "t_ms", "seq", "fault", "ack")
    got = collected(on_stream(sourced(spark, tmp_path, [signals.collect()], signals.schema), mc.SelfClear(3), order=["t_ms", "seq"], hold=True, slot_ms=86_400_000))
    assert rows(got, *sg.KEY) == rows(sg.self_clear(signals, F.col("fault"), 3), *sg.KEY) != []


def test_acknowledge_clears_error_and_fault_once(spark, tmp_path, collected):
    data = [(1, 1, 0, False, False), (1, 2, 1, True, False), (1, 3, 2, False, True), (1, 4, 3, True, False), (1, 5, 4, True, True), (1, 6, 5, False, False), (1, 7, 6, True, False)]
    stream = sourced(spark, tmp_path, [data], "line_id long, t_ms long, seq long, ack boolean, fault boolean")
    got = collected(on_stream(stream, mc.AckEdge(), order=["t_ms", "seq"]))
    assert rows(got, "seq", "cleared_error", "cleared_fault") == [(1, False, False), (3, True, True), (6, True, True)]


def test_commands_come_once_over_batches(spark, tmp_path):
    source, schema = f"{tmp_path}/source", "line_id long, seq long, command string, ts timestamp"
    for n in range(2):
        (spark.sql("SELECT 1L AS line_id, 1L AS seq, 'stop' AS command, TIMESTAMP '2024-01-01 00:00:00' AS ts "
                   f"UNION ALL SELECT 2L, {n}L, 'clear', TIMESTAMP '2024-01-01 00:00:01'")
         .coalesce(1).write.mode("append").parquet(source))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "1 minute"))
    streams.command_sink(stream, f"{tmp_path}/commands", f"{tmp_path}/checkpoint", "ts").awaitTermination()
    got = spark.read.schema("line_id long, seq long, command string").parquet(f"{tmp_path}/commands/batch=*")
    assert rows(got, "line_id", "seq", "command") == [(1, 1, "stop"), (2, 0, "clear"), (2, 1, "clear")]


def test_commands_survive_a_repeated_batch(spark, tmp_path):
    out = f"{tmp_path}/commands"
    source = f"{tmp_path}/source"
    data = [(1, 1, "stop"), (1, 1, "stop"), (2, 2, "clear")]
    spark.createDataFrame(data, "line_id long, seq long, command string").write.parquet(source)
    for attempt in ("a", "b"):  # a lost checkpoint repeats the batch
        stream = spark.readStream.schema("line_id long, seq long, command string").parquet(source)
        streams.command_sink(stream, out, f"{tmp_path}/checkpoint-{attempt}").awaitTermination()
    assert rows(spark.read.parquet(out), "line_id", "seq", "command") == [(1, 1, "stop"), (2, 2, "clear")]


def test_failing_listener_does_not_stop_the_others(spark, tmp_path):
    source = f"{tmp_path}/source"
    spark.createDataFrame([(1, 1, "A", "B")], "line_id long, seq long, old string, new string").write.parquet(source)
    seen, changes = [], streams.StateChanges()

    def broken(_):
        raise RuntimeError("listener broke")

    changes.on_change(broken)
    changes.on_change(lambda df: seen.extend(r["new"] for r in df.collect()))
    stream = spark.readStream.schema("line_id long, seq long, old string, new string").parquet(source)
    changes.attach(stream, f"{tmp_path}/checkpoint").awaitTermination()
    assert seen == ["B"] and len(changes.failures) == 1


def test_row_stops(spark, as_stream, collected):
    machine = mc.Stops(grid_rows=3, grid_columns=3, row_gap=60.0)
    edges = am.frame_edges(t.detections(spark, SF), cycled(spark, SF))
    got = collected(on_stream(as_stream(edges), machine, order=["t_ms", "frame_id"]))
    want = am.row_stops(edges, machine)
    columns = [c.split()[0] for c in mc.STOP_SCHEMA.split(", ")]
    assert list(map(str, rows(got, "line_id", *columns))) == list(map(str, rows(want, "line_id", *columns)))
    assert got.where("fired").count() > 0


def test_clusters_by_cycle(spark, as_stream, collected):
    fronts = am.row_fronts(t.detections(spark, SF), cycled(spark, SF), 60.0, 3)
    got = collected(on_stream(as_stream(fronts), mc.Clusters(), ["line_id", "cycle"], ["t_ms", "frame_id"]))
    want = am.track_clusters(fronts)
    columns = ["line_id", "cycle", "frame_id", "row_id", "cluster_id", "outcome"]
    named = lambda df: rows(df.na.fill(-1, ["row_id"]), *columns)  # noqa: E731 - lost rows have no row_id
    assert named(got) == named(want) != []


def test_sticky_result_goes_by_timer(spark, as_stream, collected):
    data = [(1, 500, 0, "OK"), (1, 2000, 1, None), (1, 2500, 2, "FAULT_UNKNOWN"), (2, 60_000, 3, None), (2, 90_000, 4, None),
            (2, 120_000, 5, None)]
    df = spark.createDataFrame(data, "line_id long, t_ms long, seq long, result string")
    got = collected(on_stream(as_stream(df), mc.StickyResult(3000), order=["t_ms", "seq"]))
    assert sorted(map(str, rows(got.where("line_id = 1"), "at_ms"))) == ["(2500,)", "(500,)", "(5500,)"]


def test_row_lines_and_column_stops(spark, tmp_path):
    frames, pieces = cycled(spark, SF), t.detections(spark, SF)
    xs = am.row_xs(pieces, frames).select("line_id", "cycle", "t_ms", "frame_id", "row_xs")
    edges = am.frame_edges(pieces, frames, t.BANDS).select("line_id", "t_ms", "frame_id", "running", "edges", "cols")
    lines, stops = mc.RowLines(632.0), mc.ColumnStops(grid_rows=3, grid_columns=8)
    for name, df, machine, keys, want in (("lines", xs, lines, ["line_id", "cycle"], am.track_row_lines(xs, 632.0)),
                                          ("stops", edges, stops, ["line_id"], am.row_stops(edges, stops))):
        streams.arrivals(df, f"{tmp_path}/{name}", 2)
        stream = streams.opened(spark, df.schema, f"{tmp_path}/{name}", "1 second", maxFilesPerTrigger=8)
        held = on_stream(stream, machine, keys, ["t_ms", "frame_id"], hold=True, slot_ms=600_000)
        streams.run_to_table(held, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-checkpoint")
        got = spark.read.schema(held.schema).parquet(f"{tmp_path}/{name}-out")
        assert list(map(str, rows(got, *want.columns))) == list(map(str, rows(want, *want.columns))) != []


def test_a_part_in_many_files_is_one_batch(spark, tmp_path, collected):
    """No row of a part is late because another file of the part came before it."""
    rows_in = spark.range(4000).select((F.col("id") % 5).alias("line_id"), (F.col("id") * 1000).alias("t_ms"), F.col("id").alias("seq"),
                                       F.lit("clean_frame").alias("event"), F.lit("").alias("reason"))
    source = f"{tmp_path}/source"
    assert streams.arrivals(rows_in.repartition(7), source, 3, files=5) == 5
    written = [len(spark.read.parquet(f"{source}/part={i:06d}").inputFiles()) for i in range(4)]
    assert written == [5, 5, 5, 1]
    stream = streams.opened(spark, rows_in.schema, source, "1 second", maxFilesPerTrigger=5)
    got = collected(on_stream(stream, mc.LineState(), order=["t_ms", "seq"], hold=True, slot_ms=60_000, ledger=True))
    assert got.where("outcome = 'handled'").count() == 4000
    # parts with fewer rows than files are filled up with empty files
    assert streams.arrivals(rows_in.limit(6), f"{tmp_path}/few", 3, files=5, closed=False) == 5
    assert [len(spark.read.parquet(f"{tmp_path}/few/part={i:06d}").inputFiles()) for i in range(3)] == [5, 5, 5]


def test_many_keys_share_timers_and_cells(spark, tmp_path):
    """State entries and timers follow buckets and slots, not the 3,000 keys."""
    many = spark.range(9000).select((F.col("id") % 3000).alias("line_id"), (F.col("id") * 10).alias("t_ms"), F.col("id").alias("seq"),
                                    (F.col("id") % 2 == 0).alias("fault"))
    streams.arrivals(many, f"{tmp_path}/source", 2, files=1)
    stream = streams.opened(spark, many.schema, f"{tmp_path}/source", "1 second", maxFilesPerTrigger=1)
    progress, out = [], f"{tmp_path}/out"
    held = on_stream(stream, mc.SelfClear(1), order=["t_ms", "seq"], hold=True, slot_ms=10_000, buckets=4)
    streams.run_to_table(held, out, f"{tmp_path}/checkpoint", progress)
    assert max(b["stateOperators"][0]["numRowsTotal"] for b in progress) < 500
    assert spark.read.parquet(out).count() == 0  # even lines fault always, odd ones never


def test_state_lies_in_no_more_partitions_than_run_side_by_side(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        with streams.keyed_state(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "500"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_reach_their_bucket_packed_by_slot():
    batch = pa.RecordBatch.from_pydict({"bucket": [1, 1, 2, 1], "key": ["a", "b", "c", "a"], "t_ms": [5, 7, 12, -1],
                                        "xs": [[1.0], None, [], [2.0]]})
    (packed,) = keyed._packer(10)(iter([batch, batch]))
    got = {(r[keyed.BUCKET], r[keyed.SLOT]): pickle.loads(r[keyed.PACKED]) for r in packed.to_pylist()}
    assert got == {(1, 0): [("a", 5, [1.0]), ("b", 7, None)] * 2, (2, 1): [("c", 12, [])] * 2, (1, -1): [("a", -1, [2.0])] * 2}
