"""Event log files, image folders, traces, recipe files."""

import pytest
from pyspark.sql import functions as F

from linewatch.functions import extend
from linewatch.operators import events as ev
from linewatch.operators import profiles as pr
from linewatch.sources import event_log as files
from linewatch.sources import images as im
from linewatch.sources import profile_files, shared, traces

EVENT = ["timestamp_iso", "event_type", "profile_name", "fault_reason", "image_filename", "state_before", "state_after", "extra_json"]


def events(spark, rows):
    full = [dict.fromkeys(EVENT, "") | dict(zip(("timestamp_iso", "event_type", "extra_json"), r)) for r in rows]
    return spark.createDataFrame([[r[c] for c in EVENT] for r in full], ", ".join(f"{c} string" for c in EVENT))


def test_log_round_trip_with_quoted_json(spark, folder):
    body = '{"reason":"clean, \\"quoted\\"","n":1}'
    files.write(events(spark, [("2024-05-01T10:00:00.250", "startup", body), ("2024-05-02T00:00:00.000", "fault_raised", ""),
                               ("2024-05-02T00:00:01.000", "nonsense", ""), ("not a time", "startup", "")]), f"{folder}/log")
    got = {r["timestamp_iso"]: r for r in files.read(spark, f"{folder}/log").collect()}
    assert got["2024-05-01T10:00:00.250"]["extra_json"] == body
    assert str(got["2024-05-01T10:00:00.250"]["event_date"]) == "2024-05-01"
    assert got["2024-05-02T00:00:00.000"]["fault_reason"] == ""
    assert {k for k, r in got.items() if r["quarantined"]} == {"2024-05-02T00:00:01.000", "not a time"}


def test_retention_drops_old_days(spark, folder):
    path = f"{folder}/log"
    files.write(events(spark, [("2024-01-01T10:00:00.000", "startup", ""), ("2024-01-01T11:00:00.000", "shutdown", ""),
                               ("2024-04-01T10:00:00.000", "startup", "")]), path)
    assert files.apply_retention(spark, path, 30, "2024-04-10") == 2
    assert files.read(spark, path).count() == 1
    assert files.apply_retention(spark, path, 30, "2024-04-10") == 0
    with pytest.raises(ValueError):
        files.apply_retention(spark, path, 0, "2024-04-10")
    with pytest.raises(ValueError):
        ev.retain(spark.range(1), 0, F.current_date())


def test_day_filter_prunes_folders(spark, folder):
    files.write(events(spark, [(f"2024-01-0{i}T10:00:00.000", "startup", "") for i in range(1, 6)]), f"{folder}/log")
    day = files.read(spark, f"{folder}/log").where(F.col("event_date") == "2024-01-03")
    assert len(day.inputFiles()) == 5 and "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().toString()
    assert day.count() == 1


def test_frames_are_listed_in_path_order(spark, tmp_path):
    for name in ("b/frame_2.png", "b/frame_1.png", "a/x.JPG", "a/notes.txt", "a/y.tiff"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\x00\x01")
    got = im.scan_frames(spark, str(tmp_path))
    assert sorted((r["path"].split("/")[-1], r["frame_index"]) for r in got.collect()) == [
        ("frame_1.png", 0), ("frame_2.png", 1), ("x.JPG", 0), ("y.tiff", 1)]
    assert "content" not in got.columns
    assert im.scan_frames(spark, str(tmp_path), "frame_*.png", content=True).first()["content"] == b"\x00\x01"


def test_defect_images_newest_first(spark, tmp_path):
    for name in ("2024-05-01-10-00-00-000001-FAULT_UNKNOWN.jpg", "2024-05-01-10-00-00-000002-FAULT_ROW_FUSED.jpg", "other.jpg"):
        (tmp_path / name).write_bytes(b"x")
    got = im.scan_defect_images(spark, str(tmp_path)).collect()
    assert [(r["verdict"], r["taken"].microsecond) for r in got] == [("FAULT_ROW_FUSED", 2), ("FAULT_UNKNOWN", 1)]


def test_raw_planes(spark):
    data = [(1, 7, bytearray([10, 20, 30, 40, 50, 60]), 2, 1, 3), (1, 8, bytearray([5, 250]), 2, 1, 1)]
    df = spark.createDataFrame(data, "line_id long, frame_id long, content binary, width int, height int, channels int")
    got = sorted(tuple(r) for r in im.bytes_to_pixels(df).collect())
    assert got == [(1, 7, 0, 0, 22), (1, 7, 1, 0, 52), (1, 8, 0, 0, 5), (1, 8, 1, 0, 250)]


def test_trace_lines(spark):
    lines = ["2024-05-01 10:00:00.123 | INFO     | a:b:1 - INTER-ROW-STOP-GAP: row_prev=1 row_curr=2 gap_ms=430",
             "2024-05-01 10:00:01.000 | INFO     | a:b:1 - CYCLE-SUMMARY rows_fired=[1, 2] fire_tangents=[600, 598] boundaries=[] "
             "clearing_durations_ms=[0] armed_reasons=['timeout'] total_cycle_ms=900",
             "2024-05-01 10:00:02.000 | INFO     | a:b:1 - CLUSTER-TRACK: id=3 front=512 lost",
             "2024-05-01 10:00:03.000 | WARNING  | a:b:1 - SLOW FRAME: total=61ms detect=40ms rowgroup=2ms display=9ms - note",
             "2024-05-01 10:00:04.000 | WARNING  | a:b:1 - FRAME-GAP dt=180ms during active tracking", "garbage"]
    parsed = traces.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert traces.typed(parsed, "INTER-ROW-STOP-GAP").first()[1:] == (1, 2, 430)
    assert traces.typed(parsed, "CYCLE-SUMMARY").first()["fire_tangents"] == "[600, 598]"
    assert traces.typed(parsed, "CLUSTER-TRACK").first()[1:] == (3, 512, "lost")
    assert traces.typed(parsed, "SLOW FRAME").first()[1:] == (61, 40, 2, 9)
    assert traces.typed(parsed, "FRAME-GAP").first()["dt"] == 180
    assert parsed.count() == 5


def test_recipe_files_fill_defaults_and_are_checked(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"name":"A","fused_threshold":1.0}\n{"name":"A","belt_crop":{"top":-1,"bottom":0,"left":0,"right":0}}\n'
                                     '{"name":"x/y","noise_threshold":1.5}\n')
    df = profile_files.read(spark, str(tmp_path))
    assert df.where("name = 'x/y'").first()["tripwire_half_width_px"] == 15
    assert sorted(tuple(r) for r in profile_files.check(df).collect()) == [
        ("A", "belt_crop.top"), ("A", "fused_threshold"), ("A", "name.duplicate"), ("x/y", "name.slash"), ("x/y", "noise_threshold")]
    empty = profile_files.check(df.where("false")).collect()
    assert [tuple(r) for r in empty] == [("", "profiles.empty")]


def test_profile_edits(spark):
    base = spark.createDataFrame([("A", 1), ("B", 2)], "name string, v int")
    assert sorted(map(tuple, pr.upsert(base, spark.createDataFrame([("B", 3), ("C", 4)], "name string, v int")).collect())) == [
        ("A", 1), ("B", 3), ("C", 4)]
    several = spark.createDataFrame([("B", 9, 1), ("B", 5, 2), ("C", 4, 1)], "name string, v int, at int")
    assert sorted(map(tuple, pr.upsert(base, several, "at").collect())) == [("A", 1), ("B", 5), ("C", 4)]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r["name"] for r in pr.remove(base, names("A")).collect()] == ["B"]
    with pytest.raises(Exception, match="unknown profile"):
        pr.remove(base, names("Z")).collect()
    moves = spark.createDataFrame([("A", "B"), ("B", "N"), ("Z", "Q"), ("A", "N")], "old_name string, new_name string")
    assert sorted(r["name"] for r in pr.rename(base, moves).collect()) == ["B", "N"]


def test_one_override_keeps_all_other_settings(spark):
    base = spark.createDataFrame([("app", "mode", "demo"), ("app", "days", "90")], "name string, key string, value string")
    local = spark.createDataFrame([("app", "mode", "production"), ("plc", "poll", "100")], "name string, key string, value string")
    got = sorted(tuple(r) for r in pr.overlay_config(base, local).collect())
    assert got == [("app", "days", "90", False), ("app", "mode", "production", True), ("plc", "poll", "100", True)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_unknown_detector():
    with pytest.raises(KeyError):
        extend.detector("nope")
