"""Snapshots of lines that only log or only have signals."""

from linewatch.operators import reports


def test_snapshot_keeps_all_lines(spark):
    log = spark.createDataFrame([(1, 5, 1, "fault_raised", "P1"), (2, 5, 1, "startup", "P2")],
                                "line_id long, t_ms long, seq long, event_type string, profile_name string")
    signals = spark.createDataFrame([(2, 7, 1, True, False, False), (3, 7, 1, False, True, False)],
                                    "line_id long, t_ms long, seq long, running boolean, fault boolean, ack boolean")
    got = {r["line_id"]: (r["faults"], r["events"], r["state"], r["last_ms"]) for r in reports.status_snapshot(log, signals).collect()}
    assert {k: v[:2] + v[3:] for k, v in got.items()} == {1: (1, 1, None), 2: (0, 1, 7), 3: (0, 0, 7)}
    assert got[1][2] == "WAITING" and got[3][2] == "FAULT"


def test_snapshot_takes_the_latest_mode(spark):
    log = spark.createDataFrame([(1, 5, 1, "startup", "P1"), (4, 5, 1, "startup", "P1")],
                                "line_id long, t_ms long, seq long, event_type string, profile_name string")
    signals = spark.createDataFrame([(1, 7, 1, True, False, False, "production"), (1, 9, 1, True, False, False, "calibration"), (2, 7, 1, True, False, False, None)],
                                    "line_id long, t_ms long, seq long, running boolean, fault boolean, ack boolean, mode string")
    got = {r["line_id"]: r["mode"] for r in reports.status_snapshot(log, signals).collect()}
    assert got == {1: "calibration", 2: "production", 4: "production"}
