"""Labels, gates, rows and verdicts on small literal tables."""

import itertools
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from linewatch.functions import extend
from linewatch.functions import geometry as g
from linewatch.functions.recipe import recipe
from linewatch.operators import gates, proximity, rows, verdict
from linewatch.operators import profiles as pr

SMALL = {"expected_width_px": 56, "expected_height_px": 56, "expected_area_px": 2500, "fused_threshold": 1.4, "noise_threshold": 0.3}
DET = ("line_id long, frame_id long, det_id long, cx double, cy double, width_px int, height_px int, area_px long, "
       "circularity double, solidity double")


def pieces(spark, boxes, frame=1):
    data = [(0, f, i, float(x), float(y), w, h, int(w * h * 0.785), 0.9, 0.95)
            for i, (f, x, y, w, h) in enumerate((frame, *b) if len(b) == 4 else b for b in boxes)]
    return spark.createDataFrame(data, DET)


@pytest.mark.parametrize("w,h,label", [
    (56, 56, "single"), (120, 50, "row_fused"), (50, 120, "column_fused"), (120, 120, "unknown"), (200, 50, "unknown"),
    (20, 56, "unknown"), (28, 28, "single"), (27, 56, "unknown"), (79, 56, "row_fused"), (78, 56, "single")])
def test_labels(spark, w, h, label):
    df = spark.range(1).select(g.classify(F.lit(w), F.lit(h), recipe(**SMALL)).alias("label"))
    assert df.first()["label"] == label


def test_sizes_and_edges(spark):
    df = spark.createDataFrame([(10, 20), (0, 8), (6, 0), (0, 0)], "w int, h int")
    got = df.select(g.piece_diameter(F.col("w"), F.col("h")).alias("d"),
                    g.leading_edge(F.lit(100.0), F.col("w"), F.col("h")).alias("e")).collect()
    assert [(r["d"], r["e"]) for r in got] == [(15.0, 92.5), (8.0, 96.0), (6.0, 97.0), (None, 100.0)]


def test_area_needs_positive_scale(spark):
    df = spark.createDataFrame([(60000, 10.0)], "a int, s double").select(g.area_mm2(F.col("a"), F.col("s")).alias("x"))
    assert df.first()["x"] == 600.0
    bad = spark.createDataFrame([(60000, 0.0)], "a int, s double").select(g.area_mm2(F.col("a"), F.col("s")).alias("x"))
    with pytest.raises(Exception, match="must be positive"):
        bad.collect()


def test_noise_gate_drops_speck(spark):
    df = pieces(spark, [(100, 100, 56, 56), (300, 100, 8, 8)])
    assert gates.gate_noise(df, recipe(**SMALL)).count() == 1


@pytest.mark.parametrize("rotation,mirror,at", [
    (0, False, (0, 0)), (90, False, (9, 0)), (180, False, (19, 9)), (270, False, (0, 19)), (180, True, (0, 9)), (90, True, (0, 0))])
def test_orientation_of_corner_marker(spark, rotation, mirror, at):
    x, y = gates.orient(F.lit(0), F.lit(0), F.lit(20), F.lit(10), F.lit(rotation), F.lit(mirror))
    assert tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first()) == at


def test_crop_keeps_a_pixel(spark):
    rect = gates.crop_rect(F.lit(100), F.lit(50), F.lit(80), F.lit(70), F.lit(200), F.lit(5))
    assert tuple(spark.range(1).select(*[c.alias(n) for n, c in rect.items()]).first()) == (99, 49, 100, 50)


@pytest.mark.parametrize("boxes,want", [
    ([(100, 50, 56, 56), (100, 150, 56, 56)], "OK"),
    ([(100, 50, 56, 56), (100, 150, 120, 56)], "FAULT_ROW_FUSED"),
    ([(100, 50, 56, 120), (100, 250, 56, 56)], "INFO_COLUMN_FUSED"),
    ([(100, 50, 56, 120), (100, 250, 120, 56)], "FAULT_ROW_FUSED"),
    ([(100, 50, 20, 56), (100, 250, 56, 120)], "INFO_UNKNOWN_NONFAULT"),
    ([(100, 50, 56, 120), (100, 250, 20, 56)], "INFO_COLUMN_FUSED"),
    ([(10, 50, 120, 56), (200, 250, 56, 56)], "OK"),
    ([(100, 50, 200, 56)], "FAULT_ROW_FUSED"),
    ([], "INFO_INCOMPLETE_ROW")])
def test_frame_verdict(spark, boxes, want):
    p = recipe(**SMALL)
    frames = spark.createDataFrame([(0, 1)], "line_id long, frame_id long")
    df = pr.label_pieces(pieces(spark, boxes), p)
    got = verdict.frame_verdict(rows.newest_row(df, p), p, frames).first()
    assert (got["verdict"], got["is_fault"]) == (want, want.startswith("FAULT"))


def test_unknown_as_fault(spark):
    p = recipe(**SMALL)
    df = pr.label_pieces(pieces(spark, [(100, 50, 20, 56)]), p)
    assert verdict.frame_verdict(df, p, unknown_is_fault=True).first()["verdict"] == "FAULT_UNKNOWN"


def test_gap_equal_to_limit_does_not_split(spark):
    df = pieces(spark, [(100, 10, 50, 50), (200, 20, 50, 50), (301, 30, 50, 50)])
    got = {r["det_id"]: r["row_id"] for r in rows.group_by_gap(df, 100).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_same_edge_stays_together_at_gap_zero(spark):
    df = pieces(spark, [(100, 10, 50, 50), (100, 90, 50, 50), (101, 30, 50, 50)])
    assert [r["row_id"] for r in rows.group_by_gap(df, 0).orderBy("det_id").collect()] == [0, 0, 1]


def test_outlier_at_exactly_the_limit_is_kept(spark):
    xs = [100, 100, 100, 200, 201, 1000]
    df = pieces(spark, [(x, 10 * i, 50, 50) for i, x in enumerate(xs)])
    got = {r["det_id"]: r["rejected"] for r in rows.reject_outliers(rows.group_by_gap(df, 150), 3).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False}


def test_single_oversized_row_is_left_alone(spark):
    df = pieces(spark, [(x, 10, 50, 50) for x in (100, 110, 120, 400)])
    assert not any(r["rejected"] for r in rows.reject_outliers(rows.group_by_gap(df, 500), 3).collect())


def test_leave_one_out_against_brute_force(spark):
    rnd = random.Random(3)
    boxes = [(f, rnd.randint(0, 900), 10 * i, 50, 50) for f in range(20) for i in range(rnd.randint(1, 9))]
    out = rows.reject_outliers(rows.group_by_gap(pieces(spark, boxes), 120), 2, 60).collect()
    groups = {}
    for r in out:
        groups.setdefault((r["frame_id"], r["row_id"]), []).append(r)
    last = {f: max(k[1] for k in groups if k[0] == f) for f, _ in groups}
    for (f, _), members in groups.items():
        for r in members:
            others = [o["edge"] for o in members if o["det_id"] != r["det_id"]]
            assert r["others_median"] == (median(others) if others else None)
            far = bool(others) and abs(r["edge"] - median(others)) > 60
            assert r["rejected"] == (far and len(members) > 2 and last[f] > 0)


def test_column_borders_and_ties(spark):
    bands = [(0.0, 100.0), (200.0, 300.0)]
    ys = [0, 99.9, 100, 150, 149, 151, 200, 299, 300, 900]
    df = spark.createDataFrame([(float(y),) for y in ys], "y double")
    got = [r["c"] for r in df.select(rows.column_index(F.col("y"), bands).alias("c")).collect()]
    assert got == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    assert spark.range(1).select(rows.column_index(F.lit(5.0), []).alias("c")).first()["c"] == -1


def brute_merge(items, reach, p):
    items = list(items)
    while True:
        pair = next(((a, b) for a, b in itertools.combinations(range(len(items)), 2)
                     if ((items[a][0] - items[b][0]) ** 2 + (items[a][1] - items[b][1]) ** 2) ** 0.5 < reach), None)
        if pair is None:
            return items
        (ax, ay, aa), (bx, by, ba) = items[pair[0]], items[pair[1]]
        fused = ((ax * aa + bx * ba) / (aa + ba), (ay * aa + by * ba) / (aa + ba), aa + ba)
        items = [q for k, q in enumerate(items) if k not in pair] + [fused]


def test_merge_and_pairs_against_brute_force(spark):
    rnd = random.Random(11)
    boxes = [(f, rnd.randint(0, 600), rnd.randint(0, 600), 56, rnd.randint(40, 70)) for f in range(25) for _ in range(rnd.randint(0, 9))]
    df, p = gates.with_bbox(pieces(spark, boxes)), recipe(**SMALL)
    reach = 1.15 * 56
    source = {}
    for r in df.orderBy("det_id").collect():
        source.setdefault(r["frame_id"], []).append(r)
    got = {}
    for r in proximity.proximity_merge(df, p).orderBy("seat").collect():
        got.setdefault(r["frame_id"], []).append((r["cx"], r["cy"], r["area_px"]))
    assert got == {f: brute_merge([(r["cx"], r["cy"], r["area_px"]) for r in rs], reach, p) for f, rs in source.items()}
    pairs = sorted((r["det_id"], r["other_id"]) for r in proximity.close_pairs(df, p).collect())
    want = sorted((a["det_id"], b["det_id"]) for rs in source.values() for a, b in itertools.combinations(rs, 2)
                  if ((a["cx"] - b["cx"]) ** 2 + (a["cy"] - b["cy"]) ** 2) ** 0.5 < reach)
    assert pairs == want


def test_merge_keeps_shape_of_untouched_pieces(spark):
    df = gates.with_bbox(pieces(spark, [(100, 100, 56, 56), (140, 100, 56, 56), (500, 100, 56, 56)]))
    out = proximity.proximity_merge(df, recipe(**SMALL)).orderBy("seat").collect()
    assert [(r["merged_from"], r["circularity"]) for r in out] == [(1, 0.9), (2, None)]
    assert (out[1]["width_px"], out[1]["det_id"]) == (96, 0)


def test_calibration(spark):
    boxes = [(100 + 80 * i, 100, 56, 56) for i in range(4)]
    p = recipe(expected_width_px=56, expected_height_px=56, expected_area_px=2500)
    df = pr.label_pieces(pieces(spark, boxes), p)
    got = pr.learn_reference(df, ["line_id"]).first()
    assert (got["samples"], got["expected_width_px"], got["error"]) == (4, 56, None)
    few = pr.learn_reference(df.where("det_id < 1"), ["line_id"]).first()
    assert few["expected_width_px"] is None and "1 of 3" in few["error"]


def test_median_rounds_half_to_even(spark):
    rows_ = [(0, 1, i, 0.0, 0.0, w, 290, 60000, 0.9, 0.9) for i, w in enumerate((290, 291, 290, 291))]
    df = spark.createDataFrame(rows_, DET).withColumn("label", F.lit("single"))
    assert pr.learn_reference(df, ["line_id"]).first()["expected_width_px"] == 290


def test_means_that_end_in_half_round_up_whatever_the_order(spark):
    """Fifteen of 0.42 and one of 0.48: the mean is 0.42375, though doubles add up to less."""
    shapes = [0.42] * 15 + [0.48]
    df = spark.createDataFrame([(1, 1, i, 0.0, 0.0, 290, 290, 60000, c, c, "single") for i, c in enumerate(shapes)], DET + ", label string")
    got = pr.learn_reference(df.coalesce(1), ["line_id"]).first()
    assert (got["ref_circularity_mean"], got["ref_solidity_mean"], got["ref_solidity_min"]) == (0.4238, 0.4238, 0.42)


def test_rule_in_python_gets_many_frames_at_once(spark):
    """One verdict a frame, nulls seen, and no Python call of Spark's for each frame."""
    rows = [(f % 4, f, "odd" if i < f % 3 else None, float(i)) for f in range(300) for i in range(1 + f % 5)]
    df = spark.createDataFrame(rows, "line_id long, frame_id long, label string, size double").repartition(3)

    def rule(pieces):
        frames = pieces.groupby(level=0)
        return [f"{len(p)} {(p['label'] == 'odd').sum()} {p['size'].max()}" for _, p in frames]

    found = extend.verdict_by(df, rule, "label", "size")
    got = {r["frame_id"]: (r["line_id"], r["verdict"], r["is_fault"]) for r in found.collect()}
    assert got == {f: (f % 4, f"{1 + f % 5} {min(f % 3, 1 + f % 5)} {f % 5}.0", False) for f in range(300)}
    assert "InPandas" not in found._jdf.queryExecution().toString()
    one = spark.createDataFrame(rows[:1], df.schema)
    assert extend.verdict_by(one, lambda pieces: ["FAULT_ROW_FUSED"], "label").first()["is_fault"] is True
    with pytest.raises(Exception, match="2 verdicts for 1 frames"):
        extend.verdict_by(one, lambda pieces: ["OK", "OK"], "label").collect()
