"""Scalar geometry, gates and region projections over the piece table."""

from pyspark.sql import functions as F

from linewatch.functions import geometry as g
from linewatch.functions.recipe import recipe
from linewatch.operators import gates
from linewatch.queries import query
from linewatch.queries.sql import label, with_views
from linewatch.sources import tables as t



def W():
    return F.col("width_px")


def H():
    return F.col("height_px")


def AREA():
    return F.col("area_px")


def ROI_AREA():
    return F.lit(1432 * 2200)


KEY = ["line_id", "frame_id", "cx", "cy"]
D = "CAST({} AS DOUBLE)".format


def pieces_sql(select: str, where: str = "TRUE") -> str:
    return with_views("detections", body=f"SELECT line_id, frame_id, cx, cy, {select} FROM detections WHERE {where}")


# Some pieces lose one or both sizes, so every branch is used.
_HOLED = {"w": "CASE WHEN width_px % 5 = 0 THEN 0 ELSE width_px END",
          "h": "CASE WHEN height_px % 3 = 0 THEN 0 ELSE height_px END"}


def holed(df):
    return df.select(*KEY, F.when(W() % 5 == 0, 0).otherwise(W()).alias("w"),
                     F.when(H() % 3 == 0, 0).otherwise(H()).alias("h"))


@query("p1_piece_diameter", with_views("detections", ctes={
    "x": f"SELECT line_id, frame_id, cx, cy, {_HOLED['w']} AS w, {_HOLED['h']} AS h FROM detections"}, body="""
SELECT *, CASE WHEN w > 0 AND h > 0 THEN (w+h)/2.0::DOUBLE WHEN w > 0 OR h > 0 THEN GREATEST(w,h)::DOUBLE END AS diameter_px FROM x"""))
def p1(spark, d):
    return holed(t.pieces(spark, d)).withColumn("diameter_px", g.piece_diameter(F.col("w"), F.col("h")))


@query("p2_leading_edge", with_views("detections", ctes={
    "x": f"SELECT line_id, frame_id, cx, cy, {_HOLED['w']} AS w, {_HOLED['h']} AS h FROM detections"}, body="""
SELECT *, cx - COALESCE(CASE WHEN w > 0 AND h > 0 THEN (w+h)/2.0::DOUBLE WHEN w > 0 OR h > 0 THEN GREATEST(w,h)::DOUBLE END, 0)/2 AS edge FROM x"""))
def p2(spark, d):
    return holed(t.pieces(spark, d)).withColumn("edge", g.leading_edge(F.col("cx"), F.col("w"), F.col("h")))


@query("p3_classify", pieces_sql(f"width_px, height_px, {label()} AS label"))
def p3(spark, d):
    return t.pieces(spark, d).select(*KEY, "width_px", "height_px", g.classify(W(), H(), recipe()).alias("label"))


@query("p4_confidence", pieces_sql("LEAST(1.0::DOUBLE, area_px/60000::DOUBLE) AS confidence"))
def p4(spark, d):
    return t.pieces(spark, d).select(*KEY, g.confidence(AREA(), recipe()).alias("confidence"))


@query("p5_is_fault_label", pieces_sql(f"{label()} IN ('row_fused','unknown') AS is_fault"))
def p5(spark, d):
    return t.pieces(spark, d).select(*KEY, g.is_fault_label(g.classify(W(), H(), recipe())).alias("is_fault"))


_PERIMETER = "CASE WHEN width_px % 7 = 0 THEN 0 ELSE (width_px + height_px)*1.6::DOUBLE END"
_HULL = "CASE WHEN height_px % 3 = 0 THEN 0 ELSE area_px*(1 + (height_px % 50)/100::DOUBLE) END"


@query("p7_circularity", with_views("detections", ctes={"x": f"SELECT *, {_PERIMETER} AS perimeter FROM detections"}, body="""
SELECT line_id, frame_id, cx, cy, ROUND(CASE WHEN perimeter > 0 THEN 4*PI()*area_px/(perimeter*perimeter) ELSE 0 END, 6) AS round_px FROM x"""))
def p7(spark, d):
    perimeter = F.when(W() % 7 == 0, F.lit(0.0)).otherwise((W() + H()) * F.lit(1.6))
    return t.pieces(spark, d).select(*KEY, F.round(g.circularity(AREA(), perimeter), 6).alias("round_px"))


@query("p8_solidity", with_views("detections", ctes={"x": f"SELECT *, {_HULL} AS hull FROM detections"}, body="""
SELECT line_id, frame_id, cx, cy, ROUND(CASE WHEN hull > 0 THEN area_px/hull ELSE 0 END, 6) AS solid FROM x"""))
def p8(spark, d):
    hull = F.when(H() % 3 == 0, F.lit(0.0)).otherwise(AREA() * (F.lit(1) + (H() % 50) / F.lit(100.0)))
    return t.pieces(spark, d).select(*KEY, F.round(g.solidity(AREA(), hull), 6).alias("solid"))


@query("p9_aspect_ratio", pieces_sql("GREATEST(width_px,height_px)/GREATEST(LEAST(width_px,height_px),1)::DOUBLE AS aspect"))
def p9(spark, d):
    return t.pieces(spark, d).select(*KEY, g.aspect_ratio(W(), H()).alias("aspect"))


MEASURES = "width_px, height_px, area_px, circularity, solidity"
SHAPE = [*KEY, "width_px", "height_px", "area_px", "circularity", "solidity"]


@query("p10_gate_noise", pieces_sql(MEASURES, "area_px >= 0.5*60000"))
def p10(spark, d):
    return gates.gate_noise(t.pieces(spark, d), recipe()).select(*SHAPE)




@query("p11_gate_max_area", pieces_sql(MEASURES, f"area_px <= {1432*2200}*{D(0.05)}"))
def p11(spark, d):
    return gates.gate_max_area(t.pieces(spark, d), ROI_AREA(), 0.05).select(*SHAPE)


ASPECT = "GREATEST(width_px,height_px)/GREATEST(LEAST(width_px,height_px),1)::DOUBLE"


@query("p12_gate_belt", pieces_sql(MEASURES, f"{ASPECT} <= 2.0 AND solidity >= {D(0.8)}"))
def p12(spark, d):
    return gates.gate_belt(t.pieces(spark, d), recipe(belt_max_aspect_ratio=2.0)).select(*SHAPE)


LEARNED = {"ref_circularity_min": 0.9, "ref_solidity_min": 0.9}


@query("p13_gate_shape", pieces_sql(MEASURES, f"""solidity >= {D(0.9)}*{D(0.85)}
  AND ((area_px >= 90000 AND {ASPECT} <= 3.0) OR circularity >= {D(0.9)}*{D(0.7)})"""))
def p13(spark, d):
    return gates.gate_shape(t.pieces(spark, d), recipe(**LEARNED)).select(*SHAPE)


@query("p13_gate_shape_relaxed", pieces_sql(MEASURES, f"""solidity >= {D(0.35)}
  AND ((area_px >= 90000 AND {ASPECT} <= 3.0) OR circularity >= {D(0.9)}*{D(0.7)})"""))
def p13_relaxed(spark, d):
    return gates.gate_shape(t.pieces(spark, d), recipe(**LEARNED), relax_solidity=True).select(*SHAPE)


@query("p14_gate_external", pieces_sql(MEASURES, f"""area_px >= 30000 AND area_px <= {1432*2200}*{D(0.15)}
  AND ((area_px >= 90000 AND {ASPECT} <= 3.0) OR circularity >= {D(0.7)})"""))
def p14(spark, d):
    return gates.gate_external(t.pieces(spark, d), recipe(), ROI_AREA(), 0.7).select(*SHAPE)


_SIZED = f"""(circularity <= 0 OR circularity >= {D(0.75)})
  AND (width_px+height_px)/2.0::DOUBLE BETWEEN {{ref}}*{D(1 - 0.35)} AND {{ref}}*{D(1.35)}"""


@query("p15_filter_candidates", pieces_sql(MEASURES, _SIZED.format(ref="290")))
def p15(spark, d):
    return gates.filter_candidates(t.pieces(spark, d), recipe(), use_frame_median=False).select(*SHAPE)


@query("p15_filter_by_frame_median", with_views("detections", ctes={
    "m": "SELECT line_id, frame_id, MEDIAN((width_px+height_px)/2.0::DOUBLE) AS ref FROM detections GROUP BY ALL"}, body=f"""
SELECT line_id, frame_id, cx, cy, {MEASURES} FROM detections JOIN m USING (line_id, frame_id)
WHERE {_SIZED.format(ref='ref')}"""))
def p15_median(spark, d):
    return gates.filter_candidates(t.pieces(spark, d), recipe(expected_width_px=1)).select(*SHAPE)


@query("p16_split_roi", with_views("detections", ctes={"x": """
SELECT *, cx*2 AS fx, CASE WHEN line_id = 3 THEN 5000 ELSE 1768 END AS want,
  GREATEST(1, LEAST(CASE WHEN line_id = 3 THEN 5000 ELSE 1768 END, 3199)) AS split_x FROM detections"""}, body="""
SELECT line_id, frame_id, cy, split_x, split_x <> want AS clamped,
  CASE WHEN fx < split_x THEN 'belt' ELSE 'feed' END AS roi,
  CASE WHEN fx < split_x THEN fx ELSE fx - split_x END AS cx FROM x"""))
def p16(spark, d):
    split = F.when(F.col("line_id") == 3, 5000).otherwise(1768)
    full = t.pieces(spark, d).withColumn("cx", F.col("cx") * 2)
    return (gates.split_roi(full, recipe(roi_split_x=split), F.lit(3200))
            .select("line_id", "frame_id", "cx", "cy", "split_x", "clamped", "roi"))


CROP = {"top": 100, "bottom": 200, "left": 50, "right": 0}
def RECT():
    return gates.crop_rect(F.lit(1432), F.lit(2200), *[F.lit(CROP[s]) for s in ("top", "bottom", "left", "right")])


@query("p17_apply_crop", with_views("detections", body="""
SELECT line_id, frame_id, cx - 50 AS cx, cy - 100 AS cy, 50 AS crop_x1, 100 AS crop_y1, 1432 AS crop_x2, 2000 AS crop_y2
FROM detections WHERE cx >= 50 AND cx < 1432 AND cy >= 100 AND cy < 2000"""))
def p17(spark, d):
    return gates.apply_crop(t.pieces(spark, d), RECT()).select(*KEY, "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query("p17_crop_rect", with_views("recipes", ctes={"b": """SELECT name, CAST(GREATEST(0, LEAST(crop_left*90, 1431)) AS INT) AS crop_x1,
                  CAST(GREATEST(0, LEAST(crop_top*90, 2199)) AS INT) AS crop_y1, crop_left*40 AS r, crop_top*40 AS bt FROM recipes"""}, body="""
SELECT name, crop_x1, crop_y1,
  CAST(CASE WHEN r > 0 THEN LEAST(1432, GREATEST(crop_x1+1, 1432-r)) ELSE 1432 END AS INT) AS crop_x2,
  CAST(CASE WHEN bt > 0 THEN LEAST(2200, GREATEST(crop_y1+1, 2200-bt)) ELSE 2200 END AS INT) AS crop_y2 FROM b"""))
def p17_rect(spark, d):
    left, top = F.col("belt_crop.left"), F.col("belt_crop.top")
    rect = gates.crop_rect(F.lit(1432), F.lit(2200), top * 90, top * 40, left * 90, left * 40)
    return t.recipes(spark, d).select("name", *[c.cast("int").alias(n) for n, c in rect.items()])


_BOX = "CAST(FLOOR(cx - width_px/2.0::DOUBLE) AS INT) AS bbox_x, CAST(FLOOR(cy - height_px/2.0::DOUBLE) AS INT) AS bbox_y"


@query("p18_offset_to_roi", with_views("detections", ctes={"x": f"SELECT *, {_BOX} FROM detections"}, body="""
SELECT line_id, frame_id, cx + 50 AS cx, cy + 100 AS cy, bbox_x + 50 AS bbox_x, bbox_y + 100 AS bbox_y, circularity, solidity FROM x"""))
def p18(spark, d):
    moved = gates.offset_to_roi(gates.with_bbox(t.pieces(spark, d)), F.lit(50), F.lit(100))
    return moved.select(*KEY, "bbox_x", "bbox_y", "circularity", "solidity")


_UP = "(1.0::DOUBLE/(800::DOUBLE/1432))"


@query("p19_rescale", with_views("detections", ctes={"x": f"SELECT *, {_BOX} FROM detections"}, body=f"""
SELECT line_id, frame_id, cx*{_UP} AS cx, cy*{_UP} AS cy, CAST(TRUNC(bbox_x*{_UP}) AS INT) AS bbox_x,
  CAST(TRUNC(bbox_y*{_UP}) AS INT) AS bbox_y, CAST(TRUNC(width_px*{_UP}) AS INT) AS width_px,
  CAST(TRUNC(height_px*{_UP}) AS INT) AS height_px, CAST(TRUNC(area_px*{_UP}*{_UP}) AS BIGINT) AS area_px FROM x"""))
def p19(spark, d):
    scale = gates.detect_scale(F.lit(1432))
    full = gates.rescale(gates.with_bbox(t.pieces(spark, d)), scale)
    return full.select(*KEY, "bbox_x", "bbox_y", "width_px", "height_px", "area_px")


@query("p20_orient", with_views("detections", ctes={"r": """
SELECT *, CAST(frame_id//4 % 4 AS INT)*90 AS rotation, width_px % 2 = 0 AS mirror FROM detections""", "x": """
SELECT *, CASE rotation WHEN 90 THEN 2200-1-cy WHEN 180 THEN 1432-1-cx WHEN 270 THEN cy ELSE cx END AS tx,
  CASE rotation WHEN 90 THEN cx WHEN 180 THEN 2200-1-cy WHEN 270 THEN 1432-1-cx ELSE cy END AS ty,
  CASE WHEN rotation IN (90,270) THEN 2200 ELSE 1432 END AS w FROM r"""}, body="""
SELECT line_id, frame_id, rotation, mirror, CASE WHEN mirror THEN w-1-tx ELSE tx END AS x, ty AS y FROM x"""))
def p20(spark, d):
    turn = (F.expr("frame_id div 4") % 4).cast("int") * 90
    mirror = W() % 2 == 0
    x, y = gates.orient(F.col("cx"), F.col("cy"), F.lit(1432), F.lit(2200), turn, mirror)
    return t.pieces(spark, d).select("line_id", "frame_id", turn.alias("rotation"), mirror.alias("mirror"),
                                     x.alias("x"), y.alias("y"))


@query("p21_area_mm2", pieces_sql("area_px/100.0::DOUBLE AS area_mm2"))
def p21(spark, d):
    return t.pieces(spark, d).select(*KEY, g.area_mm2(AREA(), F.lit(10.0)).alias("area_mm2"))


@query("p23_detection_zone", pieces_sql("width_px", "cx >= 487 AND cx < 1077"))
def p23(spark, d):
    return gates.detection_zone(t.pieces(spark, d), recipe(), 300).select(*KEY, "width_px")


@query("p24_band_filter", with_views("detections", "edges0", ctes={
    "m": "SELECT line_id, frame_id, GREATEST(40, MEDIAN(diam)) AS band_px FROM edges0 GROUP BY ALL"}, body="""
SELECT line_id, frame_id, cx, cy, edge, band_px FROM edges0 JOIN m USING (line_id, frame_id)
WHERE edge BETWEEN 632 - band_px/2 AND 632 + band_px/2"""))
def p24(spark, d):
    p = recipe()
    return gates.band_filter(t.pieces(spark, d), p, g.local_line(p).cast("double")).select(*KEY, "edge", "band_px")


@query("p25_boundary_split", with_views("detections", "edges0", body="""
SELECT line_id, frame_id, cx, cy, CASE WHEN line_id = 0 THEN TRUE ELSE edge > 600 END AS eligible FROM edges0"""))
def p25(spark, d):
    boundary = F.when(F.col("line_id") != 0, F.lit(600.0))
    return gates.boundary_split(t.pieces(spark, d), boundary).select(*KEY, "eligible")


@query("p28_adaptive_block", with_views("recipes", body="""
SELECT name, CAST(CASE WHEN expected_width_px > 20 THEN
  CASE WHEN GREATEST(51, 2*expected_width_px) % 2 = 0 THEN GREATEST(51, 2*expected_width_px)+1
       ELSE GREATEST(51, 2*expected_width_px) END ELSE 0 END AS INT) AS block FROM recipes"""))
def p28(spark, d):
    p = recipe(expected_width_px=F.col("expected_width_px"))
    return t.recipes(spark, d).select("name", g.adaptive_block(p).alias("block"))


@query("p29_sample_every", with_views("frames", body="SELECT line_id, frame_id, t_ms FROM frames WHERE frame_id % 3 = 0"))
def p29(spark, d):
    return gates.sample_every(t.frames(spark, d), 3).select("line_id", "frame_id", "t_ms")


@query("p30_overshoot", with_views("detections", "edges0", body="""
SELECT line_id, frame_id, cx, cy, 632 - edge AS overshoot_px, 632 - edge > 40 AS high, 632 - edge > 60 AS far_past FROM edges0"""))
def p30(spark, d):
    p = recipe()
    over = g.overshoot(g.local_line(p), g.leading_edge(F.col("cx"), W(), H()))
    return t.pieces(spark, d).select(*KEY, over.alias("overshoot_px"), (over > 40).alias("high"),
                                     (over > 60).alias("far_past"))
