"""Merging, comparison of methods, and the frame-level compositions."""

from pyspark.sql import functions as F

from linewatch.functions.recipe import recipe
from linewatch.operators import gates, proximity, rows
from linewatch.operators import profiles as pr
from linewatch.operators import reports as rp
from linewatch.plans import inspect as plans
from linewatch.queries import query
from linewatch.queries.pieces import _BOX, ASPECT, D
from linewatch.queries.recipes import ASKED, ASKED_UNKNOWN, join_recipe, line_recipes, unknown_recipes
from linewatch.queries.rows import COLUMN_CTES, PIECE_VERDICT, POINTERS, V2
from linewatch.queries.sql import label, label_from_profile, with_views
from linewatch.sources import tables as t

REACH = "CAST(1.15 AS DOUBLE)*290"


@query("j4_close_pairs", with_views("detections", body=f"""
SELECT a.line_id, a.frame_id, a.det_id, b.det_id AS other_id,
  SQRT((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy)) AS distance_px
FROM detections a JOIN detections b ON a.line_id = b.line_id AND a.frame_id = b.frame_id AND a.det_id < b.det_id
WHERE SQRT((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy)) < {REACH}"""))
def j4_pairs(spark, d):
    return proximity.close_pairs(t.detections(spark, d), recipe())


def merge_ctes(src: str, reach: str) -> dict[str, str]:
    """Greedy merge as recursion: every step fuses the first close pair of each frame."""
    return {
        "m0": f"""SELECT line_id, frame_id, det_id, det_id AS ord, bbox_x AS x1, bbox_y AS y1, bbox_x + width_px AS x2, bbox_y + height_px AS y2,
            cx, cy, area_px, 1 AS merged_from, {reach} AS reach FROM {src}""",
        "fold": """SELECT 0 AS step, * FROM m0
        UNION ALL
        SELECT step + 1, line_id, frame_id, MIN(det_id), CASE WHEN COUNT(*) = 2 THEN MAX(top) + 1 ELSE MAX(ord) END,
          MIN(x1), MIN(y1), MAX(x2), MAX(y2),
          CASE WHEN COUNT(*) = 2 THEN SUM(cx*area_px)/SUM(area_px) ELSE MAX(cx) END,
          CASE WHEN COUNT(*) = 2 THEN SUM(cy*area_px)/SUM(area_px) ELSE MAX(cy) END,
          CAST(SUM(area_px) AS BIGINT), CAST(SUM(merged_from) AS INT), MAX(reach)
        FROM (SELECT f.*, p.i, p.j, p.top FROM fold f JOIN (
            SELECT a.line_id, a.frame_id, MIN((a.ord, b.ord))[1] AS i, MIN((a.ord, b.ord))[2] AS j,
                   (SELECT MAX(ord) FROM m0) + MAX(a.step) AS top
            FROM fold a JOIN fold b ON a.line_id = b.line_id AND a.frame_id = b.frame_id AND a.ord < b.ord
              AND SQRT((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy)) < a.reach
            GROUP BY a.line_id, a.frame_id) p ON f.line_id = p.line_id AND f.frame_id = p.frame_id)
        GROUP BY step, line_id, frame_id, CASE WHEN ord IN (i, j) THEN -1 ELSE ord END""",
        "merged": """SELECT line_id, frame_id, det_id, ord, x1 AS bbox_x, y1 AS bbox_y, CAST(x2 - x1 AS INT) AS width_px, CAST(y2 - y1 AS INT) AS height_px,
          cx, cy, area_px, merged_from FROM fold
          QUALIFY step = MAX(step) OVER (PARTITION BY line_id, frame_id)"""}


@query("j4_proximity_merge", with_views("detections", recursive=True, ctes={
    "boxed": f"SELECT *, {_BOX} FROM detections", **merge_ctes("boxed", REACH)}, body=f"""
SELECT line_id, frame_id, det_id, bbox_x, bbox_y, width_px, height_px, ROUND(cx, 6) AS cx, ROUND(cy, 6) AS cy, area_px, merged_from, {label()} AS label FROM merged"""))
def j4(spark, d):
    p = recipe()
    out = pr.label_pieces(proximity.proximity_merge(gates.with_bbox(t.detections(spark, d)), p), p)
    return out.select(*t.FRAME, "det_id", "bbox_x", "bbox_y", "width_px", "height_px",
                      F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "area_px", "merged_from", "label")


@query("j13_compare_methods", with_views("detections", ctes={
    "a": f"SELECT * FROM detections WHERE area_px >= 30000 AND solidity >= {D(0.9)}*{D(0.85)}",
    "b": f"SELECT * REPLACE (cx + det_id % 3 * 10 AS cx) FROM detections WHERE area_px >= 30000 AND circularity >= {D(0.6)}",
    "na": "SELECT line_id, frame_id, COUNT(*) AS pieces_a FROM a GROUP BY ALL", "nb": "SELECT line_id, frame_id, COUNT(*) AS pieces_b FROM b GROUP BY ALL",
    "mm": """SELECT a.line_id, a.frame_id, COUNT(DISTINCT a.det_id) AS matched FROM a JOIN b ON a.line_id = b.line_id AND a.frame_id = b.frame_id
      AND SQRT((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy)) <= 15 GROUP BY ALL"""}, body="""
SELECT COALESCE(na.line_id, nb.line_id) AS line_id, COALESCE(na.frame_id, nb.frame_id) AS frame_id, COALESCE(pieces_a, 0) AS pieces_a,
  COALESCE(pieces_b, 0) AS pieces_b, COALESCE(matched, 0) AS matched
FROM na FULL JOIN nb ON na.line_id = nb.line_id AND na.frame_id = nb.frame_id
LEFT JOIN mm ON mm.line_id = COALESCE(na.line_id, nb.line_id) AND mm.frame_id = COALESCE(na.frame_id, nb.frame_id)"""))
def j13(spark, d):
    p = recipe()
    base = gates.gate_noise(t.detections(spark, d), p)
    a = base.where(F.col("solidity") >= F.lit(0.9) * F.lit(0.85))
    b = base.where(F.col("circularity") >= 0.6).withColumn("cx", F.col("cx") + F.col("det_id") % 3 * 10)
    return proximity.compare_methods(a, b, 15.0)


@query("d16_starvation", with_views("detections", "edges0", "bands", ctes=COLUMN_CTES, body="""
SELECT line_id, COUNT(*) FILTER (WHERE tangent <= 632) AS would_fire,
  COUNT(*) FILTER (WHERE tangent <= 632 AND any_column_empty) AS starved_frames,
  CAST(COALESCE(SUM(8 - columns_used) FILTER (WHERE tangent <= 632), 0) AS BIGINT) AS starved_columns FROM w7 GROUP BY line_id"""))
def d16(spark, d):
    fronts = rows.build_front_row(rows.assign_column(t.detections(spark, d), t.BANDS), POINTERS)
    return rp.starvation(fronts.withColumn("columns", F.lit(len(POINTERS)).cast("long")), F.lit(632.0))


BELT_CROP = {"top": 40, "bottom": 60, "left": 20, "right": 0}
LEARNED = {"ref_circularity_min": 0.7, "ref_solidity_min": 0.85}


def inspect_ctes(merge: bool, asked: str = ASKED) -> dict[str, str]:
    ctes = {
        "q": f"SELECT * FROM detections JOIN profiles ON {join_recipe(asked)}",
        "gated": f"""SELECT *, {_BOX} FROM q WHERE cx >= 20 AND cx < 1768 AND cy >= 40 AND cy < 2140
          AND area_px >= noise_threshold*expected_area_px AND area_px <= (1768-20)*(2140-40)*{D(0.15)}
          AND {ASPECT} <= 3.0 AND solidity >= {D(0.8)} AND solidity >= {D(0.85)}*{D(0.85)}
          AND ((area_px >= expected_area_px*fused_threshold AND {ASPECT} <= fused_threshold*2.0) OR circularity >= {D(0.7)}*{D(0.7)})"""}
    src, order = "gated", "det_id"
    if merge:
        ctes |= merge_ctes("gated", "CAST(1.15 AS DOUBLE)*((expected_width_px + expected_height_px)/2.0)")
        ctes["after"] = f"SELECT * FROM merged JOIN profiles ON {join_recipe(asked)}"
        src, order = "after", "ord"
    v2 = V2.format(ew="expected_width_px", eh="expected_height_px", fused="fused_threshold")
    return ctes | {
        "labelled": f"SELECT *, {order} AS o, {label_from_profile()} AS label FROM {src}",
        "newest": """SELECT * FROM labelled QUALIFY cx >= MAX(cx) OVER (PARTITION BY line_id, frame_id) - expected_width_px*CAST(0.7 AS DOUBLE)""",
        "pv": f"SELECT *, {PIECE_VERDICT.format(unknown=v2)} AS v FROM newest",
        "best": """SELECT line_id, frame_id, v AS verdict, n AS row_pieces FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY line_id, frame_id
            ORDER BY CASE WHEN v LIKE 'FAULT%' THEN 0 WHEN v <> 'OK' THEN 1 ELSE 2 END, o) AS r,
            COUNT(*) OVER (PARTITION BY line_id, frame_id) AS n FROM pv) WHERE r = 1"""}


INSPECT_BODY = """SELECT f.line_id, f.frame_id, COALESCE(verdict, 'INFO_INCOMPLETE_ROW') AS verdict, COALESCE(row_pieces, 0) AS row_pieces,
  COALESCE(verdict LIKE 'FAULT%', FALSE) AS is_fault FROM frames f LEFT JOIN best USING (line_id, frame_id)"""


def inspect_with(spark, d, merge: bool, named=line_recipes):
    return plans.inspect(named(t.detections(spark, d)), t.frames(spark, d), t.profiles(spark),
                         crop=BELT_CROP, merge=merge, **LEARNED)


@query("v3_inspect", with_views("detections", "frames", "profiles", recursive=True, ctes=inspect_ctes(True), body=INSPECT_BODY))
def v3(spark, d):
    return inspect_with(spark, d, True)


@query("v3_inspect_unmerged", with_views("detections", "frames", "profiles", ctes=inspect_ctes(False), body=INSPECT_BODY))
def v3_unmerged(spark, d):
    return inspect_with(spark, d, False)


@query("v3_inspect_unknown_recipes", with_views("detections", "frames", "profiles", recursive=True, ctes=inspect_ctes(True, ASKED_UNKNOWN), body=INSPECT_BODY))
def v3_unknown(spark, d):
    return inspect_with(spark, d, True, unknown_recipes)


def track_sql(method_gate: str, asked: str = ASKED) -> str:
    return with_views("detections", "profiles", ctes={"q": f"SELECT * FROM detections JOIN profiles ON {join_recipe(asked)}"}, body=f"""
SELECT line_id, frame_id, det_id, cx, cy, cx - (width_px+height_px)/4.0::DOUBLE AS edge FROM q
WHERE cx >= CAST(TRUNC(632 - expected_width_px/2.0) AS INT) AND cx < CAST(TRUNC(632 + expected_width_px/2.0 + 500) AS INT)
  AND cx >= 10 AND cx < 1432 AND cy >= 30 AND cy < 2200
  AND area_px >= noise_threshold*expected_area_px AND area_px <= (1432-10)*(2200-30)*{D(0.15)} AND {method_gate}
  AND (circularity <= 0 OR circularity >= {D(0.75)})
  AND (width_px+height_px)/2.0::DOUBLE BETWEEN expected_width_px*{D(1 - 0.35)} AND expected_width_px*{D(1.35)}""")


def track_with(spark, d, method, named=line_recipes):
    full = named(t.detections(spark, d)).withColumn("cx", F.col("cx") + 1768)
    out = plans.track(full, t.profiles(spark), method=method, zone=500,
                      crop={"top": 30, "bottom": 0, "left": 10, "right": 0}, **LEARNED)
    return out.select(*t.FRAME, "det_id", "cx", "cy", "edge")


_FUSED = f"(area_px >= expected_area_px*fused_threshold AND {ASPECT} <= fused_threshold*2.0)"


@query("v4_track_blob", track_sql(f"solidity >= {D(0.85)}*{D(0.85)} AND ({_FUSED} OR circularity >= {D(0.7)}*{D(0.7)})"))
def v4_blob(spark, d):
    return track_with(spark, d, "blob")


@query("v4_track_external", track_sql(f"({_FUSED} OR circularity >= {D(0.75)})"))
def v4_external(spark, d):
    return track_with(spark, d, "contour_external")


@query("v4_track_unknown_recipes", track_sql(f"({_FUSED} OR circularity >= {D(0.75)})", ASKED_UNKNOWN))
def v4_unknown(spark, d):
    return track_with(spark, d, "contour_external", unknown_recipes)


@query("v4_track_with_occupancy", with_views("pixels", ctes={
    "occ": """SELECT line_id, frame_id, AVG(CASE WHEN v > 140 THEN 1.0 ELSE 0.0 END) AS occupancy,
      AVG(CASE WHEN v > 140 THEN 1.0 ELSE 0.0 END) >= CAST(0.12 AS DOUBLE) AS occupied FROM pixels WHERE x BETWEEN 1 AND 3 GROUP BY ALL"""}, body=
    "SELECT t.line_id, t.frame_id, det_id, edge, occupancy, occupied FROM (" + track_sql(f"({_FUSED} OR circularity >= {D(0.75)})")
    + ") t LEFT JOIN occ USING (line_id, frame_id)"))
def v4_occupancy(spark, d):
    from linewatch.operators import pixels as px
    occupancy = px.strip_occupancy(px.threshold(t.pixels(spark, d), F.lit(140)), 2, 1)
    full = line_recipes(t.detections(spark, d)).withColumn("cx", F.col("cx") + 1768)
    out = plans.track(full, t.profiles(spark), occupancy, method="contour_external", zone=500,
                      crop={"top": 30, "bottom": 0, "left": 10, "right": 0}, **LEARNED)
    return out.select(*t.FRAME, "det_id", "edge", "occupancy", "occupied")


@query("v4_track_with_profile", with_views("pixels", ctes={
    "prof": """SELECT line_id, frame_id, STRING_AGG(n, ',' ORDER BY x) AS column_profile FROM (
      SELECT line_id, frame_id, x, CAST(COUNT(*) FILTER (WHERE v > 140) AS VARCHAR) AS n FROM pixels GROUP BY line_id, frame_id, x) GROUP BY ALL"""}, body=
    "SELECT t.line_id, t.frame_id, det_id, edge, column_profile FROM (" + track_sql(f"({_FUSED} OR circularity >= {D(0.75)})")
    + ") t LEFT JOIN prof USING (line_id, frame_id)"))
def v4_profile(spark, d):
    from linewatch.operators import pixels as px
    profiles = px.profile_list(px.threshold(t.pixels(spark, d), F.lit(140)))
    full = line_recipes(t.detections(spark, d)).withColumn("cx", F.col("cx") + 1768)
    out = plans.track(full, t.profiles(spark), method="contour_external", zone=500,
                      crop={"top": 30, "bottom": 0, "left": 10, "right": 0}, column_profiles=profiles, **LEARNED)
    return out.select(*t.FRAME, "det_id", "edge", F.array_join("column_profile", ",").alias("column_profile"))
