"""Row grouping, columns, frame verdict."""

from pyspark.sql import functions as F

from linewatch.functions import geometry as g
from linewatch.functions.recipe import recipe
from linewatch.operators import gates, rows, verdict
from linewatch.queries import query
from linewatch.queries.sql import label, with_views
from linewatch.sources import tables as t

GAP = 60.0
COLUMNS = 8
POINTERS = [0, 1, 0, 1, 0, 1, 0, 1]

_ISLANDS = """
SELECT line_id, frame_id, det_id, edge, gap_px,
       CAST(SUM(CASE WHEN gap_px > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY line_id, frame_id ORDER BY edge, det_id) AS INT) AS row_id{more}
FROM (SELECT *, edge - LAG(edge) OVER (PARTITION BY line_id, frame_id ORDER BY edge, det_id) AS gap_px
      FROM {src})"""
W1_CTE = {"w1": _ISLANDS.format(gap="60", more=", cx", src="edges0")}
MEDIAN_CTE = {"med": "SELECT line_id, frame_id, GREATEST(MEDIAN(diam)*0.6, 0.001) AS lim FROM edges0 GROUP BY ALL"}
_COLUMN_SQL = ("COALESCE((SELECT MIN(b.col) FROM bands b WHERE d.cy >= b.y_min AND d.cy < b.y_max), -1)")


@query("w1_group_by_gap", with_views("detections", "edges0", ctes=W1_CTE, body="""
SELECT line_id, frame_id, det_id, edge, gap_px, row_id FROM w1"""))
def w1(spark, d):
    out = rows.group_by_gap(t.detections(spark, d), GAP)
    return out.select("line_id", "frame_id", "det_id", "edge", "gap_px", "row_id")


@query("w2_group_rows", with_views("detections", "edges0", ctes={
    **MEDIAN_CTE, "src": "SELECT e.*, lim FROM edges0 e JOIN med USING (line_id, frame_id)"},
    body=_ISLANDS.format(gap="lim", more="", src="src")))
def w2(spark, d):
    out = rows.group_rows(t.detections(spark, d))
    return out.select("line_id", "frame_id", "det_id", "edge", "gap_px", "row_id")


W3_CTES = {**MEDIAN_CTE,
           "src": "SELECT e.* REPLACE (cx AS edge), lim FROM edges0 e JOIN med USING (line_id, frame_id)",
           "isl": _ISLANDS.format(gap="lim", more="", src="src"),
           "w3": """SELECT line_id, frame_id, row_id, MEDIAN(edge) AS row_x, COUNT(*) AS pieces
                    FROM isl GROUP BY line_id, frame_id, row_id"""}


@query("w3_group_into_rows", with_views("detections", "edges0", ctes=W3_CTES, body="SELECT * FROM w3"))
def w3(spark, d):
    return rows.group_into_rows(t.detections(spark, d))


W4_CTES = {**W1_CTE, "a": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY line_id, frame_id, row_id ORDER BY edge, det_id) AS k,
       LIST(edge) OVER (PARTITION BY line_id, frame_id, row_id ORDER BY edge, det_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xs,
       MAX(row_id) OVER (PARTITION BY line_id, frame_id) AS last_row
FROM w1""", "w4": """
SELECT line_id, frame_id, det_id, row_id, edge,
       LIST_MEDIAN(LIST_CONCAT(xs[1:k-1], xs[k+1:])) AS others_median,
       COALESCE(LEN(xs) > 3 AND last_row > 0
          AND ABS(edge - LIST_MEDIAN(LIST_CONCAT(xs[1:k-1], xs[k+1:]))) > 100, FALSE) AS rejected
FROM a"""}


@query("w4_reject_outliers", with_views("detections", "edges0", ctes=W4_CTES, body="SELECT * FROM w4"))
def w4(spark, d):
    out = rows.reject_outliers(rows.group_by_gap(t.detections(spark, d), GAP), 3)
    return out.select("line_id", "frame_id", "det_id", "row_id", "edge", "others_median", "rejected")


@query("w5_front_row", with_views("detections", "edges0", body="""
SELECT line_id, frame_id, det_id, edge FROM edges0
QUALIFY ROW_NUMBER() OVER (PARTITION BY line_id, frame_id ORDER BY edge, det_id) <= 4"""))
def w5(spark, d):
    return rows.front_row(t.detections(spark, d), 4).select("line_id", "frame_id", "det_id", "edge")


@query("w6_newest_row", with_views("detections", body="""
SELECT line_id, frame_id, det_id, cx FROM detections
QUALIFY cx >= MAX(cx) OVER (PARTITION BY line_id, frame_id) - 290*CAST(0.7 AS DOUBLE)"""))
def w6(spark, d):
    out = rows.newest_row(t.detections(spark, d), recipe())
    return out.select("line_id", "frame_id", "det_id", "cx")


COLUMN_CTES = {"cols": f"SELECT d.*, {_COLUMN_SQL} AS col FROM edges0 d",
               "ranked": """SELECT *, ROW_NUMBER() OVER (PARTITION BY line_id, frame_id, col
                            ORDER BY edge, det_id) - 1 AS rank FROM cols WHERE col >= 0""",
               "hits": """SELECT *, rank = CASE WHEN col % 2 = 0 THEN 0 ELSE 1 END AS hit FROM ranked""",
               "w7": """SELECT line_id, frame_id, COUNT(*) FILTER (WHERE hit) AS columns_used,
                  COALESCE(STRING_AGG(CAST(col AS VARCHAR), ',' ORDER BY col) FILTER (WHERE hit), '') AS used,
                  MIN(edge) FILTER (WHERE hit) AS tangent,
                  COUNT(*) FILTER (WHERE hit) < 8 AS any_column_empty
                  FROM hits GROUP BY line_id, frame_id"""}


@query("w7_build_front_row", with_views("detections", "edges0", "bands", ctes=COLUMN_CTES, body="SELECT * FROM w7"))
def w7(spark, d):
    return rows.build_front_row(rows.assign_column(t.detections(spark, d), t.BANDS), POINTERS)


@query("w21_match_tolerance", with_views("detections", "edges0", ctes={**W3_CTES, "s": """
SELECT *, row_x - LAG(row_x) OVER (PARTITION BY line_id, frame_id ORDER BY row_x, row_id) AS step FROM w3"""}, body="""
SELECT line_id, frame_id, MEDIAN(step) AS spacing_px, COUNT(*) AS "rows",
       CASE WHEN MEDIAN(step) IS NULL THEN CAST('Infinity' AS DOUBLE)
            ELSE GREATEST(MEDIAN(step)*CAST(0.4 AS DOUBLE), 0.001) END AS tolerance_px
FROM s GROUP BY line_id, frame_id"""))
def w21(spark, d):
    return rows.match_tolerance(rows.group_into_rows(t.detections(spark, d)))


# Bands with one missing, so the nearest-centre rule is used too.
GAPPED = [b for i, b in enumerate(t.BANDS) if i != 3]


@query("j3_assign_column", with_views("detections", "bands", ctes={
    "kept": "SELECT ROW_NUMBER() OVER (ORDER BY col) - 1 AS i, y_min, y_max FROM bands WHERE col <> 3"}, body="""
SELECT d.line_id, d.frame_id, d.det_id, d.cy, CAST(COALESCE(
    MIN(i) FILTER (WHERE cy >= y_min AND cy < y_max),
    ARG_MIN(i, ABS((y_min+y_max)/2 - cy)*1000 + i)) AS INT) AS col
FROM detections d, kept GROUP BY ALL"""))
def j3(spark, d):
    out = rows.assign_column(t.detections(spark, d), GAPPED)
    return out.select("line_id", "frame_id", "det_id", "cy", "col")


@query("d2_median_diameter", with_views("detections", "edges0", "frames", ctes={
    "m": "SELECT line_id, frame_id, MEDIAN(diam) AS diameter_px FROM edges0 GROUP BY ALL"}, body="""
SELECT f.line_id, f.frame_id, COALESCE(diameter_px, 0.0) AS diameter_px
FROM frames f LEFT JOIN m USING (line_id, frame_id)"""))
def d2(spark, d):
    sizes = (t.pieces(spark, d).groupBy(*t.FRAME)
             .agg(F.median(g.piece_diameter(F.col("width_px"), F.col("height_px"))).alias("diameter_px")))
    return (t.frames(spark, d).select(*t.FRAME).join(sizes, t.FRAME, "left")
            .na.fill(0.0, ["diameter_px"]))


@query("d3_row_line", with_views("detections", "edges0", ctes={
    **MEDIAN_CTE, "src": "SELECT e.*, lim FROM edges0 e JOIN med USING (line_id, frame_id)",
    "isl": _ISLANDS.format(gap="lim", more="", src="src")}, body="""
SELECT line_id, frame_id, row_id, MEDIAN(edge) AS row_edge, MIN(edge) AS front_edge, COUNT(*) AS pieces
FROM isl GROUP BY line_id, frame_id, row_id"""))
def d3(spark, d):
    return rows.row_line(rows.group_rows(t.detections(spark, d)))


@query("d20_row_histogram", with_views("detections", "edges0", "bands", ctes=COLUMN_CTES, body=
       "SELECT line_id, frame_id, " + ", ".join(
           f"COUNT(*) FILTER (WHERE col = {i}) AS col_{i}" for i in range(8))
       + " FROM cols GROUP BY line_id, frame_id"))
def d20(spark, d):
    return rows.row_histogram(rows.assign_column(t.pieces(spark, d), t.BANDS), COLUMNS)


@query("o1_front_first", with_views("detections", "edges0", body="""
SELECT line_id, frame_id, det_id, edge,
       ROW_NUMBER() OVER (ORDER BY line_id, frame_id, edge, det_id) -
       MIN(n) OVER (PARTITION BY line_id, frame_id) AS position
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY line_id, frame_id, edge, det_id) AS n FROM edges0)"""))
def o1(spark, d):
    ranked = F.row_number().over(rows.by_frame().orderBy("edge", "det_id")) - 1
    return (t.detections(spark, d).withColumn("edge", rows.edge_of())
            .select(*t.FRAME, "det_id", "edge", ranked.cast("long").alias("position"))
            .orderBy(*t.FRAME, "edge", "det_id"))


# --- verdict ---------------------------------------------------------------

PIECE_VERDICT = """CASE WHEN label = 'row_fused' THEN 'FAULT_ROW_FUSED'
     WHEN label = 'unknown' THEN {unknown}
     WHEN label = 'column_fused' THEN 'INFO_COLUMN_FUSED' ELSE 'OK' END"""
V2 = """CASE WHEN width_px/CAST({ew} AS DOUBLE) >= {fused} AND width_px/CAST({ew} AS DOUBLE) >= height_px/CAST({eh} AS DOUBLE)
     THEN 'FAULT_ROW_FUSED' ELSE 'INFO_UNKNOWN_NONFAULT' END"""
V2_DEFAULT = V2.format(ew=290, eh=290, fused=1.5)


def verdict_ctes(unknown: str) -> dict[str, str]:
    return {
        "labelled": f"SELECT *, {label()} AS label FROM detections WHERE area_px >= 30000",
        "newest": """SELECT * FROM labelled
            QUALIFY cx >= MAX(cx) OVER (PARTITION BY line_id, frame_id) - 290*CAST(0.7 AS DOUBLE)""",
        "pv": f"SELECT *, {PIECE_VERDICT.format(unknown=unknown)} AS v FROM newest",
        "sev": """SELECT *, CASE WHEN v LIKE 'FAULT%' THEN 0 WHEN v <> 'OK' THEN 1 ELSE 2 END AS s FROM pv""",
        "best": """SELECT line_id, frame_id, v AS verdict, n AS row_pieces FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY line_id, frame_id ORDER BY s, det_id) AS r,
                   COUNT(*) OVER (PARTITION BY line_id, frame_id) AS n FROM sev) WHERE r = 1""",
        "fv": """SELECT f.line_id, f.frame_id, COALESCE(verdict, 'INFO_INCOMPLETE_ROW') AS verdict,
            COALESCE(row_pieces, 0) AS row_pieces, COALESCE(verdict LIKE 'FAULT%', FALSE) AS is_fault
            FROM frames f LEFT JOIN best USING (line_id, frame_id)"""}


def labelled_newest(spark, d):
    p = recipe()
    kept = gates.gate_noise(t.detections(spark, d), p)
    kept = kept.withColumn("label", g.classify(F.col("width_px"), F.col("height_px"), p))
    return rows.newest_row(kept, p), p


@query("v1_frame_verdict", with_views("detections", "frames", ctes=verdict_ctes(V2_DEFAULT), body="SELECT * FROM fv"))
def v1(spark, d):
    newest, p = labelled_newest(spark, d)
    return verdict.frame_verdict(newest, p, t.frames(spark, d))


@query("v1_frame_verdict_strict", with_views("detections", "frames", ctes=verdict_ctes("'FAULT_UNKNOWN'"), body="SELECT * FROM fv"))
def v1_strict(spark, d):
    newest, p = labelled_newest(spark, d)
    return verdict.frame_verdict(newest, p, t.frames(spark, d), unknown_is_fault=True)


@query("v2_unknown_orientation", with_views("detections", ctes={
    "labelled": f"SELECT *, {label()} AS label FROM detections"}, body=f"""
SELECT line_id, frame_id, det_id, {V2_DEFAULT} AS verdict FROM labelled WHERE label = 'unknown'"""))
def v2(spark, d):
    p, w, h = recipe(), F.col("width_px"), F.col("height_px")
    return (t.detections(spark, d).where(g.classify(w, h, p) == "unknown")
            .select(*t.FRAME, "det_id", g.unknown_verdict(w, h, p).alias("verdict")))
