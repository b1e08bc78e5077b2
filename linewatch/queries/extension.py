"""Extension points and streaming forms run over the tables."""

import pandas as pd
from pyspark.sql import functions as F

from linewatch.functions import extend
from linewatch.functions.recipe import recipe
from linewatch.operators import profiles as pr
from linewatch.operators import signals as sg
from linewatch.queries import query
from linewatch.queries.signals import _STATE, OVER
from linewatch.queries.sql import label, with_views
from linewatch.sources import shared
from linewatch.sources import tables as t
from linewatch.streaming import streams


def bright_box(frame: dict) -> list[dict]:
    """Box around all bright values of an 8-wide plane."""
    spots = [(i % frame["width"], i // frame["width"]) for i, v in enumerate(frame["plane"]) if v > 0.2]
    if not spots:
        return []
    xs, ys = [s[0] for s in spots], [s[1] for s in spots]
    w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
    return [{"x": min(xs), "y": min(ys), "w": w, "h": h, "cx": min(xs) + w / 2, "cy": min(ys) + h / 2,
             "area_px": len(spots), "confidence": 1.0, "circularity": 0.0, "solidity": 0.0}]


def planes(spark, d):
    return t.table(spark, d, "embeddings").select(
        (F.col("vec_id") % 4).alias("line_id"), F.col("vec_id").alias("frame_id"), F.col("embedding").alias("plane"),
        F.lit(8).alias("width"), F.lit(8).alias("height"))


_BOXES = """SELECT line_id, frame_id, CAST(MIN(x) AS INT) AS x, CAST(MIN(y) AS INT) AS y, CAST(MAX(x)-MIN(x)+1 AS INT) AS w, CAST(MAX(y)-MIN(y)+1 AS INT) AS h,
  COUNT(*) AS area_px FROM (SELECT vec_id AS frame_id, vec_id % 4 AS line_id, p % 8 AS x, p // 8 AS y FROM
  (SELECT vec_id, UNNEST(embedding) AS e, UNNEST(RANGE(len(embedding))) AS p FROM embeddings) WHERE CAST(e AS DOUBLE) > CAST(0.2 AS DOUBLE)) GROUP BY line_id, frame_id"""
_BOX_COLUMNS = ["line_id", "frame_id", "x", "y", "w", "h", "area_px"]


@query("u1_detector", _BOXES)
def u1(spark, d):
    extend.register_detector("bright_box", bright_box)
    return extend.detect(planes(spark, d), "bright_box").select(*_BOX_COLUMNS)


@query("u1_detector_udtf", _BOXES)
def u1_udtf(spark, d):
    extend.register_detector("bright_box", bright_box)
    extend.register_udtf(spark, "bright_box", "bright_box")
    planes(spark, d).createOrReplaceTempView("linewatch_planes")
    return spark.sql("SELECT line_id, frame_id, x, y, w, h, area_px FROM linewatch_planes, LATERAL bright_box(plane, width, height)")


_SHARE = f"""SELECT line_id, frame_id, verdict, verdict = 'FAULT_ROW_FUSED' AS is_fault FROM (SELECT line_id, frame_id,
  CASE WHEN COUNT(*) FILTER (WHERE {label()} <> 'single')*2 > COUNT(*) THEN 'FAULT_ROW_FUSED' ELSE 'OK' END AS verdict FROM detections GROUP BY ALL)"""


@query("u2_verdict_rule", with_views("detections", body=_SHARE))
def u2(spark, d):
    odd = F.count_if(F.col("label") != "single") * 2 > F.count(F.lit(1))
    pieces = pr.label_pieces(t.pieces(spark, d), recipe())
    return extend.verdict_by(pieces, F.when(odd, "FAULT_ROW_FUSED").otherwise("OK"))


@query("u2_verdict_rule_udaf", with_views("detections", body=_SHARE))
def u2_udaf(spark, d):
    def mostly_odd(pieces: pd.DataFrame) -> pd.Series:
        share = (pieces["label"] != "single").groupby(level=0).mean()
        return (share > 0.5).map({True: "FAULT_ROW_FUSED", False: "OK"})

    return extend.verdict_by(pr.label_pieces(t.pieces(spark, d), recipe()), mostly_odd, "label")


@query("u4_sql_functions", with_views("detections", "edges0", body=f"""SELECT line_id, frame_id, diam AS diameter_px, edge, {label()} AS label,
  LEAST(1.0::DOUBLE, area_px/60000::DOUBLE) AS confidence, GREATEST(width_px,height_px)/GREATEST(LEAST(width_px,height_px),1)::DOUBLE AS aspect FROM edges0"""))
def u4(spark, d):
    extend.register_sql_functions(spark)
    t.pieces(spark, d).createOrReplaceTempView("linewatch_pieces")
    return spark.sql("""SELECT line_id, frame_id, piece_diameter(width_px, height_px) AS diameter_px,
        leading_edge(cx, width_px, height_px) AS edge,
        classify_piece(width_px, height_px, 290, 290, 1.5D, 0.5D, 2.5D) AS label,
        piece_confidence(area_px, 60000) AS confidence, aspect_ratio(width_px, height_px) AS aspect FROM linewatch_pieces""")


@query("u3_state_listener", with_views("signals", body=f"""SELECT line_id, seq, old, new FROM (
  SELECT line_id, seq, LAG({_STATE}) {OVER} AS old, {_STATE} AS new FROM signals) WHERE old <> new"""))
def u3(spark, d):
    """One listener writes the changes; another one fails without stopping it."""
    path = shared.scratch(spark, "changes")

    def broken(_):
        raise RuntimeError("this listener always fails")

    changes = streams.StateChanges()
    changes.on_change(broken)
    changes.on_change(lambda df: df.select("line_id", "seq", "old", "new").write.parquet(path))
    named = t.signals(spark, d).withColumns({
        "state": F.when(F.col("fault"), "FAULT").when(F.col("running"), "TRACKING").otherwise("WAITING"),
        "why": F.col("seq").cast("string")})
    changes.notify(sg.state_changes(named, "state", "why"))
    return spark.read.schema("line_id long, seq long, old string, new string").parquet(path)
