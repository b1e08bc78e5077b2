"""One verdict per frame, and the two frame-level compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.functions import geometry as g
from linewatch.functions.recipe import Recipe
from linewatch.sources.tables import FRAME


def piece_verdict(label: Column, w: Column, h: Column, p: Recipe, unknown_is_fault: bool) -> Column:
    unknown = F.lit(fixed.FAULT_UNKNOWN) if unknown_is_fault else g.unknown_verdict(w, h, p)
    return (F.when(label == fixed.ROW_FUSED, fixed.FAULT_ROW_FUSED)
            .when(label == fixed.UNKNOWN, unknown)
            .when(label == fixed.COLUMN_FUSED, fixed.INFO_COLUMN_FUSED)
            .otherwise(fixed.OK))


def frame_verdict(rows: DataFrame, p: Recipe, frames: DataFrame | None = None,
                  unknown_is_fault: bool = False) -> DataFrame:
    """First fault in piece order, else first note, else OK.

    ``rows`` holds the pieces of the newest row with a ``label``. Given
    ``frames``, frames without pieces come out as incomplete.
    """
    verdict = piece_verdict(F.col("label"), F.col("width_px"), F.col("height_px"), p, unknown_is_fault)
    severity = (F.when(g.is_fault_verdict(F.col("_v")), 0)
                .when(F.col("_v") != fixed.OK, 1).otherwise(2))
    out = (rows.withColumn("_v", verdict).withColumn("_s", severity).groupBy(*FRAME)
           .agg(F.min_by("_v", F.struct("_s", "det_id")).alias("verdict"),
                F.count(F.lit(1)).alias("row_pieces")))
    if frames is not None:
        out = (frames.select(*FRAME).join(out, FRAME, "left")
               .na.fill({"verdict": fixed.INFO_INCOMPLETE_ROW, "row_pieces": 0}))
    return out.withColumn("is_fault", g.is_fault_verdict(F.col("verdict")))
