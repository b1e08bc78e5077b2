"""The two frame-level compositions: belt inspection and feed tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.functions import geometry as g
from linewatch.functions.recipe import recipe_from
from linewatch.operators import gates, profiles, proximity, rows, verdict
from linewatch.sources.tables import FRAME

SIDES = ("top", "bottom", "left", "right")
NO_CROP = dict.fromkeys(SIDES, 0)


def _crop(df: DataFrame, width: Column, height: Column, inset: dict[str, int]) -> DataFrame:
    return gates.apply_crop(df, gates.crop_rect(width, height, *[F.lit(inset[s]) for s in SIDES]))


def _uncrop(df: DataFrame) -> DataFrame:
    return gates.offset_to_roi(df, F.col("crop_x1"), F.col("crop_y1"))


def inspect(pieces: DataFrame, frames: DataFrame, recipes: DataFrame, crop: dict[str, int] = NO_CROP,
            merge: bool = True, unknown_is_fault: bool = False, width: int = 3200, height: int = 2200,
            **fixed_recipe) -> DataFrame:
    """Verdict per frame. ``pieces`` carry ``profile_name`` and full-frame ``cx``.

    Filters run before the merge. The merge hands on the recipe name, so the
    recipe is joined again by name instead of carrying its columns through
    Python, and the frame's largest centre, so the pieces are not clustered by
    frame a second time: what is shuffled after it is one partial verdict per
    frame and task.
    """
    wanted = pieces.select(*FRAME, "det_id", "cx", "cy", "width_px", "height_px", "area_px",
                           "circularity", "solidity", "profile_name")
    df = profiles.with_profile(wanted, recipes)
    p = recipe_from(df, **fixed_recipe)
    df = gates.split_roi(df, p, F.lit(width)).where(F.col("roi") == "belt")
    df = _crop(df, F.col("split_x"), F.lit(height), crop)
    area = (F.col("crop_x2") - F.col("crop_x1")) * (F.col("crop_y2") - F.col("crop_y1"))
    df = gates.gate_shape(gates.gate_belt(gates.gate_max_area(gates.gate_noise(df, p), area), p), p)
    df, reach = gates.with_bbox(_uncrop(df)), None
    if merge:
        df = profiles.with_profile(proximity.proximity_merge(df, p), recipes)
        p, reach = recipe_from(df, **fixed_recipe), F.col("reach_cx")
        # Order inside a frame is the place in the merged list.
        df = df.withColumn("det_id", F.col("seat").cast("long"))
    df = df.withColumn("label", g.classify(F.col("width_px"), F.col("height_px"), p))
    return verdict.frame_verdict(rows.newest_row(df, p, reach), p, frames, unknown_is_fault)


def track(pieces: DataFrame, recipes: DataFrame, occupancy: DataFrame | None = None, method: str = "blob",
          zone: int = 0, crop: dict[str, int] = NO_CROP, width: int = 3200, height: int = 2200,
          min_circularity: float = 0.75, size_tolerance: float = 0.35, column_profiles: DataFrame | None = None,
          **fixed_recipe) -> DataFrame:
    """Feed-region pieces that may drive a stop, in region coordinates. Per frame,
    ``occupancy`` and ``column_profiles`` are handed on beside them."""
    df = profiles.with_profile(pieces, recipes)
    p = recipe_from(df, **fixed_recipe)
    df = gates.split_roi(df, p, F.lit(width)).where(F.col("roi") == "feed")
    df = gates.detection_zone(df, p, zone)
    df = _crop(df, F.lit(width) - F.col("split_x"), F.lit(height), crop)
    area = (F.col("crop_x2") - F.col("crop_x1")) * (F.col("crop_y2") - F.col("crop_y1"))
    if method == "blob":
        df = gates.gate_shape(gates.gate_max_area(gates.gate_noise(df, p), area), p)
    elif method in ("contour_external", "bg_subtract"):
        df = gates.gate_external(df, p, area, min_circularity if method == "contour_external" else 0.0)
    elif method != "hough":  # circles arrive gated by their detector
        raise ValueError(f"unknown method {method!r}")
    df = gates.filter_candidates(df, p, min_circularity, size_tolerance, use_frame_median=False)
    df = _uncrop(df).withColumn("edge", g.leading_edge(F.col("cx"), F.col("width_px"), F.col("height_px")))
    for beside in (occupancy, column_profiles):
        if beside is not None:
            df = df.join(beside, FRAME, "left")
    return df
