"""Row filters and coordinate projections on the piece table.

All are column expressions, so Catalyst can move them towards the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.functions import geometry as g
from linewatch.functions.recipe import Recipe
from linewatch.sources.tables import FRAME

def _w() -> Column:
    return F.col("width_px")


def _h() -> Column:
    return F.col("height_px")


def _area() -> Column:
    return F.col("area_px")


def gate_noise(df: DataFrame, p: Recipe) -> DataFrame:
    return df.where(_area() >= p["noise_threshold"] * p["expected_area_px"])


def gate_max_area(df: DataFrame, roi_area: Column, frac: float = fixed.MAX_AREA_FRACTION) -> DataFrame:
    return df.where(_area() <= roi_area * F.lit(frac))


def gate_belt(df: DataFrame, p: Recipe) -> DataFrame:
    """Elongated streaks and ragged reflections; a limit of 0 switches a gate off."""
    longest, ragged = p["belt_max_aspect_ratio"], p["belt_min_solidity"]
    return df.where(((longest <= 0) | (g.aspect_ratio(_w(), _h()) <= longest))
                    & ((ragged <= 0) | (F.col("solidity") >= ragged)))


def _fused_candidate(p: Recipe) -> Column:
    return ((_area() >= p["expected_area_px"] * p["fused_threshold"])
            & (g.aspect_ratio(_w(), _h()) <= p["fused_threshold"] * 2.0))


def learned_gate(reference: Column, tolerance: Column) -> Column:
    return F.when(reference > 0, reference * tolerance).otherwise(0.0)


def gate_shape(df: DataFrame, p: Recipe, relax_solidity: bool = False) -> DataFrame:
    """Gates learned from reference pieces; fused candidates keep their low roundness."""
    round_min = learned_gate(p["ref_circularity_min"], p["circularity_tolerance"])
    solid_min = learned_gate(p["ref_solidity_min"], p["solidity_tolerance"])
    if relax_solidity:
        solid_min = F.least(solid_min, F.lit(fixed.RELAXED_SOLIDITY))
    return df.where((F.col("solidity") >= solid_min)
                    & (_fused_candidate(p) | (F.col("circularity") >= round_min)))


def gate_external(df: DataFrame, p: Recipe, roi_area: Column, min_circularity: float) -> DataFrame:
    """Area and roundness only: hollow rings pass."""
    kept = gate_max_area(gate_noise(df, p), roi_area)
    if min_circularity <= 0:
        return kept
    return kept.where(_fused_candidate(p) | (F.col("circularity") >= F.lit(min_circularity)))


def filter_candidates(df: DataFrame, p: Recipe, min_circularity: float = 0.75,
                      size_tolerance: float = 0.35, use_frame_median: bool = True) -> DataFrame:
    """Round and rightly sized pieces. The frame median is only computed when a
    recipe may lack a learned width."""
    diameter = g.piece_diameter(_w(), _h())
    learned = p["expected_width_px"].cast("double")
    reference = learned
    if use_frame_median:
        by_frame = Window.partitionBy(*FRAME)
        median = F.coalesce(F.median(diameter).over(by_frame), F.lit(0.0))
        reference = F.when(learned > 1.0, learned).otherwise(median)
    low, high = 1.0 - size_tolerance, 1.0 + size_tolerance
    round_enough = (F.col("circularity") <= 0) | (F.col("circularity") >= F.lit(min_circularity))
    return (df.withColumns({"_ref": reference, "_diam": diameter})
            .where(round_enough & ((F.col("_ref") <= 1.0) | F.col("_diam").isNull()
                   | F.col("_diam").between(F.col("_ref") * low, F.col("_ref") * high)))
            .drop("_ref", "_diam"))


# --- regions -------------------------------------------------------------

def split_column(p: Recipe, frame_width: Column) -> Column:
    return F.greatest(F.lit(1), F.least(p["roi_split_x"], frame_width - 1))


def split_roi(df: DataFrame, p: Recipe, frame_width: Column, x: str = "cx") -> DataFrame:
    """Left of the split is belt; the rest is feed, with x made local to it."""
    split = split_column(p, frame_width)
    return (df.withColumns({"split_x": split, "clamped": split != p["roi_split_x"]})
            .withColumn("roi", F.when(F.col(x) < F.col("split_x"), "belt").otherwise("feed"))
            .withColumn(x, F.when(F.col("roi") == "feed", F.col(x) - F.col("split_x")).otherwise(F.col(x))))


def crop_rect(width: Column, height: Column, top: Column, bottom: Column,
              left: Column, right: Column) -> dict[str, Column]:
    """Inset rectangle that always keeps at least one pixel."""
    x1 = F.greatest(F.lit(0), F.least(left, width - 1))
    y1 = F.greatest(F.lit(0), F.least(top, height - 1))
    x2 = F.when(right > 0, F.least(width, F.greatest(x1 + 1, width - right))).otherwise(width)
    y2 = F.when(bottom > 0, F.least(height, F.greatest(y1 + 1, height - bottom))).otherwise(height)
    return {"crop_x1": x1, "crop_y1": y1, "crop_x2": x2, "crop_y2": y2}


def apply_crop(df: DataFrame, rect: dict[str, Column], x: str = "cx", y: str = "cy") -> DataFrame:
    inside = ((F.col(x) >= F.col("crop_x1")) & (F.col(x) < F.col("crop_x2"))
              & (F.col(y) >= F.col("crop_y1")) & (F.col(y) < F.col("crop_y2")))
    return (df.withColumns(rect).where(inside)
            .withColumns({x: F.col(x) - F.col("crop_x1"), y: F.col(y) - F.col("crop_y1")}))


def with_bbox(df: DataFrame) -> DataFrame:
    return df.withColumns({"bbox_x": F.floor(F.col("cx") - _w() / 2.0).cast("int"),
                           "bbox_y": F.floor(F.col("cy") - _h() / 2.0).cast("int")})


def offset_to_roi(df: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Shift box and centre back; the shape measures stay as they are."""
    moved = {"cx": dx, "cy": dy, "bbox_x": dx, "bbox_y": dy}
    return df.withColumns({c: F.col(c) + d for c, d in moved.items() if c in df.columns})


def detect_scale(width: Column, target: int = 800) -> Column:
    return F.when(width > target, F.lit(float(target)) / width).otherwise(1.0)


def rescale(df: DataFrame, scale: Column) -> DataFrame:
    """Detection space back to full size; whole-number fields truncate."""
    up = F.lit(1.0) / scale
    ints = {c: (F.col(c) * up).cast("int") for c in ("bbox_x", "bbox_y", "width_px", "height_px")
            if c in df.columns}
    return df.withColumns({**ints, "cx": F.col("cx") * up, "cy": F.col("cy") * up,
                           "area_px": (_area() * up * up).cast("long")})


def scaled_recipe(p: Recipe, scale: Column) -> dict[str, Column]:
    def down(c: Column, factor: Column) -> Column:
        return F.greatest(F.lit(1), (c * factor).cast("int"))
    return {**p, "expected_width_px": down(p["expected_width_px"], scale),
            "expected_height_px": down(p["expected_height_px"], scale),
            "expected_area_px": down(p["expected_area_px"], scale * scale)}


def orient(x: Column, y: Column, width: Column, height: Column, rotation: Column,
           mirror: Column) -> tuple[Column, Column]:
    """Turn clockwise by 0/90/180/270 degrees, then mirror left to right."""
    tx = (F.when(rotation == 90, height - 1 - y).when(rotation == 180, width - 1 - x)
          .when(rotation == 270, y).otherwise(x))
    ty = (F.when(rotation == 90, x).when(rotation == 180, height - 1 - y)
          .when(rotation == 270, width - 1 - x).otherwise(y))
    turned_width = F.when(rotation.isin(90, 270), height).otherwise(width)
    return F.when(mirror, turned_width - 1 - tx).otherwise(tx), ty


def detection_zone(df: DataFrame, p: Recipe, zone: int, x: str = "cx") -> DataFrame:
    """Approach side of the line only; a zone of 0 keeps everything."""
    if zone <= 0:
        return df
    line, half = g.local_line(p), p["expected_width_px"] / 2.0
    left = F.greatest(F.lit(0), (line - half).cast("int"))
    right = (line + half + F.lit(zone)).cast("int")
    return df.where((right <= left) | ((F.col(x) >= left) & (F.col(x) < right)))


def band_filter(df: DataFrame, p: Recipe, line: Column) -> DataFrame:
    """Leading edge within the transfer bridge; the bridge is as wide as a piece."""
    diameter = g.piece_diameter(_w(), _h())
    median = F.median(diameter).over(Window.partitionBy(*FRAME))
    width = F.greatest(p["transfer_bridge_width_px"].cast("double"),
                       F.coalesce(median, p["expected_width_px"].cast("double")))
    edge = g.leading_edge(F.col("cx"), _w(), _h())
    return (df.withColumns({"edge": edge, "band_px": width})
            .where(F.col("edge").between(line - F.col("band_px") / 2.0, line + F.col("band_px") / 2.0)))


def boundary_split(df: DataFrame, boundary: Column) -> DataFrame:
    edge = g.leading_edge(F.col("cx"), _w(), _h())
    return df.withColumn("eligible", boundary.isNull() | (edge > boundary))


def sample_every(df: DataFrame, n: int, frame: str = "frame_id") -> DataFrame:
    return df.where(F.pmod(F.col(frame), F.lit(n)) == 0)
