"""Piece geometry as column expressions (no Python in the data path)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.functions.recipe import Recipe


def piece_diameter(w: Column, h: Column) -> Column:
    """Mean of both sides, the one known side, or NULL."""
    return (F.when((w > 0) & (h > 0), (w + h) / 2.0)
            .when((w > 0) | (h > 0), F.greatest(w, h).cast("double")))


def leading_edge(cx: Column, w: Column, h: Column) -> Column:
    """Front of a piece; travel is towards smaller x."""
    return cx - F.coalesce(piece_diameter(w, h), F.lit(0.0)) / 2.0


def size_ratio(size: Column, expected: Column) -> Column:
    return size / F.greatest(expected, F.lit(1))


def classify(w: Column, h: Column, p: Recipe) -> Column:
    rw = size_ratio(w, p["expected_width_px"])
    rh = size_ratio(h, p["expected_height_px"])
    cap, fused, low = p["unknown_max_ratio"], p["fused_threshold"], p["single_min_ratio"]
    return (F.when(F.greatest(rw, rh) > cap, fixed.UNKNOWN)
            .when(F.least(rw, rh) >= fused, fixed.UNKNOWN)
            .when(rw >= fused, fixed.ROW_FUSED)
            .when(rh >= fused, fixed.COLUMN_FUSED)
            .when(F.least(rw, rh) < low, fixed.UNKNOWN)
            .otherwise(fixed.SINGLE))


def confidence(area: Column, p: Recipe) -> Column:
    return F.least(F.lit(1.0), area / F.greatest(p["expected_area_px"], F.lit(1)))


def is_fault_label(label: Column) -> Column:
    return label.isin(*fixed.FAULT_LABELS)


def is_fault_verdict(verdict: Column) -> Column:
    return verdict.isin(*fixed.FAULT_VERDICTS)


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4.0 * math.pi * area / (perimeter * perimeter)).otherwise(0.0)


def solidity(area: Column, hull_area: Column) -> Column:
    return F.when(hull_area > 0, area / hull_area).otherwise(0.0)


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))


def area_mm2(area_px: Column, px_per_mm: Column) -> Column:
    return (F.when(px_per_mm > 0, area_px / (px_per_mm * px_per_mm))
            .otherwise(F.raise_error(F.lit("px_per_mm must be positive")).cast("double")))


def adaptive_block(p: Recipe) -> Column:
    """Odd local-threshold block; 0 means derive it from the expected width."""
    width = p["expected_width_px"].cast("int")
    auto = F.greatest(F.lit(51), width * 2).bitwiseOR(F.lit(1))
    return (F.when(p["belt_adaptive_block"] != 0, p["belt_adaptive_block"].cast("int"))
            .when(width > 20, auto).otherwise(F.lit(0)))


def unknown_verdict(w: Column, h: Column, p: Recipe) -> Column:
    """A piece of unknown label is a fault only when it reads clearly wide."""
    rw = size_ratio(w, p["expected_width_px"])
    rh = size_ratio(h, p["expected_height_px"])
    return (F.when((rw >= p["fused_threshold"]) & (rw >= rh), fixed.FAULT_ROW_FUSED)
            .otherwise(fixed.INFO_UNKNOWN_NONFAULT))


def overshoot(line: Column, tangent: Column) -> Column:
    return line - tangent


def local_line(p: Recipe) -> Column:
    """Transfer line in feed-region coordinates."""
    return p["transfer_line_x"] - p["roi_split_x"]
