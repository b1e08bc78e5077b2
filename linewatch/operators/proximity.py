"""Pieces near each other inside one frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.functions.recipe import Recipe
from linewatch.sources.tables import FRAME

_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _cells(df: DataFrame, radius: Column, spread: bool) -> DataFrame:
    gx = F.floor(F.col("cx") / radius)
    gy = F.floor(F.col("cy") / radius)
    if not spread:
        return df.withColumns({"_gx": gx, "_gy": gy})
    around = F.array(*[F.struct((gx + i).alias("x"), (gy + j).alias("y")) for i, j in _AROUND])
    return df.withColumn("_g", F.explode(around)).withColumns({"_gx": F.col("_g.x"), "_gy": F.col("_g.y")}).drop("_g")


def neighbours(a: DataFrame, b: DataFrame, radius: float | Column, strict: bool) -> DataFrame:
    """Pairs closer than ``radius`` in the same frame.

    Both sides are put on a grid of that cell size, so the join is an equi-join
    on the cell and only looks at pieces next to each other. ``radius`` may be a
    column of both sides if it is constant within a frame.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    left = _cells(a.select(*FRAME, "det_id", "cx", "cy", r.alias("_r")), F.col("_r"), True)
    right = (_cells(b.select(*FRAME, "det_id", "cx", "cy", r.alias("_r")), F.col("_r"), False).drop("_r")
             .withColumnsRenamed({"det_id": "other_id", "cx": "_ox", "cy": "_oy"}))
    near = F.sqrt((F.col("cx") - F.col("_ox")) * (F.col("cx") - F.col("_ox"))
                  + (F.col("cy") - F.col("_oy")) * (F.col("cy") - F.col("_oy")))
    pairs = left.join(right, [*FRAME, "_gx", "_gy"]).withColumn("distance_px", near)
    close = F.col("distance_px") < F.col("_r") if strict else F.col("distance_px") <= F.col("_r")
    return pairs.where(close).select(*FRAME, "det_id", "other_id", "distance_px")


def merge_distance(p: Recipe) -> Column:
    return p["fused_merge_distance_factor"] * ((p["expected_width_px"] + p["expected_height_px"]) / 2.0)


def close_pairs(df: DataFrame, p: Recipe) -> DataFrame:
    """Pairs of one table: half of the surrounding cells is enough, as every pair
    of cells is met from one of its sides."""
    own = df.withColumn("_r", merge_distance(p)).select(*FRAME, "det_id", "cx", "cy", "_r")
    gx, gy = F.floor(F.col("cx") / F.col("_r")), F.floor(F.col("cy") / F.col("_r"))
    half = F.array(*[F.struct((gx + i).alias("x"), (gy + j).alias("y"), F.lit(i == j == 0).alias("own"))
                     for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    left = own.withColumn("_g", F.explode(half)).select(
        *FRAME, F.col("det_id").alias("_a"), F.col("cx").alias("_ax"), F.col("cy").alias("_ay"), "_r",
        F.col("_g.x").alias("_gx"), F.col("_g.y").alias("_gy"), F.col("_g.own").alias("_own"))
    right = own.select(*FRAME, F.col("det_id").alias("_b"), F.col("cx").alias("_bx"), F.col("cy").alias("_by"),
                       gx.alias("_gx"), gy.alias("_gy"))
    dx, dy = F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")
    return (left.join(right, [*FRAME, "_gx", "_gy"]).where(~F.col("_own") | (F.col("_a") < F.col("_b")))
            .withColumn("distance_px", F.sqrt(dx * dx + dy * dy)).where(F.col("distance_px") < F.col("_r"))
            .select(*FRAME, F.least("_a", "_b").alias("det_id"), F.greatest("_a", "_b").alias("other_id"), "distance_px"))


def compare_methods(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Counts of two detection methods per frame, and pieces of A that B also found."""
    matched = (neighbours(a, b, tolerance, strict=False).select(*FRAME, "det_id").distinct()
               .groupBy(*FRAME).agg(F.count(F.lit(1)).alias("matched")))
    na = a.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("pieces_a"))
    nb = b.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("pieces_b"))
    return na.join(nb, FRAME, "full_outer").join(matched, FRAME, "left").na.fill(0)


MERGED = ("line_id long, frame_id long, det_id long, bbox_x int, bbox_y int, width_px int, height_px int, "
          "cx double, cy double, area_px long, circularity double, solidity double, merged_from int, seat int, "
          "reach_cx double, profile_name string")


def _fuse(a: tuple, b: tuple) -> tuple:
    x, y = min(a[1], b[1]), min(a[2], b[2])
    w, h = max(a[1] + a[3], b[1] + b[3]) - x, max(a[2] + a[4], b[2] + b[4]) - y
    area = a[7] + b[7]
    return (min(a[0], b[0]), x, y, w, h, (a[5] * a[7] + b[5] * b[7]) / area, (a[6] * a[7] + b[6] * b[7]) / area,
            area, None, None, a[10] + b[10])


def _merge_frame(pieces: list[tuple], reach: float) -> list[tuple]:
    """Fuse the first close pair in order, put the result last, start over.

    Starting over only repeats what can have changed: pieces before ``settled``
    have met all others, so they only meet the newest one.
    """
    settled = i = 0
    while i < len(pieces):
        x, y, n = pieces[i][5], pieces[i][6], len(pieces)
        mate = next((j for j in range(i + 1 if i >= settled else n - 1, n)
                     if ((x - pieces[j][5]) ** 2 + (y - pieces[j][6]) ** 2) ** 0.5 < reach), None)
        if mate is None:
            i += 1
            continue
        fused = _fuse(pieces[i], pieces[mate])
        pieces = pieces[:i] + pieces[i + 1:mate] + pieces[mate + 1:] + [fused]
        settled, i = settled - 1 if i < settled else i, 0
    return pieces


_FIELDS = ["det_id", "bbox_x", "bbox_y", "width_px", "height_px", "cx", "cy", "area_px", "circularity", "solidity"]
_OUT = ["line_id", "frame_id", *_FIELDS, "merged_from", "seat", "reach_cx", "profile_name"]


def _merge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by frame; only the pieces of one frame are held at a time."""
    key, reach, name, held, out = None, 0.0, None, [], []
    order = [c.split()[0] for c in MERGED.split(", ")]

    def flush() -> None:
        pieces = _merge_frame(held, reach)
        furthest = max(p[5] for p in pieces)
        out.extend((*key, *p, seat, furthest, name) for seat, p in enumerate(pieces))

    def table() -> pd.DataFrame:
        return pd.DataFrame(out, columns=_OUT)[order].astype({"circularity": "float64", "solidity": "float64"})

    for batch in batches:
        cols = [batch[c].tolist() for c in ("line_id", "frame_id", *_FIELDS, "_reach", "_name")]
        for line, frame, *piece, r, n in zip(*cols):
            if (line, frame) != key:
                if key is not None:
                    flush()
                key, reach, name, held = (line, frame), r, n, []
            held.append((*piece, 1))
        if out:
            yield table()
            out = []
    if key is not None:
        flush()
    if out:
        yield table()


def proximity_merge(df: DataFrame, p: Recipe) -> DataFrame:
    """Fuse pieces whose centres are closer than the merge distance, to a fixpoint.

    The greedy order is part of the result, so each frame is folded by a small
    helper over the sorted rows of its partition; memory is one frame. ``seat``
    is the place in the result list (survivors in order, merged pieces last), and
    ``reach_cx`` the largest centre of the frame, which spares the newest-row rule
    a window over pieces that have just been together. Shape measures of merged
    pieces are unknown. A ``profile_name`` of the frame passes through.
    """
    name = F.col("profile_name") if "profile_name" in df.columns else F.lit(None).cast("string")
    work = df.select(*FRAME, *_FIELDS, merge_distance(p).alias("_reach"), name.alias("_name"))
    return (work.repartition(*FRAME).sortWithinPartitions(*FRAME, "det_id")
            .mapInPandas(_merge_batches, MERGED))


__all__ = ["neighbours", "close_pairs", "compare_methods", "proximity_merge", "merge_distance"]
