"""Pixel tables: ``line_id, frame_id, x, y, v`` on a dense grid per frame.

Neighbourhoods are separable windows along x and y inside one frame. The table
is clustered by frame once (``by_frame``); every window and aggregate below
then runs without another exchange. A partition of a window is one pixel row or
column of an image, so its length is bounded by the image size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from linewatch import fixed
from linewatch.functions import geometry as g
from linewatch.functions.recipe import Recipe
from linewatch.operators.profiles import exact_median
from linewatch.sources.tables import FRAME

PX = [*FRAME, "x", "y"]
FLAT_CONTRAST = 3.0   # fixed value: below it a frame has no usable split
WIDE = 15             # from here on extrema use running blocks


def image_row() -> WindowSpec:
    return Window.partitionBy(*FRAME, "y")


def image_column() -> WindowSpec:
    return Window.partitionBy(*FRAME, "x")


def along_x() -> WindowSpec:
    return image_row().orderBy("x")


def along_y() -> WindowSpec:
    return image_column().orderBy("y")


def by_frame(px: DataFrame) -> DataFrame:
    return px.repartition(*FRAME)


# --- size ----------------------------------------------------------------------

def frame_size(px: DataFrame) -> DataFrame:
    return px.groupBy(*FRAME).agg((F.max("x") + 1).cast("long").alias("_w"), (F.max("y") + 1).cast("long").alias("_h"))


def _scale(to_width: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(to_width)) / F.col("_w"))


def _cells(at: str, old: str, new: str) -> Column:
    """Small pixels that pixel ``at`` meets along one axis, with the part they share."""
    begin = F.col(at).cast("long") * F.col(new)
    cells = F.sequence(F.expr(f"cast({at} AS long) * {new} div {old}"), F.expr(f"((cast({at} AS long) + 1) * {new} - 1) div {old}"))
    return F.transform(cells, lambda i: F.struct(i.alias("at"), (
        F.least((i + 1) * F.col(old), begin + F.col(new)) - F.greatest(i * F.col(old), begin)).alias("part")))


def downscale(px: DataFrame, to_width: int) -> DataFrame:
    """Frames wider than ``to_width`` by area averages; others stay as they are.

    A pixel counts by the share of it that a small pixel covers. Shares are whole
    numbers (of width times height), so means are exact; a pixel meets at most two
    small ones along an axis. Halves go to the even value, and up where just
    2 x 2 pixels meet.
    """
    if to_width < 1:
        raise ValueError("to_width must be at least 1")
    height = F.greatest(F.lit(1), F.floor(F.col("_h") * _scale(to_width)))
    sizes = frame_size(px).withColumns({"_nw": F.least(F.col("_w"), F.lit(to_width)), "_nh": height})
    size = ["_w", "_h", "_nw", "_nh"]
    met = (px.join(sizes, FRAME).select(*FRAME, "y", "v", *size, F.explode(_cells("x", "_w", "_nw")).alias("_i"))
           .select(*FRAME, "v", *size, "_i", F.explode(_cells("y", "_h", "_nh")).alias("_j")))
    sums = met.groupBy(*FRAME, F.col("_i.at").alias("x"), F.col("_j.at").alias("y"), *size).agg(
        F.sum(F.col("v") * F.col("_i.part") * F.col("_j.part")).alias("_s"))
    whole, below = F.col("_w") * F.col("_h"), F.expr("_s div (_w * _h)")
    twice = 2 * (F.col("_s") - below * whole)
    halved = (F.col("_w") == 2 * F.col("_nw")) & (F.col("_h") == 2 * F.col("_nh"))
    up = (twice > whole) | ((twice == whole) & (halved | (below % 2 == 1)))
    return sums.select(*FRAME, F.col("x").cast("int"), F.col("y").cast("int"), (below + up.cast("int")).cast("int").alias("v"))


def _scaled(p: Recipe, scale: Column) -> Recipe:
    """Expected sizes in a frame shown at ``scale``: whole numbers, at least 1."""
    factors = {"expected_area_px": scale * scale, "expected_width_px": scale, "expected_height_px": scale}
    return {**p, **{c: F.when(scale < 1, F.greatest(F.lit(1), F.floor(p[c] * k))).otherwise(p[c]) for c, k in factors.items()}}


def _full_size(blobs: DataFrame) -> DataFrame:
    """Measures back in pixels of the frame as it came in."""
    back = 1.0 / F.col("_scale")
    kinds = dict(blobs.dtypes)
    lengths = {c: F.floor(F.col(c) * back).cast(kinds[c]) for c in ("bbox_x", "bbox_y", "width_px", "height_px")}
    return blobs.withColumns({**lengths, "area_px": F.floor(F.col("area_px") * back * back).cast(kinds["area_px"]),
                              "cx": F.col("cx") * back, "cy": F.col("cy") * back}).drop("_scale")


# --- statistics --------------------------------------------------------------

def histogram(px: DataFrame, bins: int = 256) -> DataFrame:
    """All bins of every frame, scaled by the fullest bin."""
    filled = px.groupBy(*FRAME, F.expr(f"v * {bins} div 256").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("bin").isNotNull()
    frames = filled.groupBy(*FRAME).agg(
        F.map_from_entries(F.collect_list(F.when(known, F.struct("bin", "n")))).alias("_counts"), F.max(F.when(known, F.col("n"))).alias("_fullest"))
    every = frames.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0).cast("long"))
    return every.select(*FRAME, "bin", n.alias("n"), (n / F.col("_fullest")).alias("height"))


def lift_shadow(px: DataFrame, floor: int = fixed.SHADOW_FLOOR) -> DataFrame:
    """Deep shadow counts as white, so the split falls between piece and surface."""
    return px.withColumn("v", F.when(F.col("v") < floor, 255).otherwise(F.col("v")))


def frame_stats(px: DataFrame, dark: bool = False) -> DataFrame:
    """Otsu threshold and contrast of every frame out of one histogram.

    The threshold maximises the between-class variance, the lowest one on ties.
    The variance only changes at grey levels that occur, so empty bins are
    skipped. Contrast is the population standard deviation; dark mode lifts the
    shadow for the threshold and leaves it out of the contrast.
    """
    lifted = px
    if dark:
        lifted = lift_shadow(px.withColumn("_lit", (F.col("v") >= fixed.SHADOW_FLOOR).cast("int")))
    lit = F.sum("_lit") if dark else F.count(F.lit(1))
    hist = lifted.groupBy(*FRAME, "v").agg(F.count(F.lit(1)).alias("n"), lit.alias("_k"))
    up = Window.partitionBy(*FRAME).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*FRAME)
    c = hist.withColumns({"_n0": F.sum("n").over(up), "_s0": F.sum(F.col("n") * F.col("v")).over(up),
                          "_N": F.sum("n").over(whole), "_S": F.sum(F.col("n") * F.col("v")).over(whole)})
    n0, s0, n, s = (F.col(x).cast("double") for x in ("_n0", "_s0", "_N", "_S"))
    diff = s0 / n0 - (s - s0) / (n - n0)
    between = F.when(F.col("_n0") < F.col("_N"), F.round((n0 / n) * ((n - n0) / n) * diff * diff, 6))
    k, kv, kvv = F.sum("_k"), F.sum(F.col("_k") * F.col("v")), F.sum(F.col("_k") * F.col("v") * F.col("v"))
    # Whole numbers up to here, so the variance is exact before the root.
    variance = (kvv * k - kv * kv) / (k * k)
    return (c.withColumn("_b", between).groupBy(*FRAME).agg(
        F.coalesce(F.max_by("v", F.when(F.col("_b").isNotNull(), F.struct("_b", -F.col("v")))), F.lit(0)).alias("threshold"),
        F.coalesce(F.when(k > 0, F.sqrt(variance)), F.lit(0.0)).alias("contrast")))


def otsu(px: DataFrame, dark: bool = False) -> DataFrame:
    return frame_stats(px, dark).drop("contrast")


def contrast(px: DataFrame, dark: bool = False) -> DataFrame:
    return frame_stats(px, dark).drop("threshold")


# --- filters -----------------------------------------------------------------

def _smooth(px: DataFrame, w, source: str, target: str) -> DataFrame:
    """1-4-6-4-1 along one axis; the edge is mirrored without repeating it."""
    v = F.col(source)
    l1, l2, r1, r2 = F.lag(v, 1).over(w), F.lag(v, 2).over(w), F.lead(v, 1).over(w), F.lead(v, 2).over(w)
    p = px.withColumns({"_l1": l1, "_l2": l2, "_r1": r1, "_r2": r2})
    one_left, one_right = F.coalesce("_l1", "_r1"), F.coalesce("_r1", "_l1")
    two_left = F.coalesce(F.col("_l2"), F.when(F.col("_l1").isNotNull(), v), F.col("_r2"))
    two_right = F.coalesce(F.col("_r2"), F.when(F.col("_r1").isNotNull(), v), F.col("_l2"))
    return (p.withColumn(target, two_left + one_left * 4 + v * 6 + one_right * 4 + two_right)
            .drop("_l1", "_l2", "_r1", "_r2"))


def blur5(px: DataFrame) -> DataFrame:
    out = _smooth(_smooth(px, along_x(), "v", "_h"), along_y(), "_h", "_b")
    return out.withColumn("v", F.expr("(_b + 128) div 256").cast("int")).drop("_h", "_b")


def threshold(px: DataFrame, t: Column, invert: bool = False) -> DataFrame:
    high, low = (0, 255) if invert else (255, 0)
    return px.withColumn("v", F.when(F.col("v") > t, high).otherwise(low))


def _box_sum(px: DataFrame, along, whole, at: str, r: int, source: str, target: str) -> DataFrame:
    """Sum over 2r+1 pixels along one axis with the border pixel repeated outside.

    Differences of running sums: the cost per pixel does not grow with the block.
    """
    i, n = F.col("_i"), F.col("_n")
    total = F.sum(source).over(whole)
    p = px.withColumns({
        "_i": F.row_number().over(along) - 1, "_n": F.count(F.lit(1)).over(whole), "_all": total,
        "_run": F.sum(source).over(along.rowsBetween(Window.unboundedPreceding, 0)),
        "_first": F.first(source).over(along.rowsBetween(Window.unboundedPreceding, 0))})
    p = p.withColumns({"_upto": F.lead("_run", r).over(along) if r else F.col("_run"),
                       "_before": F.lag("_run", r + 1).over(along),
                       "_last": F.max_by(source, at).over(whole)})
    inside = F.coalesce("_upto", "_all") - F.coalesce("_before", F.lit(0))
    left, right = F.greatest(F.lit(0), r - i), F.greatest(F.lit(0), i + r - (n - 1))
    return (p.withColumn(target, inside + left * F.col("_first") + right * F.col("_last"))
            .drop("_i", "_n", "_all", "_run", "_first", "_upto", "_before", "_last"))


def local_mean(px: DataFrame, block: int) -> DataFrame:
    block |= 1
    r = block // 2
    out = _box_sum(_box_sum(px, along_x(), image_row(), "x", r, "v", "_h"), along_y(), image_column(), "y", r, "_h", "_s")
    return out.withColumn("mean", F.round(F.col("_s") / (block * block)).cast("int")).drop("_h", "_s")


def adaptive_threshold(px: DataFrame, block: int, c: int, invert: bool = False) -> DataFrame:
    above = F.col("v") > F.col("mean") - c
    on = ~above if invert else above
    return local_mean(px, block).withColumn("v", F.when(on, 255).otherwise(0)).drop("mean")


def auto_threshold(px: DataFrame, dark: bool = False, forced_block: int = 0, block: int = 51, c: int = -10) -> DataFrame:
    """Otsu where the frame has contrast, local means where it is flat."""
    if forced_block > 1 and not dark:
        return adaptive_threshold(px, forced_block, c)
    return _by_contrast(px, dark, block, c).drop("threshold", "contrast")


def _by_contrast(px: DataFrame, dark: bool, block: int, c: int) -> DataFrame:
    """``auto_threshold`` with the statistics of the frame beside every pixel.

    Two branches by a join on the frame below the windows: local means are only
    computed for the (rare) flat frames.
    """
    base = px.withColumn("_raw", F.col("v"))
    lifted = lift_shadow(base) if dark else base
    stats = frame_stats(px, dark)
    c = -c if dark else c
    flat = F.col("contrast") < FLAT_CONTRAST
    by_level = lifted.join(stats.where(~flat), FRAME).withColumn("_above", F.col("v") > F.col("threshold"))
    by_mean = (local_mean(lifted.join(stats.where(flat), FRAME), block)
               .withColumn("_above", F.col("v") > F.col("mean") - c).drop("mean"))
    above = F.col("_above")
    on = (~above & (F.col("_raw") >= fixed.SHADOW_FLOOR)) if dark else above
    return (by_level.unionByName(by_mean)
            .withColumn("v", F.when(on, 255).otherwise(0)).drop("_raw", "_above"))


# --- morphology --------------------------------------------------------------

def ellipse_widths(k: int) -> list[int]:
    """Half width of each kernel row of a filled ellipse of size k."""
    r = k // 2
    if r == 0:
        return [0]
    return [round(r * float(np.sqrt((r * r - dy * dy) / (r * r)))) for dy in range(-r, k - r)]


def _extreme(px: DataFrame, along, whole, at: str, r: int, pick, combine, source: str, target: str) -> DataFrame:
    """Extreme over 2r+1 pixels along one axis; outside is ignored.

    Small kernels use a sliding frame. Wide ones combine running extremes inside
    blocks of the kernel size, so the cost per pixel does not grow with it.
    """
    if 2 * r + 1 < WIDE:
        return px.withColumn(target, pick(source).over(along.rowsBetween(-r, r)))
    k = 2 * r + 1
    p = px.withColumn("_i", F.row_number().over(along) - 1).withColumn("_blk", F.expr(f"_i div {k}"))
    blocks = [*FRAME, "y" if at == "x" else "x", "_blk"]
    running = (Window.unboundedPreceding, 0)
    p = p.withColumns({
        "_fwd": pick(source).over(Window.partitionBy(*blocks).orderBy(at).rowsBetween(*running)),
        "_bwd": pick(source).over(Window.partitionBy(*blocks).orderBy(F.col(at).desc()).rowsBetween(*running))})
    p = p.withColumns({
        "_lead": F.lead("_fwd", r).over(along), "_lag": F.lag("_bwd", r).over(along),
        "_end": F.max_by("_fwd", at).over(whole), "_endblk": F.max("_blk").over(whole)})
    # Past the end the window stops at the last pixel, unless it lies in one block.
    one_block = F.floor((F.col("_i") - r) / k) == F.col("_endblk")
    right = F.coalesce(F.col("_lead"), F.when(~one_block | (F.col("_i") < r), F.col("_end")))
    value = combine(F.coalesce(F.col("_lag"), right), F.coalesce(right, F.col("_lag")))
    return p.withColumn(target, value).drop("_i", "_blk", "_fwd", "_bwd", "_lead", "_lag", "_end", "_endblk")


def _rect(px: DataFrame, k: int, pick, combine) -> DataFrame:
    r = (k | 1) // 2
    out = _extreme(px, along_x(), image_row(), "x", r, pick, combine, "v", "_h")
    return _extreme(out, along_y(), image_column(), "y", r, pick, combine, "_h", "_w").withColumn("v", F.col("_w")).drop("_h", "_w")


def _ellipse(px: DataFrame, k: int, pick, combine) -> DataFrame:
    """Row maxima for each kernel width along x, then combined over shifts along y."""
    widths = ellipse_widths(k)
    r = k // 2
    across = {f"_h{w}": pick("v").over(along_x().rowsBetween(-w, w)) for w in sorted(set(widths))}
    shifted = [F.lead(f"_h{w}", dy).over(along_y()) if dy > 0 else
               F.lag(f"_h{w}", -dy).over(along_y()) if dy < 0 else F.col(f"_h{w}")
               for dy, w in zip(range(-r, k - r), widths)]
    out = px.withColumns(across)
    return out.withColumn("v", combine(*shifted) if len(shifted) > 1 else shifted[0]).drop(*across)


def dilate(px: DataFrame, k: int, shape: str = "ellipse") -> DataFrame:
    if k <= 1:
        return px
    return _ellipse(px, k, F.max, F.greatest) if shape == "ellipse" else _rect(px, k, F.max, F.greatest)


def erode(px: DataFrame, k: int, shape: str = "ellipse") -> DataFrame:
    if k <= 1:
        return px
    return _ellipse(px, k, F.min, F.least) if shape == "ellipse" else _rect(px, k, F.min, F.least)


def opened(px: DataFrame, k: int = 5, shape: str = "ellipse") -> DataFrame:
    return dilate(erode(px, k, shape), k, shape)


def closed(px: DataFrame, k: int, shape: str = "ellipse") -> DataFrame:
    return erode(dilate(px, k, shape), k, shape)


def basis_kernel(expected_radius: float) -> int:
    return max(15, int(round(expected_radius * 4.0))) | 1


def feed_mask(px: DataFrame, brightness: int = 120, expected_radius: float | None = None) -> DataFrame:
    """Bright feed surface against dark metal; with a radius, pieces on it are closed over first."""
    basis = px if expected_radius is None else closed(px, basis_kernel(expected_radius), "rect")
    return threshold(basis, F.lit(brightness))


# --- background --------------------------------------------------------------

def capture_background(px: DataFrame) -> DataFrame:
    """Empty-scene plane per line: the per-pixel median. Grey levels are few, so
    they are counted on the map side."""
    return exact_median(px, ["line_id", "x", "y"], "v").withColumnRenamed("median", "ref")


def bg_difference(px: DataFrame, reference: DataFrame, t: int = 30) -> DataFrame:
    """Pixels that differ from the reference; frames of another shape give no rows."""
    shape = [F.max("x").alias("_mx"), F.max("y").alias("_my"), F.count(F.lit(1)).alias("_n")]
    fits = px.groupBy(*FRAME).agg(*shape).join(
        reference.groupBy("line_id").agg(*shape), ["line_id", "_mx", "_my", "_n"], "left_semi").select(*FRAME)
    diff = F.abs(F.col("v") - F.col("ref"))
    return (px.join(fits, FRAME, "left_semi").join(reference, ["line_id", "x", "y"])
            .withColumn("diff", diff).where(F.col("diff") > max(1, t)).select(*PX, "v", "diff"))


# --- strips and profiles -------------------------------------------------------

def strip_occupancy(mask: DataFrame, line_x: int, half: int, limit: float = 0.12) -> DataFrame:
    """Share of set pixels in the strip, line included; an empty strip is 0 and free."""
    inside = F.col("x").between(max(0, line_x - half), line_x + half)
    share = F.avg(F.when(inside, F.when(F.col("v") > 0, 1.0).otherwise(0.0)))
    return (mask.groupBy(*FRAME).agg(F.coalesce(share, F.lit(0.0)).alias("occupancy"), F.count_if(inside).alias("_n"))
            .withColumn("occupied", (F.col("_n") > 0) & (F.col("occupancy") >= limit)).drop("_n"))


def column_profile(mask: DataFrame) -> DataFrame:
    return mask.groupBy(*FRAME, "x").agg(F.count_if(F.col("v") > 0).alias("set_pixels"))


def profile_list(mask: DataFrame) -> DataFrame:
    """The column profile of each frame as one array in the order of x."""
    columns = F.array_sort(F.collect_list(F.struct("x", "set_pixels")))
    return column_profile(mask).groupBy(*FRAME).agg(F.transform(columns, lambda c: c["set_pixels"]).alias("column_profile"))


# --- blobs -------------------------------------------------------------------

def _runs(mask: DataFrame, diagonal: bool) -> DataFrame:
    """Horizontal runs of set pixels with the runs they touch in the line above."""
    on = F.col("v") > 0
    starts = F.when(on & ~F.coalesce(F.lag(on).over(along_x()), F.lit(False)), F.col("x"))
    out = mask.withColumn("_run", F.when(on, F.last(starts, ignorenulls=True).over(
        along_x().rowsBetween(Window.unboundedPreceding, 0))))
    sides = {"_c": F.col("_run")}
    if diagonal:
        sides |= {"_l": F.lag("_run").over(along_x()), "_r": F.lead("_run").over(along_x())}
    out = out.withColumns(sides)
    above = F.array_compact(F.array(*[F.lag(s).over(along_y()) for s in sides]))
    return (out.withColumn("_above", above).where(F.col("_run").isNotNull())
            .groupBy(*FRAME, "y", F.col("_run").alias("x0"))
            .agg(F.max("x").alias("x1"), F.array_distinct(F.flatten(F.collect_list("_above"))).alias("above")))


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the touching runs of one frame at a time."""
    key, parent, runs = None, {}, []

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def table() -> pd.DataFrame:
        rows = [(*key, y, x0, x1, *root((y, x0))) for y, x0, x1 in runs]
        return pd.DataFrame(rows, columns=["line_id", "frame_id", "y", "x0", "x1", "label_y", "label_x"])

    for batch in batches:
        done = []
        for line, frame, y, x0, x1, above in zip(*[batch[c].tolist() for c in (
                "line_id", "frame_id", "y", "x0", "x1", "above")]):
            if (line, frame) != key:
                if key is not None:
                    done.append(table())
                key, parent, runs = (line, frame), {}, []
            runs.append((y, x0, x1))
            parent.setdefault((y, x0), (y, x0))
            for up in above:
                b = (y - 1, int(up))
                parent.setdefault(b, b)
                ra, rb = root((y, x0)), root(b)
                parent[max(ra, rb)] = min(ra, rb)
        if done:
            yield pd.concat(done)
    if key is not None:
        yield table()


def label_runs(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """Runs ``y, x0..x1`` with the label of their component.

    Runs and their contacts come from windows; only they, not the pixels, are
    moved, and they pass a small union-find one frame at a time. Memory is
    bounded by the runs of one image.
    """
    return (_runs(mask, diagonal).repartition(*FRAME).sortWithinPartitions(*FRAME)
            .mapInPandas(_components, "line_id long, frame_id long, y int, x0 int, x1 int, label_y int, label_x int"))


def label_blobs(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """Set pixels with their component; the label is its first pixel in reading order."""
    return label_runs(mask, diagonal).select(
        *FRAME, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "label_y", "label_x")


def with_label(labelled: DataFrame, width: int) -> DataFrame:
    return labelled.withColumn("label", (F.col("label_y") * width + F.col("label_x")).cast("long")).drop("label_y", "label_x")


def fill_holes(mask: DataFrame, k: int = 9) -> DataFrame:
    """Close, then turn background that does not reach the border into foreground."""
    base = closed(mask, k)
    flipped = base.withColumn("v", F.when(F.col("v") > 0, 0).otherwise(255))
    background = label_runs(flipped, diagonal=False)
    bounds = base.groupBy(*FRAME).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"),
                                      F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    at_edge = ((F.col("x0") == F.col("_x0")) | (F.col("x1") == F.col("_x1"))
               | (F.col("y") == F.col("_y0")) | (F.col("y") == F.col("_y1")))
    inner = (background.join(bounds, FRAME).groupBy(*FRAME, "label_y", "label_x")
             .agg(F.bool_or(at_edge).alias("_open"), F.collect_list(F.struct("y", "x0", "x1")).alias("_runs"))
             .where(~F.col("_open")).select(*FRAME, F.explode("_runs").alias("_r")))
    holes = inner.select(*FRAME, F.explode(F.sequence("_r.x0", "_r.x1")).alias("x"), F.col("_r.y").alias("y"),
                         F.lit(255).alias("_hole"))
    return base.join(holes, PX, "left").withColumn("v", F.coalesce("_hole", "v")).drop("_hole")


def run_measures(runs: DataFrame, p: Recipe) -> DataFrame:
    """Blob measures from runs, without going back to pixels."""
    return _judged(_run_sizes(runs), p)


def _run_sizes(runs: DataFrame) -> DataFrame:
    n = F.col("x1") - F.col("x0") + 1
    area = F.sum(n)
    return runs.groupBy(*FRAME, "label_y", "label_x").agg(
        F.min("x0").alias("bbox_x"), F.min("y").alias("bbox_y"),
        (F.max("x1") - F.min("x0") + 1).alias("width_px"), (F.max("y") - F.min("y") + 1).alias("height_px"),
        area.alias("area_px"), (F.sum((F.col("x0") + F.col("x1")) * n) / 2 / area).alias("cx"),
        (F.sum(F.col("y") * n) / area).alias("cy"))


def blob_measures(labelled: DataFrame, p: Recipe, keys: list[str]) -> DataFrame:
    """Box, pixel area, centre, confidence and label per blob (partial aggregation)."""
    out = labelled.groupBy(*FRAME, *keys).agg(
        F.min("x").alias("bbox_x"), F.min("y").alias("bbox_y"),
        (F.max("x") - F.min("x") + 1).alias("width_px"), (F.max("y") - F.min("y") + 1).alias("height_px"),
        F.count(F.lit(1)).alias("area_px"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return _judged(out, p)


def _judged(blobs: DataFrame, p: Recipe) -> DataFrame:
    return blobs.withColumns({"confidence": g.confidence(F.col("area_px"), p),
                              "piece": g.classify(F.col("width_px"), F.col("height_px"), p)})


def extract(px: DataFrame, p: Recipe, dark: bool = False, forced_block: int = 0, fill: int = 0,
            open_k: int = 5, dilate_k: int = 11, max_aspect: float = 0.0, max_area: float | None = None,
            max_width: int = 0) -> DataFrame:
    """Pixels to pieces: downscale, blur, threshold, fill, open, dilate, label, measure, gate.

    Frames wider than ``max_width`` (0: any width) are worked on in that width, with
    expected sizes and limits to scale; measures come back in pixels of the whole frame.
    Areas are pixel counts; hull and perimeter are not traced, so the learned
    shape gates do not apply here.
    """
    small = downscale(px, max_width) if max_width else px
    mask = auto_threshold(blur5(by_frame(small)), dark, forced_block)
    if fill:
        mask = fill_holes(mask, fill)
    blobs = _run_sizes(label_runs(dilate(opened(mask, open_k), dilate_k)))
    if max_width:
        blobs = blobs.join(frame_size(px).select(*FRAME, _scale(max_width).alias("_scale")), FRAME)
        p = _scaled(p, F.col("_scale"))
    blobs = _judged(blobs, p)
    keep = F.col("area_px") >= p["noise_threshold"] * p["expected_area_px"]
    if max_aspect > 0:
        keep = keep & (g.aspect_ratio(F.col("width_px"), F.col("height_px")) <= max_aspect)
    if max_area is not None:
        keep = keep & (F.col("area_px") <= (max_area * F.col("_scale") * F.col("_scale") if max_width else F.lit(max_area)))
    return _full_size(blobs.where(keep)) if max_width else blobs.where(keep)


def mask_stats(px: DataFrame, dark: bool = False) -> DataFrame:
    """Threshold and share of set pixels for review."""
    return _by_contrast(by_frame(px), dark, 51, -10).groupBy(*FRAME).agg(
        F.first("threshold").alias("threshold"), F.first("contrast").alias("contrast"),
        F.count_if(F.col("v") > 0).alias("set_pixels"), F.count(F.lit(1)).alias("pixels"))
