"""Grouping pieces into physical rows.

Windows are partitioned by frame. A frame is one image, so its piece count is
bounded by image area over piece area, however long the history grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from linewatch import fixed
from linewatch.functions import geometry as g
from linewatch.functions.recipe import Recipe
from linewatch.sources.tables import FRAME


def edge_of() -> Column:
    return g.leading_edge(F.col("cx"), F.col("width_px"), F.col("height_px"))


def diameter_of() -> Column:
    return g.piece_diameter(F.col("width_px"), F.col("height_px"))


def by_frame() -> WindowSpec:
    return Window.partitionBy(*FRAME)


def _islands(df: DataFrame, position: Column, gap: Column) -> DataFrame:
    """Number rows front-first; a step larger than ``gap`` starts the next row."""
    front_first = by_frame().orderBy("edge", "det_id")
    return (df.withColumn("edge", position)
            .withColumn("_limit", gap)
            .withColumn("gap_px", F.col("edge") - F.lag("edge").over(front_first))
            .withColumn("row_id", F.sum(F.when(F.col("gap_px") > F.col("_limit"), 1).otherwise(0))
                        .over(front_first.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
            .drop("_limit"))


def group_by_gap(df: DataFrame, gap: float) -> DataFrame:
    return _islands(df, edge_of(), F.lit(float(gap)))


def median_gap(factor: float) -> Column:
    median = F.coalesce(F.median(diameter_of()).over(by_frame()), F.lit(0.0))
    return F.greatest(median * F.lit(factor), F.lit(fixed.MIN_GAP_PX))


def group_rows(df: DataFrame, factor: float = fixed.ROW_GAP_DIAMETERS) -> DataFrame:
    """Split distance follows the median piece diameter of the frame."""
    return _islands(df, edge_of(), median_gap(factor))


def group_into_rows(df: DataFrame, factor: float = fixed.ROW_GAP_DIAMETERS) -> DataFrame:
    """One row line per physical row: the median centre along travel."""
    rows = _islands(df, F.col("cx"), median_gap(factor))
    return rows.groupBy(*FRAME, "row_id").agg(F.median("edge").alias("row_x"),
                                              F.count(F.lit(1)).alias("pieces"))


def row_line(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FRAME, "row_id").agg(
        F.median("edge").alias("row_edge"), F.min("edge").alias("front_edge"),
        F.count(F.lit(1)).alias("pieces"))


def reject_outliers(rows: DataFrame, columns: int,
                    limit: float = fixed.OUTLIER_DISTANCE_PX) -> DataFrame:
    """Mark pieces far from the median of the *other* pieces of their row.

    The median without the piece of rank k needs only four order statistics of
    the row, so no pairs are formed.
    """
    row = Window.partitionBy(*FRAME, "row_id")
    ranked = rows.withColumns({
        "_k": F.row_number().over(row.orderBy("edge", "det_id")) - 1,
        "_n": F.count(F.lit(1)).over(row),
        "_rows": F.max("row_id").over(by_frame()) + 1})
    low, high = F.expr("(_n - 2) div 2"), F.expr("(_n - 1) div 2")

    def stat(index: Column) -> Column:
        return F.max(F.when(F.col("_k") == index, F.col("edge"))).over(row)

    picked = ranked.withColumns({"_a0": stat(low), "_a1": stat(low + 1),
                                 "_b0": stat(high), "_b1": stat(high + 1)})
    others = (F.when(F.col("_k") > low, F.col("_a0")).otherwise(F.col("_a1"))
              + F.when(F.col("_k") > high, F.col("_b0")).otherwise(F.col("_b1"))) / 2.0
    overfull = (F.col("_n") > columns) & (F.col("_n") >= 2) & (F.col("_rows") > 1)
    return (picked.withColumn("others_median", F.when(F.col("_n") >= 2, others))
            .withColumn("rejected", F.coalesce(
                overfull & (F.abs(F.col("edge") - F.col("others_median")) > limit), F.lit(False)))
            .drop("_k", "_n", "_rows", "_a0", "_a1", "_b0", "_b1"))


def front_row(df: DataFrame, n: int) -> DataFrame:
    ranked = df.withColumn("edge", edge_of())
    if n <= 0:
        return ranked
    rank = F.row_number().over(by_frame().orderBy("edge", "det_id"))
    return ranked.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def newest_row(df: DataFrame, p: Recipe, reach: Column | None = None) -> DataFrame:
    """Pieces in the band behind the largest centre of the frame; ``reach`` is that
    centre where the rows already carry it."""
    furthest = F.max("cx").over(by_frame()) if reach is None else reach
    behind = furthest - p["expected_width_px"] * F.lit(fixed.NEWEST_ROW_BAND)
    return df.withColumn("_behind", behind).where(F.col("cx") >= F.col("_behind")).drop("_behind")


def column_index(y: Column, bands: Sequence[tuple[float, float]]) -> Column:
    """First band that holds ``y``; else the nearest centre, lowest index on ties."""
    if not bands:
        return F.lit(-1)
    inside = F.coalesce(*[F.when((y >= lo) & (y < hi), i) for i, (lo, hi) in enumerate(bands)])
    nearest = F.least(*[F.struct(F.abs(F.lit((lo + hi) / 2.0) - y).alias("d"), F.lit(i).alias("i"))
                        for i, (lo, hi) in enumerate(bands)])["i"]
    return F.coalesce(inside, nearest)


def assign_column(df: DataFrame, bands: Sequence[tuple[float, float]]) -> DataFrame:
    return df.withColumn("col", column_index(F.col("cy"), bands)).where(F.col("col") >= 0)


def rank_in_column(df: DataFrame) -> DataFrame:
    order = Window.partitionBy(*FRAME, "col").orderBy("edge", "det_id")
    return df.withColumn("edge", edge_of()).withColumn("rank", F.row_number().over(order) - 1)


def build_front_row(df: DataFrame, pointers: Sequence[int]) -> DataFrame:
    """Next piece of every column. ``df`` carries ``col``; pointers are 0-based.

    One row per frame with pieces: used columns, front tangent, any column empty.
    """
    want = F.coalesce(*[F.when(F.col("col") == i, k) for i, k in enumerate(pointers)])
    hit = F.col("rank") == want
    return (rank_in_column(df).groupBy(*FRAME)
            .agg(F.count_if(hit).alias("columns_used"),
                 F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("col")))), ",").alias("used"),
                 F.min(F.when(hit, F.col("edge"))).alias("tangent"))
            .withColumn("any_column_empty", F.col("columns_used") < len(pointers)))


def match_tolerance(lines: DataFrame, factor: float = fixed.MATCH_TOLERANCE) -> DataFrame:
    """Share of the median spacing between row lines; unlimited below two rows."""
    step = F.col("row_x") - F.lag("row_x").over(by_frame().orderBy("row_x", "row_id"))
    spacing = (lines.withColumn("_step", step).groupBy(*FRAME)
               .agg(F.median("_step").alias("spacing_px"), F.count(F.lit(1)).alias("rows")))
    return spacing.withColumn("tolerance_px", F.when(F.col("spacing_px").isNull(), F.lit(float("inf")))
                              .otherwise(F.greatest(F.col("spacing_px") * factor, F.lit(fixed.MIN_GAP_PX))))


def row_histogram(df: DataFrame, n_columns: int) -> DataFrame:
    return (df.groupBy(*FRAME).pivot("col", list(range(n_columns)))
            .agg(F.count(F.lit(1))).na.fill(0)
            .select(*FRAME, *[F.col(str(i)).alias(f"col_{i}") for i in range(n_columns)]))
