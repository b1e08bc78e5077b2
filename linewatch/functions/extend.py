"""Extension points: detectors, verdict rules, SQL function names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.sources.tables import FRAME

DETECTION_SCHEMA = ("line_id long, frame_id long, det_id int, x int, y int, w int, h int, cx double, cy double, "
                    "area_px long, confidence double, circularity double, solidity double")
DETECTION_FIELDS = ["x", "y", "w", "h", "cx", "cy", "area_px", "confidence", "circularity", "solidity"]
_DETECTORS: dict[str, Callable] = {}


def register_detector(name: str, fn: Callable[[dict], list[dict]]) -> None:
    """``fn`` gets one frame row as a dict (plane, size, recipe columns) and
    returns detections as dicts of ``DETECTION_FIELDS``."""
    _DETECTORS[name] = fn


def detector(name: str) -> Callable:
    if name not in _DETECTORS:
        raise KeyError(f"unknown detector {name!r}; registered: {sorted(_DETECTORS)}")
    return _DETECTORS[name]


def detect(frames: DataFrame, name: str) -> DataFrame:
    """Run a registered detector frame by frame, one Arrow batch at a time."""
    fn = detector(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for frame in batch.to_dict("records"):
                for i, found in enumerate(fn(frame)):
                    rows.append((frame["line_id"], frame["frame_id"], i, *[found.get(k) for k in DETECTION_FIELDS]))
            yield pd.DataFrame(rows, columns=["line_id", "frame_id", "det_id", *DETECTION_FIELDS])

    return frames.mapInPandas(run, DETECTION_SCHEMA)


def register_udtf(spark: SparkSession, name: str, sql_name: str) -> None:
    """The detector as a table function: ``FROM frames, LATERAL f(plane, width, height)``."""
    fn = detector(name)

    class Detect:
        def eval(self, plane, width, height):
            for i, found in enumerate(fn({"plane": plane, "width": width, "height": height})):
                yield (i, *[found.get(k) for k in DETECTION_FIELDS])

    returns = "det_id int, x int, y int, w int, h int, cx double, cy double, area_px long, confidence double, circularity double, solidity double"
    spark.udtf.register(sql_name, F.udtf(Detect, returnType=returns))


def verdict_by(rows: DataFrame, rule: Column | Callable[[pd.DataFrame], Sequence[str]], *columns: str) -> DataFrame:
    """Own verdict rule, one verdict per frame: an aggregate expression, or a Python function of ``columns``.

    The function gets the pieces of many whole frames at once, indexed by the number of their frame (from 0),
    and returns the verdicts in the order of these numbers: ``pieces.groupby(level=0)`` has the frames. A
    grouped-aggregate pandas UDF is an aggregate expression too, but Spark calls it frame by frame.
    """
    if isinstance(rule, Column):
        verdicts = rows.groupBy(*FRAME).agg(rule.alias("verdict"))
    else:
        verdicts = _frames_at_once(rows, rule, columns)
    return verdicts.withColumn("is_fault", F.col("verdict").isin(*fixed.FAULT_VERDICTS))


def _frames_at_once(rows: DataFrame, rule: Callable[[pd.DataFrame], Sequence[str]], columns: tuple[str, ...]) -> DataFrame:
    if not columns:
        raise ValueError("a rule in Python needs the columns it reads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = batch.column(2)
            number = np.repeat(np.arange(len(frames)), np.diff(frames.offsets.to_numpy()))
            pieces = pd.DataFrame({c: v.to_pandas() for c, v in zip(columns, frames.flatten().flatten(), strict=True)}).set_axis(number)
            found = list(rule(pieces)) if len(frames) else []
            if len(found) != len(frames):
                raise ValueError(f"{len(found)} verdicts for {len(frames)} frames")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], [*FRAME, "verdict"])

    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in FRAME)
    pieces = rows.groupBy(*FRAME).agg(F.collect_list(F.struct(*columns)).alias("pieces"))
    return pieces.mapInArrow(run, f"{keys}, verdict string")


_RECIPE = "ew INT, eh INT, fused DOUBLE"
SQL_FUNCTIONS = {
    "piece_diameter(w DOUBLE, h DOUBLE) RETURNS DOUBLE":
        "CASE WHEN w > 0 AND h > 0 THEN (w + h) / 2 WHEN w > 0 OR h > 0 THEN greatest(w, h) END",
    "leading_edge(cx DOUBLE, w DOUBLE, h DOUBLE) RETURNS DOUBLE":
        "cx - coalesce(piece_diameter(w, h), 0D) / 2",
    f"classify_piece(w INT, h INT, {_RECIPE}, low DOUBLE, cap DOUBLE) RETURNS STRING":
        """CASE WHEN greatest(w / greatest(ew, 1), h / greatest(eh, 1)) > cap THEN 'unknown'
           WHEN least(w / greatest(ew, 1), h / greatest(eh, 1)) >= fused THEN 'unknown'
           WHEN w / greatest(ew, 1) >= fused THEN 'row_fused' WHEN h / greatest(eh, 1) >= fused THEN 'column_fused'
           WHEN least(w / greatest(ew, 1), h / greatest(eh, 1)) < low THEN 'unknown' ELSE 'single' END""",
    "piece_confidence(area BIGINT, expected INT) RETURNS DOUBLE": "least(1D, area / greatest(expected, 1))",
    "is_fault_label(label STRING) RETURNS BOOLEAN": "label IN ('row_fused', 'unknown')",
    "is_fault_verdict(verdict STRING) RETURNS BOOLEAN": "verdict IN ('FAULT_ROW_FUSED', 'FAULT_UNKNOWN')",
    "circularity(area DOUBLE, perimeter DOUBLE) RETURNS DOUBLE":
        "CASE WHEN perimeter > 0 THEN 4 * pi() * area / (perimeter * perimeter) ELSE 0D END",
    "solidity(area DOUBLE, hull DOUBLE) RETURNS DOUBLE": "CASE WHEN hull > 0 THEN area / hull ELSE 0D END",
    "aspect_ratio(w INT, h INT) RETURNS DOUBLE": "greatest(w, h) / greatest(least(w, h), 1)",
    f"unknown_verdict(w INT, h INT, {_RECIPE}) RETURNS STRING":
        """CASE WHEN w / greatest(ew, 1) >= fused AND w / greatest(ew, 1) >= h / greatest(eh, 1)
           THEN 'FAULT_ROW_FUSED' ELSE 'INFO_UNKNOWN_NONFAULT' END""",
}


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions; Catalyst inlines them, so they cost no UDF call."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
