"""Tables written and emptied between steps, table reading and ordered slabs."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewatch.sources.shared import scratch

__all__ = ["stored", "emptied", "scratch", "table", "ranked_before"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: what follows survives lost
    executors without repeating the work, and lineage is cut."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Give back the disk of tables that ``stored`` wrote and nothing reads any more: no rows
    are left in their folders. Only for tables whose every reader is stored itself."""
    for df in tables:
        for folder in {unquote(f.rsplit("/", 1)[0]) for f in df.inputFiles()}:
            df.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(folder)


def ranked_before(keys: DataFrame, order: Sequence[str], give: Sequence[str], wrap: bool) -> DataFrame:
    """Add ``before``, a struct of the ``give`` columns of the row before each row in
    descending order of ``order`` (nulls last). ``wrap``: the last row stands before the first.

    Rows are dealt by range, so each slab is one stretch of the order; a window
    looks back inside slabs, and the last row of each slab (one row a slab) is
    handed to the next one.
    """
    falling = [F.desc_nulls_last(c) for c in order]
    dealt = stored(keys.repartitionByRange(*falling).withColumn("slab", F.spark_partition_id()), "slabs")
    row = F.struct(*give)
    marked = dealt.withColumn("inner", F.lag(row).over(Window.partitionBy("slab").orderBy(*falling)))
    ends = dealt.groupBy("slab").agg(F.min(F.struct(*order, row.alias("row"))).alias("end"))
    slabs = Window.orderBy("slab")
    whole = slabs.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = stored(ends.select("slab", F.lag("end.row").over(slabs).alias("outer"),
                                 F.last("end.row").over(whole).alias("final")), "ends")
    outer = F.coalesce("outer", "final") if wrap else F.col("outer")
    return (marked.join(carried, "slab", "left")
            .withColumn("before", F.coalesce("inner", outer)).drop("slab", "inner", "outer", "final"))
