"""Event log files: one directory per local day of CSV with eight fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch import fixed

SCHEMA = ", ".join(f"{c} STRING" for c in fixed.EVENT_COLUMNS)
CSV = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS"
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$"


def parse_iso(ts: Column) -> Column:
    """Zone-less timestamp of an ISO string with milliseconds; NULL if unreadable."""
    return F.when(ts.rlike(ISO_SHAPE), ts.try_cast("timestamp_ntz"))


def format_iso(t_ms: Column) -> Column:
    """ISO text of epoch milliseconds, independent of the session time zone."""
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (t_ms / 1000).cast("decimal(18,6)"))
    return F.date_format(at, ISO_MS)


def event_date(ts: Column) -> Column:
    return F.to_date(parse_iso(ts))


def typed(raw: DataFrame) -> DataFrame:
    """Blank means no value; a row of unknown type or unreadable time is quarantined."""
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in fixed.EVENT_COLUMNS}
    df = raw.withColumns(blank)
    ts = parse_iso(F.col("timestamp_iso"))
    known = F.col("event_type").isin(*fixed.EVENT_TYPES)
    return df.withColumns({"ts": ts, "quarantined": ~known | ts.isNull()})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Day folders are partitions, so a filter on ``event_date`` prunes files."""
    return typed(spark.read.schema(SCHEMA + ", event_date DATE").options(**CSV).csv(path))


def stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New files and new days as they appear."""
    return typed(spark.readStream.schema(SCHEMA + ", event_date DATE").options(**CSV)
                 .option("maxFilesPerTrigger", files_per_trigger).csv(path))


def write(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Append by local day. Rows are rebalanced by day: adaptive execution gives a busy day
    as many writers as its size asks for and puts small days together."""
    (df.select(*fixed.EVENT_COLUMNS).withColumn("event_date", event_date(F.col("timestamp_iso")))
     .hint("rebalance", "event_date")
     .write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").options(**CSV).csv(path))


def export(spark: SparkSession, path: str, first: str, last: str, out: str) -> DataFrame:
    """Copy the days ``first`` to ``last`` (inclusive) to ``out``."""
    days = read(spark, path).where(F.col("event_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    days.select(*fixed.EVENT_COLUMNS).write.mode("errorifexists").options(**CSV).csv(out)
    return days


def apply_retention(spark: SparkSession, path: str, days: int, today: str) -> int:
    """Drop the day folders older than ``days``; returns the rows removed.

    Works on folders: the rows are only counted, never rewritten.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    limit = F.date_sub(F.lit(today).cast("date"), days)
    old = read(spark, path).where(F.col("event_date") < limit)
    per_day = old.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    removed = per_day.collect()  # one row per expired day
    jvm = spark.sparkContext._jvm
    for row in removed:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={row['event_date'].isoformat()}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sum(r["n"] for r in removed)


def from_rows(log: DataFrame) -> DataFrame:
    """The eight text columns from the typed event table (``t_ms``, ``event_type``, ...)."""
    empty = F.lit("")
    have = {c: F.col(c) for c in log.columns}
    return log.select(
        format_iso(F.col("t_ms")).alias("timestamp_iso"),
        *[have.get(c, empty).alias(c) for c in fixed.EVENT_COLUMNS[1:]])
