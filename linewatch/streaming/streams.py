"""Structured Streaming forms: sources, windowed aggregates, sinks, listeners."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

log = logging.getLogger(__name__)


#: Event time of the row that closes a source; its watermark lets every window and slot go.
END = "2200-01-01 00:00:00"
ROWS_A_FILE = 100_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(df: DataFrame, path: str, parts: int = 4, by: str = "t_ms", closed: bool = True, files: int | None = None) -> int:
    """Write a history as it would arrive: ``parts`` folders one after the other, each an equal stretch of the
    time of arrival ``by`` (milliseconds); event time is ``t_ms``. ``closed`` adds a last file with one empty row
    at ``END``: it ends the source, so that whatever waits for the watermark comes out. Every part has the same number of
    files, ``files`` or one for some ``ROWS_A_FILE``, which is returned: a source that takes that many files a
    batch takes whole parts. A batch that ended inside a part would make the rest of the part late."""
    spark, whole = df.sparkSession, f"{path}-whole"
    df.write.parquet(whole)  # the history is worked out once, not once a part
    history = spark.read.schema(df.schema).parquet(whole)
    lo, hi, n = history.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    files = max(1, n // (parts * ROWS_A_FILE)) if files is None else files
    stamped = history.withColumn("ts", F.timestamp_millis("t_ms"))
    for i in range(parts if lo is not None else 0):
        rows, folder = stamped.where(F.expr(f"(`{by}` - {lo}) * {parts} div {hi + 1 - lo} = {i}")), f"{path}/part={i:06d}"
        rows.repartition(files).write.mode("append").parquet(folder)
        for _ in range(files - len(spark.read.schema(stamped.schema).parquet(folder).inputFiles())):
            rows.limit(0).write.mode("append").parquet(folder)  # no file comes from a task without rows
    if closed:
        row = spark.range(0, 1, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields],
                                    F.lit(END).cast("timestamp").alias("ts"))
        row.write.mode("append").parquet(f"{path}/part={parts:06d}")
    return files


def opened(spark: SparkSession, schema: StructType, path: str, late: str = "10 minutes", **admission) -> DataFrame:
    """Stream of a folder written by ``arrivals``, oldest files first, with its watermark; the closing row moves the
    watermark and is cut off behind it. ``admission``: ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``,
    which bound what a batch takes; the rest waits in the source."""
    whole = StructType([*schema.fields, StructField("ts", TimestampType())])
    reader = spark.readStream.schema(whole).option("recursiveFileLookup", True)
    for name, limit in (admission or {"maxFilesPerTrigger": 64}).items():
        reader = reader.option(name, limit)
    ended = F.col("ts") < F.lit(END).cast("timestamp")
    # Conditions on these columns depend on the event time, so they stay above the watermark and the closing row reaches it.
    rows = reader.parquet(path).withWatermark("ts", late).where(ended)
    return rows.select(*[F.when(ended, F.col(c)).alias(c) for c in schema.names], "ts")


def deduplicated(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Second deliveries within the watermark are dropped; later stragglers too."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def perf(df: DataFrame, every: str = "1 second") -> DataFrame:
    return (df.groupBy("line_id", F.window("ts", every).alias("w"))
            .agg(F.count(F.lit(1)).alias("frames"), F.avg("total_ms").alias("mean_ms"),
                 F.max("total_ms").alias("max_ms"), F.count_if("detected").alias("detections"))
            .select("line_id", F.unix_millis("w.start").alias("start_ms"), "frames", "mean_ms", "max_ms", "detections"))


def drops(df: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Dropped frames per window; ``dropped`` is counted at the source."""
    return (df.groupBy("line_id", F.window("ts", every).alias("w"))
            .agg(F.count(F.lit(1)).alias("frames"), F.sum("dropped").alias("dropped"))
            .select("line_id", F.unix_millis("w.start").alias("start_ms"), "frames", "dropped"))


def fault_rate(df: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    return (df.groupBy("line_id", F.window("ts", length, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("frames"), F.count_if("fault").alias("faults"))
            .select("line_id", F.unix_millis("w.start").alias("start_ms"), "frames", "faults",
                    (F.col("faults") / F.col("frames") * 100).alias("fault_rate")))


def sessions(df: DataFrame, gap: str) -> DataFrame:
    return (df.where("running").groupBy("line_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("line_id", F.unix_millis("w.start").alias("start_ms"),
                    F.unix_millis("w.end").alias("end_ms"), "rows"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed processors need, in no more partitions than
    run side by side: every partition opens, commits and uploads its store in every batch, also without rows, which costs
    more than the rows of a small batch. A checkpoint keeps the number it was started with."""
    partitions = min(int(spark.conf.get(PARTITIONS)), max(2, spark.sparkContext.defaultParallelism))
    settings = {PROVIDER: ROCKSDB, PARTITIONS: str(partitions)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_to_table(df: DataFrame, path: str, checkpoint: str, progress: list | None = None) -> None:
    """Work off what is available into a table that only grows: the file sink commits each batch once, and
    aggregates come out when the watermark has passed them, so their state is freed. ``progress`` gets the
    progress of every batch."""
    with keyed_state(df.sparkSession):
        query = (df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
                 .outputMode("append").format("parquet").start(path))
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress


def upsert_sink(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Changed rows of an aggregate in update mode. Every batch owns the folder of its number and replaces it
    as a whole, so a repeated batch leaves the same rows; ``upserted`` reads the newest row of each key."""
    def deliver(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with keyed_state(df.sparkSession):
        return (df.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
                .outputMode("update").foreachBatch(deliver).start())


def upserted(spark: SparkSession, schema: StructType, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key: highest batch number, found by a partial aggregate before the shuffle."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in schema.names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in schema.names])


def admitted(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Count what each batch of a bounded source takes, one row a batch."""
    def count(batch: DataFrame, number: int) -> None:
        batch.agg(F.lit(number).cast("long").alias("batch"), F.count(F.lit(1)).alias("taken")).write.mode("overwrite").parquet(f"{path}/no={number}")

    return (df.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(count).start())


def admissions(spark: SparkSession, path: str) -> DataFrame:
    """Per batch: rows ``taken`` and rows that still waited in the source, out of all that came."""
    rows = spark.read.schema("batch long, taken long").parquet(f"{path}/no=*")
    upto = Window.orderBy("batch")  # one row a batch
    return rows.select("batch", "taken", (F.sum("taken").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                                          - F.sum("taken").over(upto)).alias("waiting"))


def command_sink(df: DataFrame, path: str, checkpoint: str, event_time: str | None = None, **trigger) -> StreamingQuery:
    """Commands at most once per transition.

    Each batch owns the folder of its number, so a repeated batch replaces its
    own rows; inside a batch ``(line_id, seq, command)`` is unique. With the column
    ``event_time``, which needs a watermark and is not written, it is unique over all
    batches within that watermark.
    """
    if event_time is not None:
        df = df.dropDuplicatesWithinWatermark(["line_id", "seq", "command"]).drop(event_time)

    def deliver(batch: DataFrame, number: int) -> None:
        (batch.dropDuplicates(["line_id", "seq", "command"])
         .write.mode("overwrite").parquet(f"{path}/batch={number}"))

    return (df.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(deliver).start())


class StateChanges:
    """Listeners on state changes; one that fails does not stop the others."""

    def __init__(self) -> None:
        self._listeners: list[Callable[[DataFrame], None]] = []
        self.failures: list[str] = []

    def on_change(self, listener: Callable[[DataFrame], None]) -> None:
        self._listeners.append(listener)

    def notify(self, changes: DataFrame, number: int = 0) -> None:
        """Hand the changes of a batch to every listener, as a DataFrame."""
        for listener in self._listeners:
            try:
                listener(changes)
            except Exception as e:  # noqa: BLE001 - isolation is the contract
                self.failures.append(f"batch {number}: {e}")
                log.warning("state listener failed in batch %s", number, exc_info=True)

    def attach(self, df: DataFrame, checkpoint: str) -> StreamingQuery:
        return (df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
                .foreachBatch(self.notify).start())
