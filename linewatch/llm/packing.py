"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its own pieces best-fit, longest first, and its bins are then
items of the next round. A bin is emitted at once where it is nearly full (its room is at most
``1 - FULL`` of the capacity, which is the most that this rule loses) or where its room is smaller
than the smallest bin left, so that nothing could go into it. The
others (few, as a partition keeps at most one bin under half) meet in groups and are packed
best-fit again, each round in an eighth (``FAN_IN``) of the groups before. Bins are dealt to groups
by a hash, so every group has bins of all sizes, and there are always enough groups that none
expects more than ``GROUP_ROWS`` bins. The rounds end with one group, or, where the bins left are
too many for one, when a round has made fewer than one in fifty of them go. What
goes up the tree is a bin's number and size, never ids or texts.

Nulls and odd rows: null texts count as empty (one piece, the end id alone);
rows with null or repeated doc_ids are documents of their own, told apart by where
they were read; equal lengths go in any order; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import stored
from linewatch.llm.tokens import encoder

CAPACITY = 4096
#: Groups that meet in one group of the next round.
FAN_IN = 8
#: A bin with this share of its capacity filled is emitted.
FULL = 0.998
#: Bins that a group expects at most.
GROUP_ROWS = 500_000


def pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encode texts, append ``end_id`` and cut what is longer than ``capacity``:
    doc_id, piece, start, length, ids_crc32."""
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            texts = (text.as_py() for text in batch.column(1))
            for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode_all(texts), strict=True):
                ids = np.append(found, np.asarray(end_id, enc.dtype)).astype("<u4")
                rows += [(doc_id, k, at, len(part := ids[at:at + capacity]), zlib.crc32(part.tobytes()))
                         for k, at in enumerate(range(0, len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    return documents.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: longest first, into the
    bin with the least room that is enough. Bins are kept by their room."""
    place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            of = by_room[room]
            b = of.pop()
            if not of:
                del by_room[room], rooms[k]
        else:
            b, room, bins = bins, capacity, bins + 1
        place[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return place, offset, bins


def pack(items: DataFrame, capacity: int = CAPACITY, full: float = FULL, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to items with a ``length`` of 1 to
    ``capacity``. ``items`` should be a stored table: it is read once, and equal
    partitions must come back if a task runs again."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if frames:
            rows = pd.concat(frames, ignore_index=True)
            place, offset, _ = best_fit(rows["length"].to_numpy(), capacity)
            rows["bin"] = (rows.pop("_part").to_numpy() << 33) + place
            rows["offset"] = offset
            yield rows

    first = stored(items.withColumn("_part", F.spark_partition_id().cast("long"))
                   .mapInPandas(local, f"{fields}, bin long, offset long"), "packed")
    left = first.groupBy("bin").agg(F.sum("length").alias("size")).where(F.col("size") < full * capacity)
    left = stored(left, "bins")
    groups = left.select(F.expr("shiftright(bin, 33)")).distinct().count()
    moved, before, turn = None, None, 0
    while groups > 1:
        smallest, count = left.agg(F.min("size"), F.count("*")).first()
        enough = -(-count // group_rows)
        groups = max(-(-groups // FAN_IN), enough)
        if count < 2 or before is not None and groups == enough > 1 and count > 0.98 * before:
            break
        before, turn = count, turn + 1
        left = left.where(F.lit(capacity) - F.col("size") >= smallest)

        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("bin", ignore_index=True)
            place, offset, bins = best_fit(rows["size"].to_numpy(), capacity)
            size = np.bincount(place, rows["size"], bins).astype(np.int64)
            into = np.zeros(bins, np.int64)
            into[place[offset == 0]] = rows["bin"].to_numpy()[offset == 0]  # a bin keeps the name of what lies first
            return pd.DataFrame({"bin": rows["bin"], "into": into[place], "moved_by": offset, "size": size[place]})

        dealt = left.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        merged = stored(dealt.groupBy("group").applyInPandas(
            merge, "bin long, into long, moved_by long, size long"), "merged")
        left = merged.groupBy("into").agg(F.first("size").alias("size")) \
            .where(F.col("size") < full * capacity).withColumnRenamed("into", "bin")
        steps = merged.select("bin", "into", "moved_by")
        if moved is None:
            moved = steps
        else:
            later = steps.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("moved_by").alias("more"))
            moved = stored(moved.join(later, "into", "left").select(
                "bin", F.coalesce("to", "into").alias("into"),
                (F.col("moved_by") + F.coalesce("more", F.lit(0))).alias("moved_by")), "moved")
    if moved is None:
        return first.withColumnRenamed("bin", "sequence_id")
    moved = moved.where("bin <> into")
    return first.join(moved, "bin", "left").select(
        *[F.col(f"`{f.name}`") for f in items.schema], F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("moved_by", F.lit(0))).alias("offset"))


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(pieces(documents, tokenizer, end_id, capacity), "pieces"), capacity)
