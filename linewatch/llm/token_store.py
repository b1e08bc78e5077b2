"""Token-id files: every document is its own zstandard frame, compressed with one
shared dictionary trained on serialized id arrays.

Layout of a store::

    dictionary.parquet   one row: sha256 of the dictionary, its bytes, bytes an id
    index.parquet        a row per document: doc_id, shard, offset, size, n_tokens,
                         ahead (ids before it in its shard), dictionary (sha256)
    starts.parquet       a row per shard: ids before the shard
    shards/*.ids         frames one after another, in ascending doc_id order

A document is read by its index row alone: one range of one shard and the
dictionary. Shard names carry a fresh id per attempt and the index names the
shard that counts, so a task that ran twice leaves at most an unused file.

Nulls and odd rows: null texts count as empty (a frame of the end id alone); null
doc_ids come first; repeated doc_ids are documents of their own, in any order;
other columns are ignored. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewatch.llm.tokens import encoder

#: Documents whose ids train the dictionary, at most (those of the smallest hashes).
TRAINING_DOCUMENTS = 2000
#: Ids of one training document used, at most. Only the dictionary's sample is cut; files hold all ids.
TRAINING_IDS = 4096
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
INDEX = "doc_id long, shard string, offset long, size long, n_tokens long, ahead long, dictionary string"


@dataclass(frozen=True)
class Dictionary:
    data: bytes
    sha256: str


def train(documents: DataFrame, tokenizer: str) -> Dictionary:
    """Train the shared dictionary on the documents with the smallest id hashes. A
    corpus too small for training gets a raw-content dictionary of its samples."""
    chosen = (documents.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id")
              .limit(TRAINING_DOCUMENTS).select("doc_id").distinct())
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            found = [enc.encode(t)[:TRAINING_IDS].tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f for f in found if f], pa.binary())], ["ids"])

    samples = sorted(r[0] for r in rows.select("text").mapInArrow(ids, "ids binary").orderBy("ids").limit(TRAINING_DOCUMENTS).collect())
    try:
        data = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        data = b"".join(samples)[:DICTIONARY_BYTES]
    return Dictionary(bytes(data), hashlib.sha256(data).hexdigest())


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every text, append ``end_id`` and write the store below ``path``, a
    folder that all executors reach by its URI."""
    spark = documents.sparkSession
    shared = train(documents, tokenizer)
    width = encoder(tokenizer).dtype.itemsize
    spark.createDataFrame([(shared.sha256, bytearray(shared.data), width)], "sha256 string, data binary, width int") \
        .coalesce(1).write.parquet(f"{path}/dictionary.parquet")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(f"{path}/shards")
        fs.create_dir(folder, recursive=True)
        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        ready = _dictionary(shared.data)
        ready.precompute_compress(level=LEVEL)  # else every frame would digest it anew
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=ready)
        name, out, at, ahead = f"{uuid.uuid4().hex}.ids", None, 0, 0
        try:
            for batch in batches:
                rows = []
                texts = (text.as_py() for text in batch.column(1))
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(texts), strict=True):
                    raw = ids.tobytes() + end
                    frame = pack.compress(raw)
                    if out is None:
                        out = fs.open_output_stream(f"{folder}/{name}")
                    out.write(frame)
                    n = len(raw) // enc.dtype.itemsize
                    rows.append((doc_id, name, at, len(frame), n, ahead, shared.sha256))
                    at, ahead = at + len(frame), ahead + n
                yield _batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    ordered = (documents.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id"))
               .sortWithinPartitions(F.asc_nulls_first("doc_id")))
    ordered.mapInArrow(shards, INDEX).write.parquet(f"{path}/index.parquet")

    index = spark.read.parquet(f"{path}/index.parquet")
    totals = index.groupBy("shard").agg(
        F.sum("n_tokens").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.max(F.col("doc_id").isNull()).alias("unnamed"))
    before = Window.orderBy(F.desc("unnamed"), F.asc_nulls_first("low"), "high").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start")) \
        .write.parquet(f"{path}/starts.parquet")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
                                      [n for n, _ in fields])


def _frames(spark: SparkSession, path: str):
    """A function that turns index rows into ids, and nothing else is read."""
    row = spark.read.parquet(f"{path}/dictionary.parquet").first()
    data, sha256, kind = bytes(row["data"]), row["sha256"], {2: "<u2", 4: "<u4"}[row["width"]]

    def read(rows: Iterator[dict]) -> Iterator[tuple[dict, np.ndarray]]:
        if hashlib.sha256(data).hexdigest() != sha256:
            raise ValueError("the dictionary is not the one its hash names")
        fs, folder = pafs.FileSystem.from_uri(f"{path}/shards")
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        name, file = None, None
        for r in rows:
            if r["dictionary"] != sha256:
                raise ValueError(f"shard {r['shard']} needs dictionary {r['dictionary']}")
            if name != r["shard"]:
                if file is not None:
                    file.close()
                name, file = r["shard"], fs.open_input_file(f"{folder}/{r['shard']}")
            file.seek(r["offset"])
            yield r, np.frombuffer(unpack.decompress(file.read(r["size"])), kind)
        if file is not None:
            file.close()

    return read


def read_ids(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """doc_id and its ids; ``index``: index rows of the wanted documents (default: all)."""
    frames = _frames(spark, path)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, found in frames(batch.to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"]], pa.int64()),
                                                  pa.array([found.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    index = spark.read.parquet(f"{path}/index.parquet") if index is None else index
    return index.mapInArrow(ids, "doc_id long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Read every frame back: doc_id, start, n_tokens and the CRC-32 of its ids."""
    frames = _frames(spark, path)
    out = "doc_id long, shard string, ahead long, n_tokens long, ids_crc32 long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(r["doc_id"], r["shard"], r["ahead"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                          for r, ids in frames(batch.to_pylist())], out)

    read = spark.read.parquet(f"{path}/index.parquet").mapInArrow(digest, out)
    starts = spark.read.parquet(f"{path}/starts.parquet")
    return read.join(starts, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
