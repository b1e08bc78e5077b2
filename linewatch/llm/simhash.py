"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit k is one if it is one in over half of the XXH64
hashes of the document's word shingles. Fingerprints link at ``DISTANCE`` (2) or
fewer differing bits. The index cuts them into two segments of 32 bits: of two
linked fingerprints either the upper segments differ in at most one bit or the
lower ones are equal, so a search looks up the ball of radius 1 around its upper
segment and of radius 0 around its lower one. Of two upper segments that differ in one bit
one has that bit clear, so only balls of cleared bits are enumerated.
Matches are verified over all 64 bits.

Where more than ``CROWD`` different fingerprints share a segment (large groups of
near copies), all matches would grow with the square of the group. There the
ball of radius 1 of the *other* segment is enumerated too: linked fingerprints of
the crowd meet in at least one common point, those that meet in a point (66 at
most) differ by at most two bits, and each links to the least of them. That loses no
connection and emits a bounded number of rows a fingerprint.

Nulls and odd rows: null and blank texts have fingerprint zero, linked like any
other; a text of fewer words than a shingle is one shingle; very long texts are
worked through in stretches; repeated rows share a fingerprint; rows with a null
doc_id get a component too, whose id is null only if it holds no other row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import stored
from linewatch.llm.components import components

DISTANCE = 2
CROWD = 16
SEED = 42
#: Words hashed at once.
STRETCH = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """As a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    for at in range(0, max(1, len(words) - width + 1), STRETCH):
        part = words[at:at + STRETCH + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(part) >= width else [b" ".join(part)]
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
        total += len(digests)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (a long whose bits are the fingerprint) and the columns ``keep`` per row."""
    rows = documents.select("text", "doc_id", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.int64())], ["doc_id", *keep, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, fp long")


def _upper(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def _lower(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def _flips(segment: Column) -> Column:
    """The segment with each of its 32 bits turned in turn."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: segment.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))


def _index(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("segment"), _upper(F.col("fp")).alias("key")),
        F.struct(F.lit(1).alias("segment"), _lower(F.col("fp")).alias("key")))).alias("_")).select("fp", "_.*")


def _balls(fps: DataFrame) -> DataFrame:
    """What is looked up: both segments as they are, and the upper one with each set bit cleared."""
    upper = _upper(F.col("fp"))
    cleared = F.filter(_flips(upper), lambda s: s < upper)
    look = lambda segment, key, turned: F.struct(
        F.lit(segment).alias("segment"), key.alias("key"), F.lit(turned).alias("turned"))
    return fps.select("fp", F.explode(F.concat(
        F.array(look(0, upper, False), look(1, _lower(F.col("fp")), False)),
        F.transform(cleared, lambda s: look(0, s, True)))).alias("_")).select("fp", "_.*")


def links(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints ``fp``, enough of them that
    every two at ``DISTANCE`` or less are connected."""
    index = _index(fps)
    crowded = stored(index.groupBy("segment", "key").count().where(F.col("count") > CROWD).select("segment", "key"), "crowds")
    balls = stored(_balls(fps), "balls")
    calm = index.join(crowded, ["segment", "key"], "left_anti").select("segment", "key", F.col("fp").alias("b"))
    found = (balls.withColumnRenamed("fp", "a").join(calm, ["segment", "key"])
             .where(F.col("turned") | (F.col("a") < F.col("b"))).select("a", "b"))
    upper, lower = _upper(F.col("fp")), _lower(F.col("fp"))
    other = F.when(F.col("segment") == 0, lower).otherwise(upper)
    members = balls.join(crowded, ["segment", "key"], "left_semi")
    met = members.select("fp", "segment", "key", F.explode(F.when(F.col("turned"), F.array(other)).otherwise(
        F.concat(F.array(other), _flips(other)))).alias("point"))
    least = F.min("fp").over(Window.partitionBy("segment", "key", "point"))
    stars = met.withColumn("b", least).where("fp <> b").select(F.col("fp").alias("a"), "b")
    both = found.unionByName(stars)
    return both.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).distinct()


def near_duplicates(documents: DataFrame, width: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable), component (the least
    fingerprint of it) and the columns ``keep`` per row."""
    docs = stored(fingerprints(documents, width, keep), "fingerprints")
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(heads, "root").select("fp", "component_id", F.col("root").alias("component")), "components")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id", "component", *keep)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
