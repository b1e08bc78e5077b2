"""Toxicity by a character n-gram linear classifier scaled by naive Bayes log-count ratios.

Features are the damped counts (1 + ln n) of character n-grams (3 to 6 characters of the
lower-cased text), hashed into 2^20 buckets. Each is scaled by its naive Bayes
log-count ratio between toxic and other texts, the ``FEATURES`` buckets whose means
differ most significantly are kept, and a logistic regression is fitted on them.
A score uses nothing but the text.

Fit on a bounded sample: at most ``TRAINING_ROWS`` labelled documents, those of the
smallest hash of the doc_id. Counts are summed on the executors; what comes to the driver
is ``FEATURES`` ratios and, per sample row, the kept features it has.

Nulls and odd rows: null and empty texts get the score of no features at all; very long
texts are worked through in stretches; labels that
are null are no labels, and a doc_id with several is toxic if one says so; rows of
a repeated doc_id are scored one by one; columns other than doc_id and text are never
read. Without any labels of both kinds all scores are the share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import stored

TRAINING_ROWS = 12_000
BITS = 20
ORDERS = (3, 4, 5, 6)
FEATURES = 4096
#: Added to every count before ratios are taken.
SMOOTHING = 1.0
#: Weight of the squared weights in the loss, per sample row.
SHRINK = 1e-4
ROUNDS = 400
STRETCH = 1 << 20
_MIX = np.uint32(0x9E3779B1)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, with repeats, a stretch and order at a time."""
    text = f" {(text or '').lower()} "
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at:at + STRETCH + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        rolled = codes * np.uint32(1)
        for order in range(2, max(ORDERS) + 1):
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * _MIX + codes[order - 1:]
            if order in ORDERS and len(rolled):
                mixed = (rolled ^ np.uint32(order)) * _MIX
                yield mixed[:STRETCH] >> np.uint32(32 - BITS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different bucket numbers and their damped counts."""
    return _damped(list(grams(text)))


def _damped(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bucket, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *found]), return_counts=True)
    return bucket, 1 + np.log(n)


@dataclass(frozen=True)
class Model:
    """``weights``: a weight a bucket, zero for those not kept."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        bucket, value = _damped([found[self.weights[found] != 0] for found in grams(text)])
        z = self.bias + float(self.weights[bucket].astype(np.float64) @ value)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt; the rest is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """``labels``: doc_id and toxic (0 or 1), already without what is held out."""
    sample = (labels.where("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS))
    rows = stored(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
                  .repartition(8, "doc_id"), "toxic-sample")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        share = (toxic + 0.5) / (toxic + other + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))

    names = ["bucket", "rows", "squares", "in_toxic", "in_other"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, 1 << BITS))
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                bucket, value = features(text.as_py())
                sums[0, bucket] += 1
                sums[1, bucket] += value ** 2
                sums[2 if label == 1 else 3, bucket] += value
        at = np.flatnonzero(sums[0])
        for part in np.array_split(at, max(1, len(at) // 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x[part]) for x in sums)], names)

    counts = rows.select("text", "toxic").mapInArrow(
        count, "bucket long, rows double, squares double, in_toxic double, in_other double") \
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names[1:]])
    n = toxic + other
    spread = F.col("squares") / n - ((F.col("in_toxic") + F.col("in_other")) / n) ** 2
    gap = F.abs(F.col("in_toxic") / toxic - F.col("in_other") / other) / F.sqrt(spread + 1e-9)
    best = counts.where("rows >= 3").withColumn("gap", F.round(gap, 9)).orderBy(F.desc("gap"), "bucket").limit(FEATURES).collect()
    at = np.array([r["bucket"] for r in best], np.int64)
    p, q = (np.array([r[c] for r in best], float) for c in ("in_toxic", "in_other"))
    ratio = np.log((p + SMOOTHING) / (toxic + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (other + 2 * SMOOTHING))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[at] = np.arange(len(at))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for text in batch.column(0):
                bucket, value = features(text.as_py())
                on = slot[bucket] >= 0
                slots.append(slot[bucket[on]].tobytes())
                values.append(value[on].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
                                             ["toxic", "slots", "values"])

    got = rows.select("text", "toxic").mapInArrow(keep, "toxic int, slots binary, values binary").collect()
    got.sort(key=lambda r: (r["toxic"], r["slots"], r["values"]))
    sizes = [len(r["slots"]) // 4 for r in got]
    col = np.frombuffer(b"".join(r["slots"] for r in got), np.int32)
    value = np.frombuffer(b"".join(r["values"] for r in got), np.float32) * ratio[col]
    solved, bias = _regress(np.repeat(np.arange(len(got)), sizes), col, value, np.array([r["toxic"] == 1 for r in got], float), len(ratio))
    weights = np.zeros(1 << BITS, np.float32)
    weights[at] = solved * ratio
    return Model(weights, bias)


def _regress(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over the whole sample, given as (row, column, value)."""
    w = np.zeros(width + 1)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for k in range(1, ROUNDS + 1):
        z = np.bincount(row, w[col] * value, len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        slope = np.append(np.bincount(col, error[row] * value, width), error.sum())
        slope[:-1] += SHRINK * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        w -= 0.05 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return w[:-1], float(w[-1])


def scored(documents: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of the documents (among them text, if wanted) and their score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the corpus
    rows = documents.select(F.col("text").alias("_text"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([shared.value.score(t.as_py()) for t in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], score], [*columns, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, score double")
