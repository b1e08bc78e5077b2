"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Components become whole numbers ``x = floor(1024 * c) + 100000``. Every task shifts them
to start at zero and slices them: bit ``a`` of a dimension over 64 rows is one machine
word. The sum of products of two dimensions is then the sum over pairs of their bit planes
of ``2**(a + b)`` times the ones in the AND of the planes, so a task adds up whole numbers and
nothing is rounded. Tasks hand on one row per pair of dimensions, as limbs of 32 bits that Spark
adds up. The driver gets that matrix alone (dimensions squared, whatever the number of
rows), centres it as whole numbers, ``n * sum(xy) - sum(x) * sum(y)``, and takes the
eigenvectors. Rows are whitened where they are; their covariance is measured in one more pass.

Nulls and odd rows: vectors that are null or hold null, nan or infinite components take
no part. Of vectors of different lengths the shorter ones are filled up with components of zero. Repeated
rows and repeated or null ``vec_id`` all count and all get their rows. Components without variance
(an eigenvalue that is zero within rounding) are left out, so one row, equal rows or an empty
table give no rows; there are fewer components than asked for where there are fewer dimensions.
Whole numbers beyond 2**61 are held at that. ``deviation`` is null where it is beyond a long;
``deviation_exact`` holds it up to 38 digits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
#: Whole numbers are held within this, so that differences fit a long.
FARTHEST = 2 ** 61
#: Rows sliced at once; a multiple of 64.
ROWS = 8192
LIMBS = 6
_PARTS = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double, deviation_exact decimal(38,0)")


@dataclass
class Model:
    """What whitening needs of the fit list; its size follows the dimensions alone."""
    n: int
    sums: list[int]          # of every dimension
    values: np.ndarray       # eigenvalues that count, falling
    vectors: np.ndarray      # dimensions x components
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Sums of squares of ``n * x - S``: as longs and as decimals."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        away = x - whole
        most = (max(int(away.max(initial=0)), -int(away.min(initial=0))) + 1) * self.n
        if len(self.sums) * most * most < 2 ** 63:
            rest = np.array([s % self.n for s in self.sums], np.int64)
            found = pa.array(((away * self.n - rest) ** 2).sum(1))
            return found, found.cast(pa.decimal128(38, 0))
        rest = np.array([s % self.n for s in self.sums], object)
        exact = ((away.astype(object) * self.n - rest) ** 2).sum(1).tolist()
        return (pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64()),
                pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0)))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & fine)


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows x dimensions of ``x``."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        components = values.reshape(-1, dims)
    else:
        components = np.zeros((len(lengths), dims))
        components[np.arange(dims) < lengths[:, None]] = values
    scaled = np.floor(components * SCALE)
    return np.clip(scaled, -FARTHEST, FARTHEST).astype(np.int64) + OFFSET


def planes(y: np.ndarray) -> np.ndarray:
    """Bit planes of rows x dimensions of unsigned numbers: dimensions x bits x words."""
    rows, dims = y.shape
    bits = int(y.max(initial=0)).bit_length()
    turned = np.zeros((dims, -(-rows // 64) * 64), np.uint64)
    turned[:, :rows] = y.T
    out = np.empty((dims, bits, turned.shape[1] // 64), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits((turned >> np.uint64(b)).astype(np.uint8) & 1, axis=1).view(np.uint64)
    return out


class Scatter:
    """Counts of ones: ``pairs[i, j, s]`` of ANDs of planes whose bits add up to ``s``, ``ones[i, a]`` of planes."""

    def __init__(self, dims: int, bits: int) -> None:
        self.pairs = np.zeros((dims, dims, max(2 * bits - 1, 0)), np.int64)
        self.ones = np.zeros((dims, bits), np.int64)

    def add(self, y: np.ndarray) -> None:
        sliced = planes(y)
        dims, bits, _ = sliced.shape
        self.ones[:, :bits] += np.bitwise_count(sliced).sum(2, dtype=np.int64)
        for i in range(dims):
            for a in range(bits):
                if sliced[i, a].any():
                    both = np.bitwise_count(sliced[i:] & sliced[i, a])
                    self.pairs[i, i:, a:a + bits] += both.sum(2, dtype=np.int64)

    def rows(self) -> Iterator[tuple]:
        """``(i, j, limbs...)`` for every pair of dimensions, ``j = -1`` for the plain sum."""
        dims = len(self.pairs)
        weights = [1 << s for s in range(max(self.pairs.shape[2], self.ones.shape[1]))]
        for i in range(dims):
            counted = [(-1, self.ones[i]), *((j, self.pairs[i, j]) for j in range(i, dims))]
            for j, counts in counted:
                total = sum(c * w for c, w in zip(counts.tolist(), weights, strict=False) if c)
                yield (i, j, *((total >> 32 * k) & 0xFFFFFFFF for k in range(LIMBS)))


def fit(vectors: DataFrame, most: int = 8) -> Model | None:
    """The model of all rows of ``vectors`` that take part; None if none of it varies."""
    rows = usable(vectors)
    n, dims, low, high = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n or not dims:
        return None
    ends = whole_numbers(pa.array([[min(low, 0.0), max(high, 0.0)]]), 2)[0]
    shift, bits = int(ends[0]), int(ends[1] - ends[0]).bit_length()

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Scatter(dims, bits)
        for batch in batches:
            x = whole_numbers(batch.column(0), dims)
            for at in range(0, len(x), ROWS):
                found.add((x[at:at + ROWS] - shift).astype(np.uint64))
        columns = list(zip(*found.rows(), strict=True))
        kinds = [pa.int32(), pa.int32()] + [pa.int64()] * LIMBS
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    limbs = [F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]
    summed = rows.select("v").mapInArrow(scatter, _PARTS).groupBy("i", "j").agg(*limbs).collect()
    total = {(r["i"], r["j"]): sum(r[f"l{k}"] << 32 * k for k in range(LIMBS)) for r in summed}
    sums = [total[i, -1] for i in range(dims)]
    covariance = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (n * total[i, j] - sums[i] * sums[j]) / (n * n)  # whole numbers, rounded once
    values, turned = np.linalg.eigh(covariance)
    values, turned = values[::-1], turned[:, ::-1]
    varied = values > max(values[0], 0.0) * dims * np.finfo(float).eps
    count = min(most, int(varied.sum()))
    if not count:
        return None
    return Model(n, [s + n * shift for s in sums], values[:count], np.ascontiguousarray(turned[:, :count]),
                 float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    dims, count = model.vectors.shape

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = model.whitened(whole_numbers(batch.column(0), dims))
            first, second = first + w.sum(0), second + w.T @ w
        i, j = np.divmod(np.arange(count * count), count)
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(count), i]), pa.int32()),
                                          pa.array(np.concatenate([np.full(count, -1), j]), pa.int32()), pa.array(values)],
                                         ["i", "j", "s"])

    summed = usable(vectors).select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    of = {(r["i"], r["j"]): r["s"] / model.n for r in summed.collect()}
    return max(abs(of[i, j] - of[i, -1] * of[j, -1] - (i == j)) for i in range(count) for j in range(count))


def whitened(vectors: DataFrame, most: int = 8) -> DataFrame:
    """A row per vector that takes part and component up to ``most``; see the module and ``_OUT``."""
    model = fit(vectors, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    error = identity_error(vectors, model)
    dims, count = model.vectors.shape
    explained = model.values / model.trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column(1), dims)
            each = pa.array(np.repeat(np.arange(len(x)), count))
            deviation, exact = model.deviations(x)
            total = len(x) * count
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(total, model.n)), deviation.take(each), pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(total, error)), exact.take(each)],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(rows, _OUT)
