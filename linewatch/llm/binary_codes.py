"""Approximate nearest neighbours by cosine: learned binary codes and multi-index hashing.

Learning. A bounded sample of ``SAMPLE`` rows (those of least hash) goes to the driver. Unit vectors
are turned by their principal directions and then by a rotation learned to lose little when
only signs are kept (alternating between signs and the best rotation towards them). The signs are a code of
``BITS`` bits; where vectors have fewer dimensions, several rotations share the bits.

Radius. A query's k-th best sample row is at an angle that none of its true k nearest rows
exceeds. ``BITS * angle / pi`` bits are expected to differ there; the sample's own nearest pairs tell how far
codes stray from that, and the quantile ``CAUGHT`` of it is added. That is the query's Hamming radius.

Search. Every row is indexed, in blocks of about ``BLOCK`` codes. A block splits its codes into substrings and
keeps a table from substring to rows for each. Two codes within a radius ``r`` agree up to ``r // m`` bits in one of
``m`` substrings (up to one less in those after the first ``r % m + 1``), so probing those small balls
fetches every code within the radius; full distances are verified, and what is left is ranked by cosine of
the original vectors in double precision. There is no cap on candidates. Queries meet blocks in groups
of ``GROUP``; a pair of a group and a block is one task of bounded size and hands on at most k rows a query.

Equal vectors are indexed once, with their k + 1 smallest ids: further copies have the same score
and larger ids, so they can't be among the k nearest.

Nulls and odd rows: vectors that are null, empty, zero or hold null, nan or infinite components and rows
without ``vec_id`` take no part; shorter vectors are filled up with zeros; of rows that repeat a ``vec_id`` the least
vector counts; ties go to the smaller ``vec_id``; other columns are ignored; without
queries or candidates the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import stored

BITS = 64
#: Rows that the codes and the radius are learned from.
SAMPLE = 8192
#: Pairs of the sample whose codes must lie within the radius.
CAUGHT = 0.98
BLOCK = 8192
GROUP = 4096
#: Bits of the substrings; about the logarithm of a block's rows.
WIDTHS = (13, 13, 13, 13, 12)
TURNS = 40


@dataclass
class Coder:
    """Directions (dimensions x BITS) whose signs are the code, and how far codes stray."""
    directions: np.ndarray
    margin: float

    def codes(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.directions > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v`` (doubles), one row a vec_id, of vectors that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def matrix(rows, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn(sample: np.ndarray, k: int, seed: int = 1) -> Coder:
    """Codes and margin from unit vectors."""
    dims = sample.shape[1]
    width = min(dims, BITS)
    _, principal = np.linalg.eigh(sample.T @ sample)
    main = principal[:, ::-1][:, :width]
    projected, chance, found = sample @ main, np.random.default_rng(seed), []
    for _ in range(-(-BITS // width)):
        rotation = np.linalg.qr(chance.normal(size=(width, width)))[0]
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(projected.T @ np.where(projected @ rotation > 0, 1.0, -1.0))
            rotation = left @ right
        found.append(main @ rotation)
    coder = Coder(np.hstack(found)[:, :BITS], 0.0)
    codes, strayed = coder.codes(sample), []
    for i in range(0, len(sample), max(1, len(sample) // 512)):
        cosines = sample @ sample[i]
        cosines[i] = -2.0
        near = np.argpartition(-cosines, min(k, len(cosines) - 1))[:k]
        near = near[near != i]
        strayed.append(np.bitwise_count(codes[near] ^ codes[i]) - BITS * np.arccos(np.clip(cosines[near], -1, 1)) / math.pi)
    strayed = np.concatenate(strayed) if strayed else np.zeros(0)
    coder.margin = max(0.0, float(np.quantile(strayed, CAUGHT, method="higher"))) if len(strayed) else float(BITS)
    return coder


class Tables:
    """The codes of a block with a table per substring: rows in order of the substring and where each begins."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.parts, at = codes, [], 0
        for width in WIDTHS:
            keys = self._key(codes, at, width)
            begins = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << width))])
            self.parts.append((at, width, np.argsort(keys, kind="stable"), begins))
            at += width

    @staticmethod
    def _key(codes: np.ndarray, at: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Numbers of all rows whose code differs in at most ``radius`` bits."""
        least, more = divmod(radius, len(WIDTHS))
        fetched = np.zeros(len(self.codes), bool)
        for number, (at, width, order, begins) in enumerate(self.parts):
            inner = least if number <= more else least - 1
            if inner < 0:
                continue
            keys = int(self._key(np.array([code]), at, width)[0]) ^ ball(width, inner)
            first, count = begins[keys], begins[keys + 1] - begins[keys]
            first, count = first[count > 0], count[count > 0]
            if len(count):
                places = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                fetched[order[places]] = True
        rows = np.flatnonzero(fetched)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


_SORTED: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def ball(width: int, radius: int) -> np.ndarray:
    """All words of ``width`` bits with at most ``radius`` ones."""
    if width not in _SORTED:
        words = np.arange(1 << width)
        ones = np.bitwise_count(words)
        _SORTED[width] = words[np.argsort(ones, kind="stable")], np.cumsum(np.bincount(ones, minlength=width + 1))
    words, upto = _SORTED[width]
    return words[:upto[min(radius, width)]]


def search(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for each row that meets
    ``queries``, its own row left out. ``vectors``: vec_id and embedding."""
    rows = stored(usable(vectors), "vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    known, known_ids = unit(matrix(sample["v"], dims)), sample["vec_id"].to_numpy()
    coder = learn(known, k)
    classes = stored(_classes(rows, k, coder, dims), "classes")
    blocks = max(1, math.ceil(classes.count() / BLOCK))
    asked = rows.where(queries)
    groups = max(1, math.ceil(asked.count() / GROUP))

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = unit(matrix(batch.column(1).to_numpy(zero_copy_only=False), dims))
            cosines = own @ known.T
            cosines[ids[:, None] == known_ids] = -2.0
            if len(known) > k:
                kth = -np.partition(-cosines, k - 1, axis=1)[:, k - 1]
                reach = np.floor(BITS * np.arccos(np.clip(kth, -1, 1)) / math.pi + coder.margin)
            else:
                reach = np.full(len(ids), BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coder.codes(own).view(np.int64)),
                                              pa.array(np.minimum(reach, BITS).astype(np.int32))], ["vec_id", "v", "code", "radius"])

    met = asked.select("vec_id", "v").mapInArrow(radii, "vec_id long, v array<double>, code long, radius int")
    right = met.select("*", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("part"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left = classes.select("*", F.pmod(F.xxhash64("first"), F.lit(blocks)).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def meet(index: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(index) and len(asks):
            vectors, ids = scaled(matrix(index["v"], dims)), index["ids"].tolist()
            norms = np.sqrt((vectors * vectors).sum(1))
            tables = Tables(index["code"].to_numpy().view(np.uint64))
            wanted = scaled(matrix(asks["v"], dims))
            codes = asks["code"].to_numpy().view(np.uint64)
            for query, own, code, radius in zip(asks["vec_id"].tolist(), wanted, codes, asks["radius"].tolist(), strict=True):
                near = tables.within(code, radius)
                scores = vectors[near] @ own / (norms[near] * np.sqrt(own @ own))
                found += _best(query, near, scores, ids, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    pairs = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(query: int, near: np.ndarray, scores: np.ndarray, ids: list, k: int) -> list[tuple]:
    """The k best rows of the classes ``near``: at most k classes and the query's own can hold them,
    and those tied with the last of them."""
    if len(scores) > k + 1:
        kept = np.flatnonzero(scores >= -np.partition(-scores, k)[k])
        near, scores = near[kept], scores[kept]
    rows = [(query, i, s) for c, s in zip(near.tolist(), scores.tolist(), strict=True) for i in ids[c] if i != query]
    return sorted(rows, key=lambda r: (-r[2], r[1]))[:k]


def _classes(rows: DataFrame, k: int, coder: Coder, dims: int) -> DataFrame:
    """Each different vector once: ``v``, its ``code``, its k + 1 smallest ``ids`` and the ``first`` of them."""
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("first"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = coder.codes(unit(matrix(batch.column(0).to_numpy(zero_copy_only=False), dims)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], ["v", "ids", "first", "code"])

    return classes.mapInArrow(coded, "v array<double>, ids array<long>, first long, code long")
