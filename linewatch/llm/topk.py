"""Exact top-k by inner product: an impact-ordered index, score at a time.

Vectors become whole numbers. The index is cut into blocks of about ``BLOCK`` vectors;
in a block every dimension has a posting list ordered by value and cut into
``SEGMENTS`` segments, whose largest value is the segment's impact. A query goes through the segments of
all dimensions by descending impact (query weight times segment bound, counted above
the least the dimension can give) and adds up scores of the vectors in them. At
``STOPS`` it bounds all scores from both sides. Vectors whose upper
bound is below the k-th best lower bound can't be members; the search stops when
few others are left, or when all is read. Those are then scored exactly.

Queries meet blocks in groups of ``GROUP`` queries; each pair of a group and a block is a
task of bounded size, and hands on at most k rows a query.

Nulls and odd rows: vectors that are null, empty or hold null, nan or infinite
components and rows without vec_id take no part; shorter vectors are filled up with zeros;
of rows that repeat a vec_id the least vector counts; ties go to the smaller vec_id;
other columns are ignored; without queries or candidates the result is empty. Scores are whole numbers
throughout: bounds are widened by what floats may lose beyond 2**53, and members are scored in longs, or beyond
those in whole numbers of any size; a score beyond a long is held at its end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import stored

BLOCK = 4096
SEGMENTS = 8
#: Queries that meet a block at once; the index travels once per group, so groups are as large as memory suits.
GROUP = 2048
#: Shares of the segments after which the search looks whether it may stop.
STOPS = (0.6, 0.8, 1.0)
#: It stops once at most one in so many vectors is left; scoring those exactly is cheap.
FEW = 2
SCALE = 1024
_INDEX = "block long, dim int, ids binary, values binary"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v`` (array of longs), one row a vec_id, of vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def build(vectors: DataFrame, dims: int, blocks: int) -> DataFrame:
    """Posting lists: a row per block and dimension with local numbers and values by
    descending value; dimension -1 has the vec_ids of the block."""

    def lists(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        values = _matrix(rows["v"], dims)
        out = [(key[0], -1, rows["vec_id"].to_numpy(np.int64).tobytes(), b"")]
        for d in range(dims):
            order = np.argsort(-values[:, d], kind="stable")
            out.append((key[0], d, order.astype(np.int32).tobytes(), values[order, d].tobytes()))
        return pd.DataFrame(out, columns=["block", "dim", "ids", "values"])

    return vectors.groupBy(_block(F.col("vec_id"), blocks).alias("block")).applyInPandas(lists, _INDEX)


def _block(vec_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(vec_id), F.lit(blocks))


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


class Block:
    """One block of the index in memory. Segments are rows of equal length, the last ones
    filled up with a number past the block's vectors and value zero."""

    def __init__(self, rows: pd.DataFrame, dims: int) -> None:
        ids = {d: i for d, i in zip(rows["dim"], rows["ids"], strict=True)}
        values = {d: v for d, v in zip(rows["dim"], rows["values"], strict=True)}
        self.vec_ids = np.frombuffer(ids[-1], np.int64)
        n = len(self.vec_ids)
        order = np.stack([np.frombuffer(ids[d], np.int32) for d in range(dims)])
        falling = np.stack([np.frombuffer(values[d], np.int64) for d in range(dims)])
        self.vectors = np.empty((n, dims), np.int64)
        self.rank = np.empty((dims, n), np.int32)
        for d in range(dims):
            self.vectors[order[d], d] = falling[d]
            self.rank[d, order[d]] = np.arange(n)
        self.length = -(-n // SEGMENTS)
        self.steps = -(-n // self.length)
        fill = self.steps * self.length - n
        shape = (dims, self.steps, self.length)
        self.ids = np.pad(order, ((0, 0), (0, fill)), constant_values=n).astype(np.intp).reshape(shape)
        self.values = np.pad(falling, ((0, 0), (0, fill))).astype(float).reshape(shape)
        starts = np.arange(self.steps) * self.length
        self.largest = falling[:, starts].astype(float)
        self.smallest = falling[:, np.minimum(starts + self.length, n) - 1].astype(float)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to k vec_ids and scores, best first, without the query's own row. Bounds are floats,
        which hold whole numbers below 2**53 exactly; beyond, ``lost`` is the most they may be off."""
        n = len(self.vec_ids)
        mine = int(np.searchsorted(self.vec_ids, own))
        mine = mine if mine < n and self.vec_ids[mine] == own else -1
        wanted = min(k, n - (mine >= 0))
        if wanted <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        weight = query.astype(float)
        most = float((np.abs(weight) * np.maximum(np.abs(self.largest[:, 0]), np.abs(self.smallest[:, -1]))).sum())
        lost = 0.0 if most < 2 ** 53 else most * 8 * (len(query) + 2) * np.finfo(float).eps
        rising = query < 0  # for a negative weight the smallest values have the largest impact
        best = np.where(rising[:, None], (weight[:, None] * self.smallest)[:, ::-1], weight[:, None] * self.largest)
        least = np.where(rising, weight * self.largest[:, 0], weight * self.smallest[:, -1])
        dim, step = np.unravel_index(np.argsort(-(best - least[:, None]), axis=None, kind="stable"), best.shape)
        segment = np.where(rising[dim], self.steps - 1 - step, step)
        score = np.zeros(n + 1)
        done = np.zeros(len(query), np.int64)  # segments read of each dimension
        possible = np.flatnonzero(np.arange(n) != mine)
        at = 0
        for share in STOPS:
            until = int(len(dim) * share)
            d, s = dim[at:until], segment[at:until]
            score += np.bincount(self.ids[d, s].ravel(), (self.values[d, s] * weight[d][:, None]).ravel(), n + 1)
            done += np.bincount(d, minlength=len(query))
            at = until
            if at < len(dim):
                possible = self._possible(score[:n], done, best, least, rising, mine, wanted, lost)
                if len(possible) <= max(8 * k, n // FEW):
                    break
        else:
            exact = score[possible]
            possible = possible[exact >= _bar(exact, wanted) - 2 * lost]
        exact = _scores(self.vectors[possible], query, most)
        order = np.lexsort((self.vec_ids[possible], ~exact))[:wanted]
        return self.vec_ids[possible][order], exact[order]

    def _possible(self, score: np.ndarray, done: np.ndarray, best: np.ndarray, least: np.ndarray, rising: np.ndarray,
                  mine: int, wanted: int, lost: float) -> np.ndarray:
        """Vectors that may still be members: the proof that all others are not."""
        n = len(score)
        unread = np.where(rising[:, None], self.rank < ((self.steps - done) * self.length)[:, None],
                          self.rank >= (done * self.length)[:, None]).astype(float)
        top = np.where(done < self.steps, best[np.arange(len(done)), np.minimum(done, self.steps - 1)], 0)
        low, high = np.stack([least, top]) @ unread + score
        if mine >= 0:
            low[mine] = high[mine] = -np.inf
        return np.flatnonzero((high >= _bar(low, wanted) - 2 * lost) & (np.arange(n) != mine))


def _bar(scores: np.ndarray, wanted: int) -> float:
    """The score that a member needs; all that are held at an end of a long tie there."""
    bar = float(np.partition(scores, len(scores) - wanted)[len(scores) - wanted])
    return -np.inf if bar <= -2.0 ** 63 else min(bar, 2.0 ** 63)


def _scores(vectors: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; ``most`` bounds their size."""
    if most < 2 ** 53:
        return (vectors.astype(float) @ query.astype(float)).astype(np.int64)
    if most < 2 ** 62:
        return vectors @ query
    exact = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(v, -2 ** 63), 2 ** 63 - 1) for v in exact.tolist()], np.int64)


def search(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for each row that meets
    ``queries``, its own row left out. ``vectors``: vec_id and embedding."""
    rows = stored(whole_numbers(vectors), "vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks, dims = max(1, math.ceil(n / BLOCK)), dims or 0
    asked = rows.where(queries)
    groups = max(1, math.ceil(asked.count() / GROUP))
    index = stored(build(rows, dims, blocks), "index")
    left = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("part"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def meet(postings: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(postings) and len(asks):
            block = Block(postings, dims)
            for q, weights in zip(asks["vec_id"].tolist(), _matrix(asks["v"], dims), strict=True):
                ids, scores = block.top(weights, q, k)
                found += [(q, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
