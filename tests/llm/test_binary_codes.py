"""Approximate neighbours against brute force over all rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from linewatch.llm import binary_codes, queries
from tests.conftest import TESTDATA

SCHEMA = "vec_id long, embedding array<double>, rank int, code string"


def nearest(rows, query, k):
    """ids and cosines of plain search; ``rows``: id -> vector."""
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    scored = sorted((-cosine(rows[query], v), i) for i, v in rows.items() if i != query)
    return [(i, -s) for s, i in scored[:k]]


def test_recall_and_scores_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{TESTDATA}/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    found = queries.op12_nearest(spark, f"{TESTDATA}/sf0.1").toPandas()
    x = np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits, wanted = rows.vec_id.to_numpy(), 0, 0
    for place in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[place]
        scores[place] = -2
        mine = found[found.query_id == ids[place]].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        assert np.abs(scores[np.searchsorted(ids, mine.vec_id)] - mine.score).max() < 1e-12
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -scores))[:5]]))
        wanted += 5
    assert hits >= 0.9 * wanted


def test_every_code_within_the_radius_is_found():
    chance = np.random.default_rng(2)
    codes = chance.integers(0, 2 ** 63, 3000).astype(np.uint64)
    codes[100:400] = codes[0] ^ (np.uint64(1) << chance.integers(0, 64, 300).astype(np.uint64))  # a crowd beside one code
    tables = binary_codes.Tables(codes)
    for code in (codes[0], codes[7], np.uint64(0)):
        for radius in (0, 1, 4, 5, 17, 23, 30, 64):
            assert list(tables.within(code, radius)) == list(np.flatnonzero(np.bitwise_count(codes ^ code) <= radius))


def test_copies_ties_and_odd_rows(spark):
    rows = {0: [1.0, 0.0], 50: [1.0, 0.0], 7: [1.0, 0.0], 9: [0.0, 2.0], 8: [0.0, 2.0], 11: [-3.0, 0.5]}
    odd = [(3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 0.0]), (10, []), (7, [1.0, 5.0])]
    frame = spark.createDataFrame([(i, v, -1, "x") for i, v in [*rows.items(), *odd]], SCHEMA)
    found = binary_codes.search(frame, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()
    got = {q: [(r["vec_id"], r["score"]) for r in found if r["query_id"] == q] for q in (0, 50)}
    for q, pairs in got.items():
        want = nearest(rows, q, 3)
        assert [i for i, _ in pairs] == [i for i, _ in want]
        assert np.allclose([s for _, s in pairs], [s for _, s in want], atol=1e-14)


def test_fewer_candidates_than_asked_for_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0], 0, ""), (1, [2.0], 0, "")], SCHEMA)
    assert [tuple(r) for r in binary_codes.search(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert binary_codes.search(frame.limit(0), F.lit(True)).count() == 0
    assert binary_codes.search(frame, F.lit(False)).count() == 0
    assert binary_codes.search(frame.where("vec_id = 0"), F.lit(True)).count() == 0


def test_many_copies_of_one_vector(spark):
    """Half of all rows are one vector; each query still gets its smallest other ids."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)))
                                    .otherwise(F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 7))).alias("embedding"))
    found = binary_codes.search(rows, F.col("vec_id") % 50 == 0, k=5).toPandas()
    for q, mine in found.groupby("query_id"):
        assert sorted(mine.vec_id) == [i for i in (0, 2, 4, 6, 8, 10) if i != q][:5]


def test_very_large_and_very_small_components(spark):
    frame = spark.createDataFrame([(0, [1e200, 1e200], 0, ""), (1, [1e-200, 0.0], 0, ""), (2, [3.0, 3.0], 0, "")], SCHEMA)
    found = binary_codes.search(frame, F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [2, 1] and np.allclose([r["score"] for r in found], [1, math.sqrt(0.5)])
