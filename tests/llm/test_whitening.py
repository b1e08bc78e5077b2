"""Whitening against plain whole-number and floating-point arithmetic."""

import numpy as np
import pytest

from linewatch.llm import queries, whitening
from tests.conftest import TESTDATA

SCHEMA = "vec_id long, embedding array<double>, n long, extra string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, -1, "x") for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors, most=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    values, turned = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1))
    values, turned = values[::-1], turned[:, ::-1]
    return ((n * x - sums) ** 2).sum(1), ((x - sums / n) @ turned / np.sqrt(np.abs(values)))[:, :most], (values / values.sum())[:most]


def test_whole_table_against_plain_arithmetic(spark):
    found = queries.op11_whitening(spark, f"{TESTDATA}/sf0.01").toPandas()
    rows = spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet").toPandas()
    deviation, white, explained = plain(np.stack(rows.embedding))
    assert len(found) == 8 * len(rows) and found.n.eq(len(rows)).all()
    for k in range(8):
        mine = found[found.component == k + 1].set_index("vec_id").loc[rows.vec_id]
        assert (mine.deviation.to_numpy() == deviation).all()
        assert min(np.abs(mine.whitened - s * white[:, k]).max() for s in (1, -1)) < 1e-9
        assert np.abs(mine.explained - explained[k]).max() < 1e-12
    assert found.identity_error.nunique() == 1 and found.identity_error.max() < 1e-10


def test_bit_planes_give_exact_products():
    y = np.random.default_rng(3).integers(0, 1 << 40, (301, 5)).astype(np.uint64)
    scatter = whitening.Scatter(5, 40)
    for part in (y[:100], y[100:]):
        scatter.add(part)
    exact = y.astype(object).T @ y.astype(object)
    for i, j, *limbs in scatter.rows():
        total = sum(v << 32 * k for k, v in enumerate(limbs))
        assert total == (int(y[:, i].astype(object).sum()) if j < 0 else exact[i, j])


def test_odd_rows_take_no_part(spark):
    fine = [[0.1, 0.2], [0.4, -0.3], [-0.2, 0.25], [0.1, 0.2]]
    odd = [None, [0.1, None], [float("nan"), 1.0], [1.0, float("inf")]]
    found = whitening.whitened(frame(spark, [*fine, *odd])).toPandas()
    assert set(found.vec_id) == {0, 1, 2, 3} and len(found) == 8 and found.n.eq(4).all()
    assert list(found.deviation[found.vec_id == 0]) == [plain(fine)[0][0]] * 2


def test_repeated_and_null_ids_get_their_rows(spark):
    rows = [(1, [0.5]), (1, [0.5]), (None, [-0.5])]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert len(found) == 3 and found.vec_id.isna().sum() == 1 and found.component.eq(1).all()


def test_short_vectors_are_filled_with_zeros(spark):
    uneven, even = [[0.5], [0.25, 1.0], []], [[0.5, 0.0], [0.25, 1.0], [0.0, 0.0]]
    a, b = (sorted(map(tuple, whitening.whitened(frame(spark, v)).select("vec_id", "component", "deviation").collect())) for v in (uneven, even))
    assert a == b != []


@pytest.mark.parametrize("vectors", [[], [[0.5, 1.0]], [[0.5], [0.5]], [[]], [None]])
def test_no_variance_no_components(spark, vectors):
    found = whitening.whitened(frame(spark, vectors))
    assert found.count() == 0 and found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_components_stay_exact(spark):
    vectors = [[3e12, 1.0], [-2e12, 0.5], [1e12, 0.25]]
    x = [[int(c * 1024) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    found = whitening.whitened(frame(spark, vectors)).toPandas().drop_duplicates("vec_id").sort_values("vec_id")
    assert [int(v) for v in found.deviation_exact] == exact and found.deviation.isna().all()
    assert whitening.whitened(frame(spark, [[1e300], [-1e300]])).count() == 2  # held at the bound
