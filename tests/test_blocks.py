"""Several eigenpairs and blocked products, against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import solvers, sparse
from trellis.operators.sparse import Matrix


def as_matrix(spark, dense):
    return Matrix(spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "i long, j long, v double"), *dense.shape)


def test_five_smallest_eigenpairs(spark):
    rng = np.random.default_rng(2)
    n = 60
    x = np.diag(np.full(n, 2.5)) - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1)
    x[5, 40] = x[40, 5] = 0.7
    x += np.diag(rng.random(n))
    found, vectors = solvers.smallest_eigenpairs(as_matrix(spark, x), 5)
    got = found.orderBy("nth").collect()
    assert np.allclose([r.value for r in got], np.linalg.eigvalsh(x)[:5], atol=1e-8) and all(r.residual < 1e-5 for r in got)
    v = np.zeros((n, 5))
    for r in vectors.collect():
        v[r.i, r.nth - 1] = r.v
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-6) and np.abs(x @ v - v * [r.value for r in got]).max() < 1e-5


def test_all_eigenvalues_of_a_small_matrix_and_equal_ones(spark):
    x = np.diag([3.0, 1.0, 1.0, -2.0])
    found, _ = solvers.smallest_eigenpairs(as_matrix(spark, x), 4)
    assert np.allclose([r.value for r in found.orderBy("nth").collect()], [-2, 1, 1, 3], atol=1e-9)
    with pytest.raises(ValueError, match="5 eigenvalues of a matrix of 4 rows"):
        solvers.smallest_eigenpairs(as_matrix(spark, x), 5)


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_products_with_hot_inner_indices(spark, block):
    rng = np.random.default_rng(block)
    a, b = (rng.integers(1, 5, s) * (rng.random(s) < 0.1) for s in ((40, 30), (30, 50)))
    a[:, 7], b[7, :], a[:, 9] = 1, 2, 3
    got = as_matrix(spark, a).times(as_matrix(spark, b), block=block)
    out = np.zeros((40, 50))
    for r in got.cells.collect():
        out[r.i, r.j] = r.v
    assert (out == a @ b).all() and got.rows == 40 and got.columns == 50


def test_no_key_of_a_blocked_product_is_hot(spark):
    """One inner index of 300 by 400 cells: 120,000 products, in parts of about 50 cells a side."""
    a = Matrix(spark.range(300).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1.0).alias("v")), 300, 1)
    b = Matrix(spark.range(400).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v")), 1, 400)
    cells = a.times(b, block=50).cells
    assert cells.count() == 120_000 and cells.where("v <> 2").count() == 0
    assert sparse.Matrix(cells.limit(0), 300, 400).times(Matrix(cells.limit(0), 400, 2)).cells.count() == 0


@pytest.mark.parametrize("most", [40_000_000, 0])
def test_eigenpairs_of_blocks_sent_and_not_sent(spark, monkeypatch, most):
    monkeypatch.setattr(sparse, "SENT", most)
    x = np.diag(np.arange(1.0, 13.0)) + np.diag(np.full(11, 0.25), 1) + np.diag(np.full(11, 0.25), -1)
    assert solvers.may_be_sent(12, 5) == (most > 0)
    found, _ = solvers.smallest_eigenpairs(as_matrix(spark, x), 2)
    assert np.allclose([r.value for r in found.orderBy("nth").collect()], np.linalg.eigvalsh(x)[:2], atol=1e-9)
