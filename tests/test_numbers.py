import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.functions import geometry as g
from trellis.operators import dense, mesh, solvers, sparse


def matrix(spark, a):
    a = np.asarray(a, float)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return sparse.Matrix(spark.createDataFrame(cells, "i long, j long, v double"), *a.shape)


def full(m):
    out = np.zeros((m.rows, m.columns))
    for i, j, v in m.cells.collect():
        out[i, j] = v
    return out


def test_matrix_algebra(spark):
    a, b = np.array([[1.0, 2, 0], [0, 0, 3]]), np.array([[0.0, 1], [4, 0], [5, 6]])
    x, y = matrix(spark, a), matrix(spark, b)
    assert np.array_equal(full(x.times(y)), a @ b) and np.array_equal(full(x.transpose()), a.T)
    assert np.array_equal(full(x.add(x, 2.0)), 3 * a) and np.array_equal(full(x.hadamard(x)), a * a)
    assert np.array_equal(full(x.kronecker(y)), np.kron(a, b))
    s = x.summary().first()
    assert (s.norm_inf, s.norm_one, s.trace, s.norm_max) == (3.0, 3.0, 1.0, 3.0)
    with pytest.raises(ValueError):
        x.times(x)


def test_repeated_cells(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i long, j long, v double")
    assert sparse.from_cells(cells, 1, 1).cells.collect() == [(0, 0, 3.0)]
    with pytest.raises(Exception, match="repeated cell"):
        sparse.from_cells(cells, 1, 1, sum_repeated=False).cells.collect()


def test_assembly_and_solve(spark):
    n = 6
    conn = spark.createDataFrame([(e, k, e + k) for e in range(n) for k in (0, 1)], "elem long, li int, dof long")
    k = spark.createDataFrame([(e, i, j, 2.5 if i == j else -1.0) for e in range(n) for i in (0, 1) for j in (0, 1)], "elem long, li int, lj int, v double")
    loads = spark.createDataFrame([(e, i, 1.0 + e) for e in range(n) for i in (0, 1)], "elem long, li int, v double")
    cells, b = sparse.assemble(conn, k, loads)
    m = sparse.Matrix(cells, n + 1, n + 1)
    right = np.zeros(n + 1)
    for i, v in b.collect():
        right[i] = v
    got = np.zeros(n + 1)
    for i, v in sparse.solve(m, b).collect():
        got[i] = v
    assert np.allclose(full(m) @ got, right)
    assert sparse.solve(m, b.withColumn("v", F.lit(0.0))).count() == 0
    with pytest.raises(Exception, match="names a degree"):
        sparse.assemble(spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "elem long, li int, dof long"), k)[0].collect()


def test_vector_statistics(spark):
    x = np.random.default_rng(1).normal(size=(60, 4))
    x[:, 3] = 7
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(5)
    read = lambda df: np.array([r.v for r in df.orderBy("i", "j").collect()]).reshape(4, 4)
    assert np.allclose(read(dense.covariance(rows)), np.cov(x.T))
    corr = read(dense.correlation(rows))
    assert np.allclose(corr[:3, :3], np.corrcoef(x[:, :3].T)) and corr[3].tolist() == [0, 0, 0, 1]
    assert np.allclose(dense.singular_values(rows), np.linalg.svd(x)[1])
    r = np.linalg.qr(x, mode="r")
    assert np.allclose(dense.triangular_factor(rows), r * np.sign(np.diag(r))[:, None])
    with pytest.raises(ValueError):
        dense.covariance(rows.limit(1))


def test_geometry(spark):
    p = [g.Point(*(F.lit(float(v)) for v in xyz)) for xyz in [(0, 0, 0), (3, 0, 0), (0, 4, 0), (0, 0, 5)]]
    got = spark.range(1).select(
        g.triangle_area(*p[:3]), g.tetra_volume(*p), g.triangle_aspect(*p[:3]), g.smallest_angle(*p[:3]), g.triangle_aspect(p[0], p[1], p[1]),
        g.distance_to_segment(p[3], p[0], p[1]), g.in_triangle(g.Point(F.lit(1.0), F.lit(1.0), F.lit(0.0)), *p[:3]), g.rotated(p[1], p[0], math.pi / 2).y).first()
    assert np.allclose(got[:4], [6, 10, 5 / 2, math.atan(3 / 4)])
    assert got[4] == math.inf and got[5] == 5 and got[6] is True and abs(got[7] - 3) < 1e-12


def test_polygons(spark):
    loops = spark.createDataFrame([("a", i, *xy) for i, xy in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])], "loop string, seq int, x double, y double")
    assert mesh.signed_area(loops).collect() == [("a", 12.0)]
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 1.0), (2, 3.9, 2.9)], "point long, x double, y double")
    assert sorted(r.point for r in mesh.points_in_polygons(points, loops).collect()) == [0, 2]
    curve = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 3.0, 4.0, 0.0), (0, 2, 3.0, 4.0, 1.0)], "curve int, seq int, x double, y double, z double")
    assert [r.s for r in mesh.arc_length(curve).orderBy("seq").collect()] == [0.0, 5.0, 6.0]


def test_roots(spark):
    rows = spark.createDataFrame([(2.0, 0.0, 5.0), (9.0, 0.0, 5.0), (-1.0, 0.0, 5.0)], "c double, low double, high double")
    got = [r.root for r in solvers.roots(rows, lambda x: x * x - F.col("c")).orderBy("c").collect()]
    assert got[0] is None and np.allclose(got[1:], [math.sqrt(2), 3.0], atol=1e-9)


def test_oscillator(spark):
    one = matrix(spark, [[1.0]])
    none = sparse.Matrix(one.cells.withColumn("v", F.lit(0.0)), 1, 1)
    start = spark.createDataFrame([(0, 1.0, 0.0, -1.0)], "i long, u double, v double, a double")
    zero = spark.createDataFrame([(0, 0.0)], "i long, v double")
    out = solvers.integrate(one, none, one, start, lambda t: zero, 0.1, 2)
    for r in out.collect():
        assert abs(r.u - math.cos(0.1 * r.step)) < 1e-3


def test_powers_and_small_matrices(spark):
    a = np.array([[1.0, 2], [0.5, 3]])
    m = matrix(spark, a)
    assert np.allclose(full(m.power(5)), np.linalg.matrix_power(a, 5)) and np.allclose(full(m.symmetric_part()), (a + a.T) / 2)
    assert not m.is_symmetric() and m.symmetric_part().is_symmetric()
    rows = spark.createDataFrame([(0, a.ravel().tolist()), (1, None), (2, [1.0, 2.0, 2.0, 4.0])], "id long, m array<double>")
    read = lambda op: [r.out for r in dense.batched(rows, op, 2).orderBy("id").collect()]
    assert np.allclose(read("determinant")[0], np.linalg.det(a)) and read("determinant")[1] is None
    assert np.allclose(read("inverse")[0], np.linalg.inv(a).ravel()) and read("inverse")[2] is None
    values, vectors = np.linalg.eig(a)
    assert np.allclose(read("exponential")[0], (vectors @ np.diag(np.exp(values)) @ np.linalg.inv(vectors)).real.ravel())
    assert np.allclose(read("singular_values")[2], [5, 0])


def test_curves(spark):
    curve = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 3.0, 4.0, 0.0), (0, 2, 3.0, 4.0, 5.0)], "curve int, seq int, x double, y double, z double")
    got = [(r.k, r.x, r.y, r.z) for r in mesh.resample(curve, 5).orderBy("k").collect()]
    assert np.allclose(got, [(0, 0, 0, 0), (1, 1.5, 2, 0), (2, 3, 4, 0), (3, 3, 4, 2.5), (4, 3, 4, 5)])
    rows, _ = mesh.rectangle(spark, 3, 2)
    loop = [r.node for r in mesh.boundary_loops(rows).orderBy("loop", "seq").collect()]
    assert loop == [0, 1, 2, 3, 7, 11, 10, 9, 8, 4]


def test_newton_and_inverse_iteration(spark):
    start = spark.createDataFrame([(0, 2.3), (1, 3.2)], "i long, v double")
    target = spark.createDataFrame([(0, 4.0), (1, 9.0)], "i long, t double")
    residual = lambda x: x.join(target, "i").select("i", (F.col("v") * F.col("v") - F.col("t")).alias("v"))
    jacobian = lambda x: sparse.Matrix(x.select("i", F.col("i").alias("j"), (2 * F.col("v")).alias("v")), 2, 2)
    assert np.allclose([r.v for r in solvers.newton(residual, jacobian, start, 1e-2, radius=0.3).orderBy("i").collect()], [2, 3], atol=1e-2)
    value, _ = solvers.smallest_eigenvalue(matrix(spark, [[2.0, 1.0], [1.0, 3.0]]), start, 0.1)
    assert abs(value - np.linalg.eigvalsh([[2.0, 1.0], [1.0, 3.0]])[0]) < 0.1


def test_roots_of_one_partition_are_dealt(spark):
    """A small file of many rows is read by one task; its roots are not found by that one alone."""
    rows = spark.range(1, 401, numPartitions=1).select("id", F.lit(0.0).alias("low"), F.lit(30.0).alias("high"))
    found = solvers.roots(rows, lambda x: x * x - F.col("id"))
    assert found.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(abs(r.root - r.id**0.5) < 1e-9 for r in found.collect())


def test_products_are_made_in_a_set_number_of_tasks(spark):
    a = np.random.default_rng(5).integers(-3, 4, (9, 7))
    made = matrix(spark, a.T).times(matrix(spark, a)).cells
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "BroadcastHashJoin" not in plan
    got = np.zeros((7, 7))
    for r in made.collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, a.T @ a)


def test_solve_with_long_vectors_and_gaps_between_places(spark, monkeypatch):
    """Vectors too large for all tasks give the same solution; places may have gaps."""
    conn = [(0, 3, 0), (0, 9, 1), (1, 3, 1), (1, 9, 2), (2, 4, 2), (2, 5, 0), (2, 6, 3)]
    of = {}
    for e, li, dof in conn:
        of.setdefault(e, []).append((li, dof))
    k = [(e, p, q, 9.0 if p == q else -1.0 - p / 7) for e, own in of.items() for p, _ in own for q, _ in own] + [(0, 3, 4, 5.0), (2, 7, 4, 5.0)]
    dense = np.zeros((4, 4))
    for e, p, q, v in k:
        if p in dict(of[e]) and q in dict(of[e]):
            dense[dict(of[e])[p], dict(of[e])[q]] += v
    loads = [(e, li, 1.0) for e, li, _ in conn] + [(1, 4, 7.0)]
    cells, b = sparse.assemble(spark.createDataFrame(conn, "elem long, li int, dof long"), spark.createDataFrame(k, "elem long, li int, lj int, v double"), spark.createDataFrame(loads, "elem long, li int, v double"))
    assert {(r.i, r.j): round(r.v, 9) for r in cells.collect()} == {(i, j): round(dense[i, j], 9) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(dense)))}
    want = np.linalg.solve(dense, [r[1] for r in sorted(map(tuple, b.collect()))])
    for most in (sparse.SENT, 0):
        monkeypatch.setattr(sparse, "SENT", most)
        assert sparse.may_be_sent(4) == (most > 0)
        got = sparse.solve(sparse.Matrix(cells, 4, 4), b).orderBy("i").collect()
        assert np.allclose([r.v for r in got], want, atol=1e-7)
