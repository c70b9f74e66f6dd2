"""Bounds are errors, never shorter results; and rows that do not fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import dense, graph, mesh, query, relation, sparse
from trellis.plans import lineage


def test_walks_raise_at_their_bounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long")
    tree = spark.createDataFrame([(0, 0.0, -1)] + [(i, float(i), i - 1) for i in range(1, 8)], "id long, dist double, pred long")
    ends = spark.createDataFrame([(7,)], "id long")
    assert [r.id for r in graph.paths(tree, ends).orderBy("nth").collect()] == list(range(8))
    with pytest.raises(RuntimeError):
        graph.paths(tree, ends, max_length=3)
    nodes = spark.range(8).select("id")
    assert {r.id: r.level for r in graph.topological_levels(chain, nodes)[0].collect()} == {i: i for i in range(8)}
    with pytest.raises(RuntimeError):
        graph.topological_levels(chain, nodes, max_rounds=3)
    edges = chain.toDF("e1", "e2")
    assert {r.id: r.colour for r in graph.colouring(edges, nodes).collect()} == {i: i % 2 for i in range(8)}
    with pytest.raises(RuntimeError):
        graph.colouring(edges, nodes, max_rounds=3)
    assert graph.distances(chain, spark.range(1).select("id")).count() == 8
    assert graph.distances(chain, spark.range(1).select("id"), max_hops=2).count() == 3  # a bound that was asked for


def test_ragged_vectors_are_an_error(spark):
    ragged = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0, 5.0],), ([6.0],)], "v array<double>").coalesce(1)
    for f in (dense.moments, dense.covariance, dense.triangular_factor, dense.singular_values):
        with pytest.raises(Exception, match="not of"):
            f(ragged)
    with pytest.raises(Exception, match="not of"):
        dense.transformed(ragged, np.eye(2)).collect()
    some = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert sorted(map(str, (r.v for r in dense.transformed(some, 2 * np.eye(2)).collect()))) == ["None", "[2.0, 4.0]"]


def test_a_large_mean_costs_no_digits(spark):
    x = np.random.default_rng(1).normal(size=(500, 3)) + 1e8
    got = dense.covariance(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(40))
    want = np.cov(x.T)
    assert all(abs(r.v - want[r.i, r.j]) < 1e-6 for r in got.collect())


def test_an_element_of_another_size_is_not_lost(spark):
    rows, coords = mesh.rectangle(spark, 1, 1)
    mixed = rows.unionAll(spark.createDataFrame([(9, [0, 1, 2, 3])], "elem long, nodes array<long>"))
    assert mesh.refine(mixed, coords)[0].groupBy("parent").count().where("parent = 9 and count = 8").count() == 1
    with pytest.raises(Exception, match="no split"):
        mesh.refine(rows.unionAll(spark.createDataFrame([(9, [0, 1, 2, 3, 4])], "elem long, nodes array<long>")), coords)[0].collect()


def test_shared_counts_by_prefixes(spark):
    r = np.random.default_rng(4)
    held = {e: set(r.choice(30, r.integers(1, 12), replace=False).tolist()) | ({99} if e % 2 else set()) for e in range(60)}
    pairs = spark.createDataFrame([(e, n) for e, ns in held.items() for n in ns], "elem long, node long")
    for least in (1, 2, 3, 5):
        got = {(x.e1, x.e2): x.shared for x in query.shared_counts(pairs, least).collect()}
        assert got == {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) >= least}


def test_kronecker_in_blocks(spark):
    a = sparse.Matrix(spark.createDataFrame([(i, j, i + 2.0 * j) for i in range(3) for j in range(2)], "i long, j long, v double"), 3, 2)
    read = lambda m: {(x.i, x.j): x.v for x in m.cells.collect()}
    assert read(a.kronecker(a)) == read(a.kronecker(a, block=2)) and len(read(a.kronecker(a))) == 36


def test_random_relation_is_repeatable(spark):
    one, two = (relation.random_relation(spark, 50, 20, 4, seed=3) for _ in range(2))
    assert relation.same(one, two) and one.where(F.size("nodes") > 4).isEmpty() and one.select(F.explode("nodes").alias("n")).where("n < 0 or n >= 20").isEmpty()


def test_written_tables_can_be_discarded(spark):
    table, (n,) = lineage.cut_counted(spark.range(10), F.count(F.lit(1)))
    assert n == table.count() == 10
    files = table.inputFiles()
    lineage.discard(table, spark.range(3))
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
