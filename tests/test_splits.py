"""Refinement by partial marks and cracks along fields, on boxes with random marks and against exact measures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import graph, mesh, relation, splits, topology


@pytest.mark.parametrize("size", [2, 3, 4])
def test_templates_fill_their_element(size):
    """Children of every mask have the whole measure, are turned alike, and name every cut edge."""
    import numpy as np

    edges = [(a, b) for a in range(size) for b in range(a + 1, size)]
    corner = np.vstack([np.zeros(size - 1), np.eye(size - 1)])
    where = np.vstack([corner, *((corner[a] + corner[b])[None] / 2 for a, b in edges)])
    for mask in range(1 << len(edges)):
        children = splits.template(size, mask)
        parts = [np.linalg.det(np.hstack([where[c], np.ones((size, 1))])) for c in children]
        whole = np.linalg.det(np.hstack([corner, np.ones((size, 1))]))
        assert all(p * whole > 0 for p in parts) and abs(sum(parts) - whole) < 1e-12
        assert {n - size for c in children for n in c if n >= size} == {k for k in range(len(edges)) if mask >> k & 1}


def volume(fine, where):
    return fine.join(mesh.tetra_quality(fine, where), "elem")


@pytest.mark.parametrize("close", [False, True])
def test_random_marks_of_a_box_leave_no_hanging_facet(spark, close):
    rows, coords = mesh.box(spark, 3, 3, 2)
    rng = random.Random(close)
    turned = [(r.elem, rng.sample(r.nodes, 4)) for r in rows.collect()]  # neighbours list their nodes in any order
    rows = spark.createDataFrame(turned, "elem long, nodes array<long>")
    every = [tuple(r) for r in splits.sides(rows).select("a", "b").distinct().orderBy("a", "b").collect()]
    marks = rng.sample(every, len(every) // (8 if close else 2))
    fine, where, middles = mesh.refine(rows, coords, spark.createDataFrame(marks, "a long, b long"), close=close)
    used = {(r.parent1, r.parent2) for r in middles.collect()}
    want = set(marks)
    while close:
        few = [t for _, t in turned if 0 < sum((min(a, b), max(a, b)) in want for i, a in enumerate(t) for b in t[i + 1 :]) < 3]
        more = want | {(min(a, b), max(a, b)) for t in few for i, a in enumerate(t) for b in t[i + 1 :]}
        if more == want:
            break
        want = more
    assert used == want
    assert topology.non_manifold_facets(fine, 3).count() == 0
    # A hanging facet would be one of a single element inside the box.
    lone = topology.boundary_facets(fine, 3).select(F.explode("facet").alias("node"), "facet").join(where, "node")
    flat = lone.groupBy("facet").agg(*(F.min(c).alias(c + "0") for c in "xyz"), *(F.max(c).alias(c + "1") for c in "xyz"))
    out = F.lit(False)
    for c in "xyz":
        out = out | ((F.col(c + "0") == F.col(c + "1")) & F.col(c + "0").isin(0.0, 1.0))
    assert flat.where(~out).count() == 0
    sums = volume(fine, where).groupBy("parent").agg(F.sum("volume").alias("v"), F.min(F.signum("volume")).alias("lo"), F.max(F.signum("volume")).alias("hi"))
    own = mesh.tetra_quality(rows, coords).select(F.col("elem").alias("parent"), "volume")
    assert sums.join(own, "parent").where("abs(v - volume) > 1e-12 or lo <> hi or lo <> signum(volume)").count() == 0 and sums.count() == len(turned)


def test_mixed_elements_agree(spark):
    rows = spark.createDataFrame([(0, [3, 1, 2, 0]), (1, [2, 0, 1]), (2, [1, 0]), (3, [3])], "elem long, nodes array<long>")
    coords = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "node long, x double, y double, z double")
    fine, _, _ = mesh.refine(rows, coords, spark.createDataFrame([(1, 0), (0, 2), (1, 3)], "a long, b long"))
    children = {p: [r.nodes for r in fine.where(F.col("parent") == p).orderBy("elem").collect()] for p in range(4)}
    tets = {tuple(sorted(c[i] for i in range(4) if i != k)) for c in children[0] for k in range(4)}
    bars = {tuple(sorted((c[i], c[j]))) for c in children[1] for i in range(3) for j in range(i)}
    assert {tuple(sorted(c)) for c in children[1]} <= tets and {tuple(sorted(c)) for c in children[2]} <= bars and children[3] == [[3]]
    with pytest.raises(Exception, match="no split of an element of 5 nodes"):
        splits.split(spark.createDataFrame([(0, [0, 1, 2, 3, 4])], "elem long, nodes array<long>"), spark.createDataFrame([], "node long, a long, b long")).collect()


def test_refinement_of_nothing(spark):
    rows, coords = mesh.rectangle(spark, 1, 1)
    fine, where, middles = mesh.refine(rows.limit(0), coords)
    assert fine.count() == 0 and where.count() == 4 and middles.count() == 0
    fine, _, _ = mesh.refine(rows, coords, spark.createDataFrame([(7, 9)], "a long, b long"))
    assert [(r.elem, r.nodes) for r in fine.orderBy("elem").collect()] == [(r.elem, r.nodes) for r in rows.orderBy("elem").collect()]


def parts(rows):
    return graph.components(relation.pairs(relation.incidences(rows))).select("component").distinct().count()


def test_a_crack_that_cuts_edges_parts_a_square(spark):
    rows, coords = mesh.rectangle(spark, 5, 4)
    out, where, made = mesh.opened(rows, coords, "x + 0.3 * y - 0.5")
    quality = mesh.triangle_quality(out, where)
    assert abs(quality.agg(F.sum("area")).first()[0] - 1) < 1e-12 and parts(out) == 2
    line = where.where("abs(x + 0.3 * y - 0.5) < 1e-9")
    copies = made.where("node <> root")
    assert line.count() == 2 * copies.count() > 0 and topology.non_manifold_facets(out, 2).count() == 0
    lips = topology.boundary_facets(out, 2).select(F.explode("facet").alias("node"), "facet").join(line, "node").groupBy("facet").count().where("count = 2")
    assert lips.count() == 2 * (copies.count() - 1)


def test_a_crack_through_nodes_and_one_that_ends_inside(spark):
    rows, coords = mesh.rectangle(spark, 4, 4)
    assert parts(mesh.cracked(rows, coords, "y - 0.5")[0]) == 2
    out, where, made = mesh.opened(rows, coords, "y - 0.5", where="x <= 0.5")
    copies = {(r.root, r.node) for r in made.collect()}
    assert len(copies) == 2 and parts(out) == 1  # the nodes at x = 0 and 0.25; the tip at 0.5 is one
    assert abs(mesh.triangle_quality(out, where).agg(F.sum("area")).first()[0] - 1) < 1e-12
    # An edge that is a crack's end is no lip: both its sides still hang together at the tip.
    assert topology.boundary_facets(out, 2).count() == 16 + 4


def test_a_crack_of_tetrahedra(spark):
    rows, coords = mesh.box(spark, 2, 2, 2)
    out, where, made = mesh.opened(rows, coords, "x + y + z - 1.3")
    sized = out.join(mesh.tetra_quality(out, where), "elem")
    assert abs(sized.agg(F.sum(F.abs("volume"))).first()[0] - 1) < 1e-12 and sized.where("abs(volume) < 1e-15").count() == 0
    assert parts(out) == 2 and topology.non_manifold_facets(out, 3).count() == 0
    assert made.where("node = root").count() == made.where("node <> root").count()


def test_cracks_at_the_edges(spark):
    rows, coords = mesh.rectangle(spark, 2, 2)
    for level in ("x + 1", "x", "-x", "0 * x"):  # nothing below, only a border, everything zero
        out, where, made = mesh.opened(rows, coords, level)
        assert out.count() == 8 and where.count() == 9 and made.count() == 0
    out, where, _ = mesh.opened(rows.limit(0), coords, "x - 0.3")
    assert out.count() == 0 and where.count() == 9
    with pytest.raises(ValueError, match="alone"):
        mesh.opened(rows.unionByName(spark.createDataFrame([(99, [0, 1])], "elem long, nodes array<long>")), coords, "x")
    with pytest.raises(Exception, match="a node without a value"):
        mesh.opened(rows, coords, "cast(null as double)")[0].collect()


def test_children_are_numbered_where_they_are_made(spark):
    """No child is dealt or joined again for its number; all orders of an element's nodes are in the table of splits."""
    orders = [list(p) for p in itertools.permutations((3, 5, 8, 9))]
    rows = spark.createDataFrame(list(enumerate(orders)), "elem long, nodes array<long>")
    cuts = spark.createDataFrame([(20, 3, 5), (21, 5, 9)], "node long, a long, b long")
    fine = splits.split(rows, cuts)
    assert fine._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the offsets of partitions
    got = [tuple(r) for r in fine.orderBy("elem").select("elem", "parent", "nodes").collect()]
    assert [r[0] for r in got] == list(range(len(got))) and [r[1] for r in got] == sorted(r[1] for r in got)
    place = {3: (0, 0, 0), 5: (2, 0, 0), 8: (0, 2, 0), 9: (0, 0, 2), 20: (1, 0, 0), 21: (1, 0, 1)}
    turn = lambda ns: np.linalg.det([[*place[n], 1] for n in ns])
    for elem, nodes in enumerate(orders):
        turns = [turn(r[2]) / turn(nodes) for r in got if r[1] == elem]
        assert min(turns) > 0 and abs(sum(turns) - 1) < 1e-9
