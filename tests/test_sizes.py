"""What queries send and hold follows their input; exact where earlier ways failed at size."""

import itertools
import random

import pytest

from trellis.llm import simhash
from trellis.operators import cells, components, mesh, query, relation


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("narrow", [2, 5, 64])
def test_shared_counts_with_wide_elements(spark, monkeypatch, narrow):
    monkeypatch.setattr(query, "NARROW", narrow)
    draw = random.Random(narrow)
    held = {e: set(draw.sample(range(25), draw.randint(1, 9))) for e in range(40)}
    held[40] = set(range(25))
    pairs = spark.createDataFrame([(e, n) for e, ns in held.items() for n in ns], "elem long, node long")
    for least in (2, 3):
        want = {(a, b): len(held[a] & held[b]) for a, b in itertools.combinations(held, 2) if len(held[a] & held[b]) >= least}
        got = [tuple(r) for r in query.shared_counts(pairs, least).select("e1", "e2", "shared").collect()]
        assert len(got) == len(want) and {r[:2]: r[2] for r in got} == want


def test_candidates_of_the_dual_graph_meet_once(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2)], "elem long, node long")
    assert plan(query.dual_graph(pairs, 2)).count("Join ") == 1
    edges = spark.createDataFrame([(0, 1, 2)], "e1 long, e2 long, shared long")
    assert plan(query.degrees(edges)).count("Union") == 0
    assert sorted(map(tuple, query.mirrored(edges).collect())) == [(0, 1, 2), (1, 0, 2)]


def test_resampled_curve_that_begins_twice_at_one_place(spark):
    curve = spark.createDataFrame([(1, k, x, 0.0, 0.0) for k, x in enumerate([0.0, 0.0, 4.0, 4.0])], "curve long, seq int, x double, y double, z double")
    assert sorted((r.k, r.x) for r in mesh.resample(curve, 5).collect()) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


@pytest.mark.parametrize("paired", [2, 16])
def test_probes_meet_elements_by_two_nodes(spark, monkeypatch, paired):
    monkeypatch.setattr(query, "PAIRED", paired)
    draw = random.Random(paired)
    held = {e: set(draw.sample(range(12), draw.randint(1, 8))) for e in range(60)}
    asked = {p: set(draw.sample(range(14), draw.randint(1, 4))) for p in range(50)}
    table = lambda d, k: spark.createDataFrame([(e, n) for e, ns in d.items() for n in ns], f"{k} long, node long")
    found = query.batch_containing_all(table(held, "elem"), table(asked, "probe"))
    assert sorted(map(tuple, found.collect())) == sorted((p, e) for p in asked for e in held if asked[p] <= held[e])
    assert "flatten" in plan(found)  # pairs of nodes of each element meet probes


@pytest.mark.parametrize("carried", [1, 64])
def test_points_and_edges_meet_in_cells_alone(spark, monkeypatch, carried):
    monkeypatch.setattr(cells, "CARRIED", carried)
    draw = random.Random(carried)
    loops = {k: [(draw.randint(0, 50), draw.randint(0, 50)) for _ in range(draw.randint(3, 9))] for k in range(25)}
    corners = spark.createDataFrame([(k, i, float(x), float(y)) for k, ps in loops.items() for i, (x, y) in enumerate(ps)], "loop long, seq int, x double, y double")
    spots = [(i, float(draw.randint(0, 50)), float(draw.randint(0, 50))) for i in range(300)] + [(300 + i, 20.0, 25.0) for i in range(3)]

    def crossed(x, y, ps):
        sides = zip(ps, ps[1:] + ps[:1])
        return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in sides) % 2

    want = sorted((i, k) for i, x, y in spots for k, ps in loops.items() if crossed(x, y, ps))
    found = cells.points_in_polygons(spark.createDataFrame(spots, "point long, x double, y double"), corners)
    assert sorted(map(tuple, found.select("point", "loop").collect())) == want
    if carried == 64:  # nothing is joined or grouped once points have met cells
        assert plan(found).count("Join ") == 1 and plan(found).index("Generate explode(points") < plan(found).index("Join ") < plan(found).index("Aggregate")


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_corners_never_pass_through_the_driver(spark):
    assert "Broadcast" not in executed(mesh.tetra_quality(*mesh.box(spark, 3, 2, 2)))


def test_links_and_components_never_pass_through_the_driver(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    for df in (components._large_star(edges), components._small_star(edges), simhash.links(spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long"))):
        assert "Broadcast" not in executed(df)


def test_signatures_of_relations_are_made_in_a_set_number_of_parts(spark):
    typed = spark.createDataFrame([("a", 1, "b", 2), ("a", 1, "b", 2), ("a", 1, "b", 3)], "etype string, elem long, ntype string, node long")
    found = relation.relation_signature(typed)
    assert found.first().n == 2 and "RepartitionByExpression" in plan(found)


def test_mesh_writers_read_what_they_write_from_tables(spark, monkeypatch):
    from trellis.sources import meshes
    parts = []
    monkeypatch.setattr(meshes, "_written", lambda blocks, path: parts.extend(blocks))
    rows = spark.createDataFrame([(0, [0, 1, 2])], "elem long, nodes array<long>").groupBy("elem").agg({"nodes": "max"}).toDF("elem", "nodes")
    coords = spark.createDataFrame([(n, 0.0, 1.0, 2.0) for n in range(3)], "node long, x double, y double, z double").distinct()
    meshes.write_blocks(rows, coords, "unused")
    assert parts and not any("Aggregate" in plan(p) for p in parts)
