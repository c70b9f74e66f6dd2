from pyspark.sql import functions as F

from trellis.operators import graph, mesh, query, relation, symmetry, topology
from trellis.operators.components import connected_components


def frame(spark, rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "elem long, nodes array<long>")


def test_canonical_forms(spark):
    rows = frame(spark, [(2, 0, 1), (0, 2, 1)])
    by = lambda group: [tuple(r[0]) for r in rows.orderBy("elem").select(symmetry.canonical("nodes", group)).collect()]
    assert by(symmetry.cyclic(3)) == [(0, 1, 2), (0, 2, 1)]
    assert by(symmetry.dihedral(3)) == [(0, 1, 2), (0, 1, 2)] == by(symmetry.full(3))
    assert len(symmetry.dihedral(4)) == 8 and len(symmetry.full(4)) == 24
    kept, classes = symmetry.unique(rows, symmetry.full(3))
    assert kept.collect() == [(0, [0, 1, 2])] and sorted(map(tuple, classes.collect())) == [(0, 0), (1, 0)]


def test_two_triangles(spark):
    rows = frame(spark, [(0, 1, 2), (1, 3, 2)])
    subs, held = topology.sub_entities(rows, [(0, 1), (1, 2), (2, 0)])
    assert subs.count() == 5 and held.count() == 6
    assert topology.boundary_facets(rows, 2).count() == 4
    assert [r[0] for r in topology.internal_facets(rows, 2).collect()] == [[1, 2]]
    pairs = relation.pairs(relation.incidences(rows))
    places = {r.sub: r.place for r in topology.classify_sub_entities(subs, pairs).collect()}
    assert sorted(places.values()) == ["boundary"] * 4 + ["interior"]
    assert query.dual_graph(pairs, 2).collect() == [(0, 1, 2)]


def test_single_tetrahedron_refines_to_eight(spark):
    rows = frame(spark, [(0, 1, 2, 3)])
    coords = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "node long, x double, y double, z double")
    fine, where, middles = mesh.refine(rows, coords)
    assert (fine.count(), where.count(), middles.count()) == (8, 10, 6)
    volumes = [r.volume for r in mesh.tetra_quality(fine, where).collect()]
    assert min(volumes) > 0 and abs(sum(volumes) - 1 / 6) < 1e-12
    some = spark.createDataFrame([(0, 1)], "a long, b long")
    assert mesh.refine(rows, coords, some)[0].count() == 8  # one mark widens to all six


def test_adaptive_triangles_keep_area(spark):
    rows, coords = mesh.rectangle(spark, 3, 2)
    for marks in ([(0, 1)], [(0, 5)], [(0, 1), (1, 5), (0, 5)], [(1, 5), (5, 6)]):
        fine, where, _ = mesh.refine(rows, coords, spark.createDataFrame(marks, "a long, b long"))
        areas = [r.area for r in mesh.triangle_quality(fine, where).collect()]
        assert abs(sum(areas) - 1.0) < 1e-12 and min(areas) > 0
        v, e, f = where.count(), mesh.edges(fine).count(), fine.count()
        assert v - e + f == 1  # a disc
        assert topology.non_manifold_facets(fine, 2).count() == 0


def test_box_smoothing_and_crack(spark):
    rows, coords = mesh.box(spark, 2, 2, 2)
    assert abs(mesh.tetra_quality(rows, coords).agg(F.sum("volume")).first()[0] - 1) < 1e-12
    assert topology.boundary_facets(rows, 3).count() == 48
    tri, at = mesh.rectangle(spark, 4, 4)
    smooth = mesh.smooth(tri, at, rounds=2)
    assert abs(mesh.triangle_quality(tri, smooth).agg(F.sum("area")).first()[0] - 1) < 1e-9
    split, more = mesh.cracked(tri, at, "x - 0.5")
    assert more.count() == at.count() + 5 and graph.components(relation.pairs(relation.incidences(split))).select("component").distinct().count() == 2


def test_closure_compression_and_extraction(spark):
    typed = spark.createDataFrame([("tri", "node", 0, 0, 0), ("tri", "node", 0, 1, 1), ("tri", "node", 1, 0, 1), ("tri", "node", 1, 1, 2), ("body", "tri", 0, 0, 0)],
                                  "etype string, ntype string, elem long, pos int, node long")
    dead = spark.createDataFrame([("node", 0)], "type string, id long")
    assert sorted(map(tuple, topology.erased(typed, dead).collect())) == [("body", 0), ("node", 0), ("tri", 0)]
    out, maps = topology.compress(typed, dead)
    assert sorted(map(tuple, out.select("etype", "elem", "pos", "node").collect())) == [("tri", 0, 0, 0), ("tri", 0, 1, 1)]
    assert sorted(map(tuple, maps["node"].collect())) == [(1, 0), (2, 1)]


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_walks(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0), (7, 8, 1.0)], "src long, dst long, weight double")
    tree = graph.shortest_paths(edges, 0)
    assert sorted(map(tuple, tree.collect())) == [(0, 0.0, -1), (1, 1.0, 0), (2, 2.0, 1), (3, 3.0, 2)]
    way = graph.paths(tree, spark.createDataFrame([(3,)], "id long")).orderBy("nth").collect()
    assert [r.id for r in way] == [0, 1, 2, 3]
    hops = dict(map(tuple, graph.distances(edges, spark.createDataFrame([(0,)], "id long")).collect()))
    assert hops == {0: 0, 1: 1, 2: 1, 3: 2}
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 3)], "id long")
    levels, whole = graph.topological_levels(edges.where("src < 7"), nodes)
    assert dict(map(tuple, levels.collect())) == {0: 0, 1: 1, 2: 2, 3: 3} and whole
    assert not graph.topological_levels(spark.createDataFrame([(0, 0)], "src long, dst long"), nodes)[1]
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)], "e1 long, e2 long")
    assert dict(map(tuple, graph.colouring(ring, nodes).collect())) == {0: 0, 1: 1, 2: 2, 3: 1}


def test_components_with_settled_stars_apart(spark):
    """Stars, chains, circles and clusters at once: the same as all in every round."""
    import random

    rng = random.Random(7)
    edges = [(10 * k, 10 * k + i) for k in range(30) for i in range(1, 5)] + [(1000 + i + 1, 1000 + i) for i in range(70)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    edges += [(3000 + rng.randrange(80), 3000 + rng.randrange(80)) for _ in range(70)] + [(5, 5), (7, None), (-4, 4000), (-4, 4000)]
    table = spark.createDataFrame(edges, "a long, b long")
    got, want = (sorted(map(tuple, connected_components(table, apart=way).collect())) for way in (True, False))
    assert got == want and len({n for n, _ in got}) == len(got)
    assert connected_components(table.limit(0), apart=True).count() == 0
