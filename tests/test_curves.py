"""Closed polygons: direction, refinement, measures."""

from trellis.operators import curves


def test_curves(spark):
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 1.0), (0.0, 1.0)]
    rows = [(1, i, x, y) for i, (x, y) in enumerate(square)] + [(2, i, x, y) for i, (x, y) in enumerate(square[::-1])] + [(3, 0, 5.0, 5.0), (3, 1, 5.0, 5.0), (3, 2, 5.0, 5.0), (4, 7, 1.0, 1.0)]
    loops = spark.createDataFrame(rows, "loop long, seq long, x double, y double")
    told = {r.loop: r for r in curves.measures(loops).collect()}
    assert (told[1].points, told[1].around, told[1].area, told[2].area, told[3].around, told[4].points) == (4, 18.0, 8.0, -8.0, 0.0, 1)
    turned = curves.oriented(loops)
    assert {r.loop: r.area for r in curves.measures(turned).collect()} == {1: 8.0, 2: 8.0, 3: 0.0, 4: 0.0}
    assert {r.area for r in curves.measures(curves.oriented(loops, False)).where("loop < 3").collect()} == {-8.0}
    fine = curves.refined(loops, least=4)
    own = lambda k: [(r.seq, r.x, r.y) for r in fine.where(f"loop = {k}").orderBy("seq").collect()]
    assert own(1) == [(0, 0, 0), (1, 2, 0), (2, 4, 0), (3, 6, 0), (4, 8, 0), (5, 8, 1), (6, 6, 1), (7, 4, 1), (8, 2, 1), (9, 0, 1)]
    assert len(own(3)) == 3 and own(4) == [(0, 1, 1)]
    assert curves.refined(loops.limit(0)).count() == 0
