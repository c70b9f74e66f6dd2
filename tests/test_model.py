"""Attributes and symmetries that follow renumbering, and files of whole models."""

import pytest

from trellis.operators import model, symmetry
from trellis.sources import meshes


@pytest.fixture
def made(spark):
    typed = spark.createDataFrame([("tri", "node", 5, k, n) for k, n in enumerate((10, 20, 30))] + [("tri", "node", 7, k, n) for k, n in enumerate((20, 30, 10))]
                                  + [("tri", "node", 9, k, n) for k, n in enumerate((30, 20, 40))] + [("body", "tri", 1, 0, 7), ("body", "tri", 1, 1, 9), ("body", "tri", 2, 0, 5)], "etype string, ntype string, elem long, pos int, node long")
    tri = spark.createDataFrame([(5, 1, "a"), (9, 3, None)], "id long, material int, `new` string")
    node = spark.createDataFrame([(n, float(n), [n, None]) for n in (10, 20, 30, 40, 50)], "id long, x double, `old` array<long>")
    return model.Model(typed, {"tri": tri, "node": node}, {"tri": symmetry.cyclic(3)})


def held(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_compression_moves_attributes(spark, made):
    out, maps = model.compress(made, spark.createDataFrame([("node", 40)], "type string, id long"))
    # The triangle that held node 40 is gone, and the body that held the triangle.
    assert held(maps) == held(spark.createDataFrame([("body", 2, 0), ("node", 10, 0), ("node", 20, 1), ("node", 30, 2), ("node", 50, 3), ("tri", 5, 0), ("tri", 7, 1)], "a string, b long, c long"))
    assert held(out.attributes["tri"]) == [(0, 1, "a")] and out.attributes["tri"].columns == ["id", "material", "new"]
    assert held(out.attributes["node"]) == [(0, 10.0, [10, None]), (1, 20.0, [20, None]), (2, 30.0, [30, None]), (3, 50.0, [50, None])]
    assert held(out.typed) == sorted([("body", "tri", 0, 0, 0), *(("tri", "node", 0, k, k) for k in range(3)), *(("tri", "node", 1, k, n) for k, n in enumerate((1, 2, 0)))], key=repr)
    assert out.symmetries == made.symmetries


def test_clones_by_predicate(spark, made):
    out, maps = model.clone_where(made, "tri", "node", "material > 2")
    assert held(maps) == [("node", 20, 0), ("node", 30, 1), ("node", 40, 2), ("tri", 9, 0)]
    assert held(out.typed) == [("tri", "node", 0, 0, 1), ("tri", "node", 0, 1, 0), ("tri", "node", 0, 2, 2)] and held(out.attributes["tri"]) == [(0, 3, None)]
    out, maps = model.clone_where(made, "tri", "node", "material is null", orphans=True)
    assert held(maps.where("type = 'tri'")) == [("tri", 7, 0)] and out.attributes["node"].count() == 5 and out.attributes["tri"].count() == 0
    out, maps = model.clone_where(made, "body", "tri", "id = 2")
    assert held(out.typed) == [("body", "tri", 0, 0, 0)] and set(out.attributes) == {"tri"} and held(out.attributes["tri"]) == [(0, 1, "a")]
    out, maps = model.clone_where(made, "tri", "node", "false")
    assert out.typed.count() == maps.count() == 0


def test_doubles_up_to_symmetry(spark, made):
    out, maps = model.without_duplicates(made, "tri", "node")
    assert held(maps.where("type = 'tri'")) == [("tri", 5, 0), ("tri", 9, 1)]
    assert held(out.typed.where("etype = 'body'")) == [("body", "tri", 0, 0, 0), ("body", "tri", 0, 1, 1), ("body", "tri", 1, 0, 0)]


def test_files_of_models(spark, made, tmp_path):
    path = str(tmp_path / "m")
    meshes.write_model(made, path)
    back = meshes.read_model(spark, path)
    assert held(back.typed) == held(made.typed) and back.symmetries == made.symmetries and back.types() == ["body", "node", "tri"]
    for kind, table in made.attributes.items():
        assert held(back.attributes[kind]) == held(table) and back.attributes[kind].schema == table.schema
    rows = spark.read.json(f"{path}/canonical/2-1")
    assert sorted((r.elem, r.nodes) for r in rows.collect()) == [(5, [10, 20, 30]), (7, [10, 20, 30]), (9, [20, 40, 30])]
    bare = model.Model(made.typed.limit(0))
    meshes.write_model(bare, path + "0")
    assert meshes.read_model(spark, path + "0").types() == []
