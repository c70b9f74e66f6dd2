import pytest

from trellis.operators import mesh
from trellis.operators.relation import incidences
from trellis.sources import meshes, meshfiles, store
from trellis.streaming import incidence
from pyspark.sql import functions as F


def test_mesh_formats_round_trip(spark, tmp_path):
    rows, coords = mesh.rectangle(spark, 3, 2)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    kind = meshes.TAGGED_KINDS["triangle"]
    meshes.write_tagged(rows.withColumn("kind", F.lit(kind)), coords, str(tmp_path / "a.msh"))
    got, at = meshes.read_tagged(spark, str(tmp_path / "a.msh"))
    assert same(got.select("elem", "nodes"), rows.select("elem", "nodes")) and same(at.select("node", "x", "y", "z"), coords)
    meshes.write_blocks(rows, coords, str(tmp_path / "b.msh"))
    got, at = meshes.read_blocks(spark, str(tmp_path / "b.msh"))
    assert same(got.select("elem", "nodes"), rows.select("elem", "nodes")) and same(at.select("node", "x", "y", "z"), coords)
    meshes.write_steps(rows, coords, str(tmp_path / "case"), "plate", [0.0, 1.0])
    assert spark.read.text(str(tmp_path / "case" / "plate_0002.geo")).count() == 6 + 2 * 12 + 4 + 12
    typed = incidences(rows).select(F.lit("tri").alias("etype"), F.lit("node").alias("ntype"), "elem", "pos", "node")
    meshes.write_relation(typed, str(tmp_path / "t.json"))
    assert same(meshes.read_relation(spark, str(tmp_path / "t.json")), typed)


def test_market_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 2.0), (1, 0, -1.5), (0, 1, -1.5)], "i long, j long, v double")
    meshes.write_market(cells, 2, 2, str(tmp_path / "m.mtx"), symmetric=True)
    got, rows, columns = meshes.read_market(spark, str(tmp_path / "m.mtx"))
    assert (rows, columns) == (2, 2) and sorted(map(tuple, got.collect())) == sorted(map(tuple, cells.collect()))


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:10:00"), (2, "b", "2024-01-02 00:00:00")], "user_id long, event_type string, ts string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_type string, ts timestamp").parquet(str(tmp_path / "in"))
    incidence.maintain(incidence.new_pairs(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, store.relation_store(spark, str(tmp_path / "out"), schema="elem long, node string").read().collect())) == [(1, "a"), (2, "b")]
    query = incidence.windowed_degrees(stream).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("degrees").agg(F.sum("incidences")).first()[0] == 3


MESH = """$MeshFormat
2.2 0 8
$EndMeshFormat
$PhysicalNames
1
2 7 "two words"
$EndPhysicalNames
$Nodes
3
10 0 0 0
11 1.5 0 0
12 0 -2e3 1
$EndNodes
$Elements
2
1 2 2 7 3 10 11 12
2 1 0 10 11
$EndElements
"""
MORE = "$Nodes\n1\n13 4 4 4\n$EndNodes\n$Elements\n1\n3 15 1 9 13\n$EndElements"


def test_mesh_files_by_ranges(spark, tmp_path):
    (tmp_path / "a.msh").write_text(MESH + MORE)
    (tmp_path / "b.msh").write_text(MORE.replace("\n", "\r\n"))
    (tmp_path / "c.msh").write_text("")
    for size in (7, 40, 1 << 20):
        read = meshfiles.read_sections(spark, str(tmp_path), range_bytes=size)
        nodes = sorted((r.file[-5:], r.id, r.x, r.y, r.z) for r in read["nodes"].collect())
        assert nodes == [("a.msh", 10, 0, 0, 0), ("a.msh", 11, 1.5, 0, 0), ("a.msh", 12, 0, -2000, 1), ("a.msh", 13, 4, 4, 4), ("b.msh", 13, 4, 4, 4)]
        cells = sorted((r.file[-5:], r.id, r.kind, r.tag, r.entity, r.nodes) for r in read["elements"].collect())
        assert cells == [("a.msh", 1, 2, 7, 3, [10, 11, 12]), ("a.msh", 2, 1, None, None, [10, 11]), ("a.msh", 3, 15, 9, None, [13]), ("b.msh", 3, 15, 9, None, [13])]
        assert len({r.block for r in read["elements"].where("file like '%a.msh'").collect()}) == 2
        assert [(r.dim, r.tag, r.name) for r in read["names"].collect()] == [(2, 7, "two words")]


def test_mesh_of_parts_and_open_sections(spark, tmp_path):
    head, tail = MESH[: MESH.index("11 1.5")], MESH[MESH.index("11 1.5") :]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part-0").write_text(head)
    (tmp_path / "m" / "part-1").write_text(tail)
    (tmp_path / "m" / "_SUCCESS").write_text("")
    read = meshfiles.read_sections(spark, str(tmp_path / "m"), one=True, range_bytes=16)
    assert sorted(r.id for r in read["nodes"].collect()) == [10, 11, 12] and read["elements"].count() == 2
    with pytest.raises(ValueError, match="not closed"):
        meshfiles.read_sections(spark, str(tmp_path / "m"))
