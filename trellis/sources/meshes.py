"""Mesh and matrix files read and written as text tables.

Files are read by Spark's text reader as one line a row, with each line's place in the file, so
that sections are found by joins of places, whatever the partitions.
"""

from __future__ import annotations

import json
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.operators.relation import renumber
from trellis.operators.model import Model, canonical_rows
from trellis.plans.lineage import cut, written


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``nth, line`` of a text file, or of the part files of a folder in order of name, from 0.

    A line's number is its place within the block of the file that was read, plus the lines of
    the blocks before; there is one row for each block in the sums.
    """
    read = cut(spark.read.text(path).select(
        F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = read.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("low")).select("block", "low", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    return read.join(F.broadcast(counts), "block").select((F.col("offset") + F.col("at") - F.col("low")).alias("nth"), "line")


def _between(text: DataFrame, opens: str, closes: str) -> DataFrame:
    """Lines of the sections between a line ``opens`` and the next ``closes``, with ``k`` from 0 within it."""
    trimmed = F.lower(F.trim("line"))
    heads = [r[0] for r in text.where(trimmed == opens.lower()).select("nth").orderBy("nth").collect()]
    tails = [r[0] for r in text.where(trimmed == closes.lower()).select("nth").orderBy("nth").collect()]
    inside, start = F.lit(False), F.lit(None).cast("long")
    for a, b in zip(heads, tails):
        inside = inside | F.col("nth").between(a + 1, b - 1)
        start = F.when(F.col("nth").between(a + 1, b - 1), F.lit(a + 1)).otherwise(start)
    return text.where(inside).select((F.col("nth") - start).alias("k"), F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "").alias("w"))


#: Kinds of the tagged format by number: nodes of an element (fixed values).
TAGGED_SIZES = {1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 6: 6, 7: 5, 15: 1}
TAGGED_KINDS = {"point": 15, "bar": 1, "triangle": 2, "quad": 3, "tetra": 4, "hexa": 5, "prism": 6}


def read_tagged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A mesh in the sectioned format 2.x: ``elem, kind, tag, nodes`` and ``node, x, y, z``.

    Ids in the file become dense from 0, in their order.
    """
    text = cut(lines(spark, path))
    nodes = _between(text, "$Nodes", "$EndNodes").where("k > 0")
    coords = nodes.select(F.get("w", F.lit(0)).try_cast("long").alias("id"), *(F.get("w", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")))
    named = cut(renumber(coords, "id"))
    elements = _between(text, "$Elements", "$EndElements").where("k > 0")
    cells = elements.select("k", F.get("w", F.lit(1)).try_cast("int").alias("kind"), F.get("w", F.lit(2)).try_cast("int").alias("tags"), F.get("w", F.lit(3)).try_cast("int").alias("tag"), "w")
    cells = cells.select((F.col("k") - 1).alias("elem"), "kind", F.when(F.col("tags") > 0, F.col("tag")).alias("tag"), F.expr("transform(slice(w, 4 + tags, size(w)), x -> try_cast(x as bigint))").alias("ids"))
    placed = cells.select("elem", "kind", "tag", F.posexplode("ids").alias("pos", "old")).join(named, "old")
    rows = placed.groupBy("elem", "kind", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda p: p["new"]).alias("nodes"))
    return rows, coords.join(named, F.col("id") == F.col("old")).select(F.col("new").alias("node"), "x", "y", "z")


def _written(parts: list[DataFrame], path: str) -> None:
    """Write blocks of ``nth, line`` one after the other, as ordered part files of text."""
    out = None
    for i, part in enumerate(parts):
        own = part.select(F.lit(i).alias("block"), F.col("nth").cast("long").alias("nth"), "line")
        out = own if out is None else out.unionByName(own)
    out.repartitionByRange("block", "nth").sortWithinPartitions("block", "nth").select("line").write.mode("overwrite").text(path)


def _said(spark: SparkSession, *said: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(said)), "nth long, line string")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``dim, tag, name`` of the named groups of a sectioned file."""
    listed = _between(cut(lines(spark, path)), "$PhysicalNames", "$EndPhysicalNames").where("k > 0")
    return listed.select(F.get("w", F.lit(0)).try_cast("int").alias("dim"), F.get("w", F.lit(1)).try_cast("int").alias("tag"), F.trim(F.lit('"'), F.array_join(F.slice("w", 3, 1000), " ")).alias("name"))


def write_plain(rows: DataFrame, coords: DataFrame, path: str) -> None:
    """Plain text: the numbers of nodes and elements, a line of coordinates a node, a line of node numbers (from 0) an element."""
    spark = rows.sparkSession
    rows, coords = written(rows), written(coords)  # counted, then dealt by samples
    nodes = coords.select(F.col("node").alias("nth"), F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz")).alias("line"))
    cells = rows.select(F.col("elem").alias("nth"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), " ").alias("line"))
    _written([_said(spark, f"{coords.count()} {rows.count()}"), nodes, cells], path)


def write_tagged(rows: DataFrame, coords: DataFrame, path: str, tag: str = "0", names: DataFrame | None = None) -> None:
    """``elem, kind, nodes`` and coordinates in the sectioned format 2.2, ids from 1, as ordered part files.

    ``tag`` is a number or a column; ``names`` (dim, tag, name) become the named groups.
    """
    spark = rows.sparkSession
    rows, coords = written(rows), written(coords)  # counted, then dealt by samples
    number = lambda c: F.col(c).cast("string")
    nodes = coords.select(F.col("node").alias("nth"), F.concat_ws(" ", (F.col("node") + 1).cast("string"), *(number(c) for c in "xyz")).alias("line"))
    tagged = F.lit(tag) if tag.isdigit() else F.col(tag).cast("string")
    cells = rows.select(F.col("elem").alias("nth"), F.concat_ws(" ", (F.col("elem") + 1).cast("string"), number("kind"), F.lit("2"), tagged, tagged, F.array_join(F.transform("nodes", lambda n: (n + 1).cast("string")), " ")).alias("line"))
    groups = []
    if names is not None:
        said = names.select(F.col("tag").alias("nth"), F.concat(F.col("dim").cast("string"), F.lit(" "), F.col("tag").cast("string"), F.lit(' "'), F.col("name"), F.lit('"')).alias("line"))
        groups = [_said(spark, "$PhysicalNames", str(names.count())), said, _said(spark, "$EndPhysicalNames")]
    _written([_said(spark, "$MeshFormat", "2.2 0 8", "$EndMeshFormat"), *groups, _said(spark, "$Nodes", str(coords.count())), nodes,
              _said(spark, "$EndNodes", "$Elements", str(rows.count())), cells, _said(spark, "$EndElements")], path)


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A mesh in the block format (``MESH ... Coordinates ... Elements ...``): ``elem, tag, nodes`` and coordinates."""
    text = cut(lines(spark, path))
    head = text.where(F.lower(F.trim("line")).startswith("mesh")).orderBy("nth").first().line
    size = int(head.lower().split("nnode")[1].split()[0])
    coords = _between(text, "Coordinates", "End Coordinates")
    coords = coords.select(F.get("w", F.lit(0)).try_cast("long").alias("id"), F.get("w", F.lit(1)).try_cast("double").alias("x"), F.get("w", F.lit(2)).try_cast("double").alias("y"), F.coalesce(F.try_element_at("w", F.lit(4)).try_cast("double"), F.lit(0.0)).alias("z"))
    named = cut(renumber(coords, "id"))
    cells = _between(text, "Elements", "End Elements").select(F.col("k").alias("elem"), F.try_element_at("w", F.lit(size + 2)).try_cast("int").alias("tag"), F.transform(F.slice("w", 2, size), lambda x: x.try_cast("long")).alias("ids"))
    placed = cells.select("elem", "tag", F.posexplode("ids").alias("pos", "old")).join(named, "old")
    rows = placed.groupBy("elem", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda p: p["new"]).alias("nodes"))
    return rows, coords.join(named, F.col("id") == F.col("old")).select(F.col("new").alias("node"), "x", "y", "z")


def write_blocks(rows: DataFrame, coords: DataFrame, path: str, kind: str = "Triangle", tag: int = 1) -> None:
    """Rows of one size in the block format, ids from 1, as ordered part files."""
    spark = rows.sparkSession
    rows, coords = written(rows), written(coords)  # counted, then dealt by samples
    size = rows.select(F.size("nodes")).first()[0]
    nodes = coords.select(F.col("node").alias("nth"), F.concat_ws(" ", (F.col("node") + 1).cast("string"), *(F.col(c).cast("string") for c in "xyz")).alias("line"))
    cells = rows.select(F.col("elem").alias("nth"), F.concat_ws(" ", (F.col("elem") + 1).cast("string"), F.array_join(F.transform("nodes", lambda n: (n + 1).cast("string")), " "), F.lit(str(tag))).alias("line"))
    _written([_said(spark, f"MESH dimension 3 ElemType {kind} Nnode {size}", "Coordinates"), nodes, _said(spark, "End Coordinates", "Elements"), cells, _said(spark, "End Elements")], path)


def write_steps(rows: DataFrame, coords: DataFrame, path: str, name: str, times: list[float], kind: str = "tria3", variables: dict[str, str] | None = None) -> None:
    """A case folder of numbered geometry, one for each time: text parts beside a ``.case`` listing.

    ``variables`` name the files that ``write_values`` writes beside it, and whether each is ``scalar`` or ``vector``.
    """
    spark = rows.sparkSession
    rows, coords = written(rows), written(coords)  # counted, then dealt by samples
    spaced = lambda c: F.format_string("%12.5e", F.col(c))
    ids = coords.select(F.col("node").alias("nth"), F.format_string("%8d", F.col("node") + 1).alias("line"))
    places = coords.select(F.col("node").alias("nth"), F.concat(*(spaced(c) for c in "xyz")).alias("line"))
    cells = rows.select(F.col("elem").alias("nth"), F.concat(F.format_string("%8d", F.col("elem") + 1), F.array_join(F.transform("nodes", lambda n: F.format_string("%8d", n + 1)), "")).alias("line"))
    for step, _ in enumerate(times, 1):
        _written([_said(spark, name, "geometry", "node id given", "element id given", "coordinates", f"{coords.count():8d}"), ids, places,
                  _said(spark, "part 1", name, kind, f"{rows.count():8d}"), cells], f"{path}/{name}_{step:04d}.geo")
    said = ["FORMAT", "type: ensight", "GEOMETRY", f"model: 1 {name}_****.geo", *(["VARIABLE"] if variables else []), *(f"{k} per node: 1 {v} {v}_****.txt" for v, k in (variables or {}).items()), "TIME", "time set: 1", f"number of steps: {len(times)}", "filename start number: 1", "filename increment: 1", "time values: " + " ".join(map(str, times))]
    _written([_said(spark, *said)], f"{path}/{name}.case")


def write_values(values: DataFrame, path: str, title: str, key: str = "node", columns: tuple[str, ...] = ("v",)) -> None:
    """Scalars or vectors of the nodes for a case folder, six numbers a line."""
    flat = values.select((F.col(key) * len(columns)).alias("at"), F.posexplode(F.array(*columns)).alias("k", "v")).select((F.col("at") + F.col("k")).alias("at"), "v")
    grouped = flat.groupBy(F.floor(F.col("at") / 6).alias("nth")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: F.format_string("%12.5e", x["v"])), "").alias("line"))
    _written([_said(values.sparkSession, title), grouped], path)


def write_market(cells: DataFrame, rows: int, columns: int, path: str, symmetric: bool = False) -> None:
    """Coordinates ``i, j, v`` as exchange text, from 1; without values it is a pattern."""
    kept = cells.where("i >= j") if symmetric else cells
    pattern = kept.where("v is not null").isEmpty()
    text = F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *([] if pattern else [F.col("v").cast("string")]))
    body = kept.select((F.col("i") * columns + F.col("j")).alias("nth"), text.alias("line"))
    head = f"%%MatrixMarket matrix coordinate {'pattern' if pattern else 'real'} {'symmetric' if symmetric else 'general'}"
    _written([_said(cells.sparkSession, head, f"{rows} {columns} {kept.count()}"), body], path)


def read_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """``i, j, v`` from exchange text, symmetric halves mirrored; and the sizes."""
    text = cut(lines(spark, path))
    head = text.orderBy("nth").first().line.lower()
    body = text.where(~F.col("line").startswith("%") & (F.trim("line") != "")).select("nth", F.split(F.trim("line"), r"\s+").alias("w"))
    first = body.orderBy("nth").first()
    v = F.lit(None).cast("double") if "pattern" in head else F.get("w", F.lit(2)).try_cast("double")
    cells = body.where(F.col("nth") > first.nth).select((F.get("w", F.lit(0)).try_cast("long") - 1).alias("i"), (F.get("w", F.lit(1)).try_cast("long") - 1).alias("j"), v.alias("v"))
    if "symmetric" in head:
        cells = cells.unionAll(cells.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return cells, int(first.w[0]), int(first.w[1])


def write_relation(typed: DataFrame, path: str) -> None:
    """Typed incidences as JSON lines, one element a line."""
    grouped = typed.groupBy("etype", "ntype", "elem").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda p: p["node"]).alias("nodes"))
    grouped.write.mode("overwrite").json(path)


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema("etype string, ntype string, elem long, nodes array<long>").json(path)
    return read.select("etype", "ntype", "elem", F.posexplode("nodes").alias("pos", "node"))


def write_model(model: Model, path: str) -> None:
    """A model as JSON lines in a folder: ``relation`` as ``write_relation`` has it, ``attributes/k`` and ``canonical/k`` for the k-th type, and one line ``model``
    with the names of types, the symmetries, and the schemas of attributes.  ``canonical`` holds the rows of each type that has symmetries, in their least order."""
    spark, types = model.typed.sparkSession, model.types()
    write_relation(model.typed, f"{path}/relation")
    for kind, table in model.attributes.items():
        table.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/attributes/{types.index(kind)}")
    pairs = {(r[0], r[1]) for r in model.typed.select("etype", "ntype").distinct().collect()}  # few, as types are
    for kind in model.symmetries:
        for _, ntype in sorted(p for p in pairs if p[0] == kind):
            canonical_rows(model, kind, ntype).select(F.lit(ntype).alias("ntype"), "elem", "nodes").write.mode("overwrite").json(f"{path}/canonical/{types.index(kind)}-{types.index(ntype)}")
    said = {"types": types, "symmetries": model.symmetries, "attributes": {k: t.schema.json() for k, t in model.attributes.items()}}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> Model:
    """The model that ``write_model`` wrote to ``path``."""
    said = json.loads(spark.read.text(f"{path}/model").first()[0])
    tables = {k: spark.read.schema(T.StructType.fromJson(json.loads(s))).json(f"{path}/attributes/{said['types'].index(k)}") for k, s in said["attributes"].items()}
    return Model(read_relation(spark, f"{path}/relation"), tables, {k: [tuple(p) for p in g] for k, g in said["symmetries"].items()})
