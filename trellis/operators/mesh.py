"""Simplex meshes: generators, edges, refinement, interpolation, quality, smoothing.

Elements are rows ``elem, nodes``; coordinates ``node, x, y, z``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.functions import geometry as g
from trellis.operators.cells import points_in_polygons  # noqa: F401  (part of this module's interface)
from trellis.operators.components import connected_components
from trellis.operators.query import node_neighbours
from trellis.operators.relation import dealt_in_order, incidences, numbered_in_order, pairs
from trellis.operators.splits import LOCAL_EDGES, closed_marks, sides, split
from trellis.operators.topology import boundary_nodes
from trellis.plans.lineage import cut, discard, written


def rectangle(spark: SparkSession, nx: int, ny: int, width: float = 1.0, height: float = 1.0, quads: bool = False) -> tuple[DataFrame, DataFrame]:
    """A grid of nx by ny cells: quadrilaterals, or two triangles each; nodes row by row."""
    i, j = F.col("id") % (nx + 1), F.floor(F.col("id") / (nx + 1))
    coords = spark.range((nx + 1) * (ny + 1)).select(F.col("id").alias("node"), (i * width / nx).alias("x"), (j * height / ny).alias("y"), F.lit(0.0).alias("z"))
    low = F.col("id") % nx + F.floor(F.col("id") / nx) * (nx + 1)
    a, b, c, d = low, low + 1, low + nx + 2, low + nx + 1
    cells = spark.range(nx * ny)
    if quads:
        return cells.select(F.col("id").alias("elem"), F.array(a, b, c, d).alias("nodes")), coords
    both = cells.select("id", F.posexplode(F.array(F.array(a, b, c), F.array(a, c, d))).alias("k", "nodes"))
    return both.select((F.col("id") * 2 + F.col("k")).alias("elem"), "nodes"), coords


#: The six tetrahedra of a cell around its long diagonal, by corner numbers in bits x, y, z (fixed values).
CUBE = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]


def box(spark: SparkSession, nx: int, ny: int, nz: int, size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """A grid of cells, six tetrahedra each."""
    n = F.col("id")
    sx, sy = nx + 1, (nx + 1) * (ny + 1)
    coords = spark.range(sy * (nz + 1)).select(n.alias("node"), (n % sx * size[0] / nx).alias("x"), (F.floor(n % sy / sx) * size[1] / ny).alias("y"), (F.floor(n / sy) * size[2] / nz).alias("z"))
    low = n % nx + F.floor(n % (nx * ny) / nx) * sx + F.floor(n / (nx * ny)) * sy
    corner = [low + (k & 1) + (k >> 1 & 1) * sx + (k >> 2) * sy for k in range(8)]
    cells = spark.range(nx * ny * nz).select("id", F.posexplode(F.array(*(F.array(*(corner[k] for k in t)) for t in CUBE))).alias("k", "nodes"))
    return cells.select((F.col("id") * 6 + F.col("k")).alias("elem"), "nodes"), coords


def edges(rows: DataFrame) -> DataFrame:
    """Different ``a, b`` (a < b): all pairs of nodes of each simplex."""
    every = incidences(rows)
    return every.select("elem", F.col("node").alias("a")).join(every.select("elem", F.col("node").alias("b")), "elem").where("a < b").select("a", "b").distinct()


def located(rows: DataFrame, coords: DataFrame, size: int) -> DataFrame:
    """Elements of ``size`` nodes with their corners' columns ``p0x`` and so on: one join and one grouping."""
    # Never by broadcast: what comes of arrays is many times what plans expect.
    placed = incidences(rows.where(F.size("nodes") == size)).join(coords.select("node", "x", "y", "z").hint("merge"), "node")
    corner = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"p{k}{c}")
    return placed.groupBy("elem").agg(*(corner(k, c) for k in range(size) for c in "xyz"))


def boxes(rows: DataFrame, coords: DataFrame) -> DataFrame:
    """``elem``, the corners ``x0, y0, z0, x1, y1, z1`` of its box, and its middle ``cx, cy, cz``, the mean of its nodes."""
    placed = incidences(rows).join(coords.select("node", "x", "y", "z"), "node")
    return placed.groupBy("elem").agg(*(F.min(c).alias(c + "0") for c in "xyz"), *(F.max(c).alias(c + "1") for c in "xyz"), *(F.avg(c).alias("c" + c) for c in "xyz"))


def edge_lengths(rows: DataFrame, coords: DataFrame) -> DataFrame:
    """``a, b, length`` of the different edges."""
    one, two = (coords.select(F.col("node").alias(k), *(F.col(c).alias(k + c) for c in "xyz")) for k in "ab")
    return edges(rows).join(one, "a").join(two, "b").select("a", "b", g.distance(g.point("a"), g.point("b")).alias("length"))


def triangle_quality(rows: DataFrame, coords: DataFrame) -> DataFrame:
    a, b, c = (g.point(f"p{k}") for k in range(3))
    return located(rows, coords, 3).select("elem", g.triangle_area(a, b, c).alias("area"), g.triangle_aspect(a, b, c).alias("aspect"), g.smallest_angle(a, b, c).alias("min_angle"))


def tetra_quality(rows: DataFrame, coords: DataFrame) -> DataFrame:
    p = [g.point(f"p{k}") for k in range(4)]
    return located(rows, coords, 4).select("elem", g.tetra_volume(*p).alias("volume"), g.tetra_aspect(*p).alias("aspect"))


def quality_summary(quality: DataFrame, value: str = "aspect") -> DataFrame:
    return quality.agg(F.count("*").alias("elements"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"))


def without_degenerate(rows: DataFrame, coords: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Triangles with an area and tetrahedra with a volume beyond the tolerance; others stay."""
    flat = triangle_quality(rows, coords).where(F.col("area") <= tolerance).select("elem").unionAll(
        tetra_quality(rows, coords).where(F.abs("volume") <= tolerance).select("elem"))
    return rows.join(flat, "elem", "left_anti")


def refine(rows: DataFrame, coords: DataFrame, marks: DataFrame | None = None, close: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split marked edges (``a, b``; all without marks) of bars, triangles and tetrahedra, which may be mixed.

    Neighbours agree on what they share, whichever edges are marked (``splits``).  With ``close``, tetrahedra of one or two marked edges
    have all six split.  Results: child rows ``elem, nodes, parent``, coordinates with the new middles, and the middles'
    ``node, parent1, parent2``.  New nodes follow the largest old one, in order of their ends.
    """
    rows = written(rows)  # read three times
    every = sides(rows).select("a", "b").distinct()
    if marks is not None:
        wanted = closed_marks(rows, marks) if close else marks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        every = every.join(wanted, ["a", "b"], "left_semi")
    ends = cut(every)
    top = coords.agg(F.max("node")).first()[0]
    middles = numbered_in_order(dealt_in_order(ends, "a", "b")).select((F.col("new") + top + 1).alias("node"), F.col("a").alias("parent1"), F.col("b").alias("parent2"))
    discard(ends)
    out = split(rows, middles.select("node", F.col("parent1").alias("a"), F.col("parent2").alias("b")))
    return out, coords.select("node", "x", "y", "z").unionByName(interpolate(middles, coords)), middles


def interpolate(middles: DataFrame, coords: DataFrame) -> DataFrame:
    """Coordinates of middles between their parents."""
    one = coords.select(F.col("node").alias("parent1"), *(F.col(c).alias(c + "1") for c in "xyz"))
    two = coords.select(F.col("node").alias("parent2"), *(F.col(c).alias(c + "2") for c in "xyz"))
    return middles.join(one, "parent1").join(two, "parent2").select("node", *(((F.col(c + "1") + F.col(c + "2")) / 2).alias(c) for c in "xyz"))


def smooth(rows: DataFrame, coords: DataFrame, rounds: int = 1, weight: float = 1.0) -> DataFrame:
    """Inner nodes moved towards the mean of their neighbours, all at once in every round."""
    fixed = cut(boundary_nodes(rows, rows.select(F.size("nodes")).first()[0] - 1))
    near = cut(node_neighbours(pairs(incidences(rows))).join(fixed, "node", "left_anti"))
    for _ in range(rounds):
        mean = near.join(coords.select(F.col("node").alias("neighbour"), "x", "y", "z"), "neighbour").groupBy("node").agg(*(F.avg(c).alias("m" + c) for c in "xyz"))
        coords = cut(coords.join(mean, "node", "left").select("node", *((F.col(c) + weight * F.coalesce(F.col("m" + c) - F.col(c), F.lit(0.0))).alias(c) for c in "xyz")))
    return coords


def opened(rows: DataFrame, coords: DataFrame, level: str, where: str | None = None, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A mesh of triangles, or of tetrahedra, cut and opened along the zeros of a field: an SQL expression of ``coords``' columns, linear on edges.

    Edges whose ends have opposite signs get a node at their root, and elements are split so that each child lies on
    one side.  A facet whose nodes are all zeros, between a child above and children below, is opened; with ``where``, a condition on columns of
    ``coords`` (at a new node, those of x, y and z), only if it holds at all its nodes.  A node of an opened facet is copied once for each further
    set of elements around it that hang together by facets that are not opened: so lips part, and the ends of a crack stay one.

    Results: ``elem, nodes, parent``; coordinates of all nodes; and ``node, root, a, b``, the new nodes, where ``root`` is the
    node that a copy lies on (itself for one on the edge a, b; a and b are null for copies).  Values within ``tolerance`` are zeros; a null one is an error.
    """
    sizes = [r[0] for r in rows.select(F.size("nodes")).distinct().limit(3).collect()]
    if len(sizes) > 1 or sizes and sizes[0] not in (3, 4):
        raise ValueError("only meshes of triangles alone or of tetrahedra alone can be cut")
    size = sizes[0] if sizes else 3
    known = F.coalesce(F.expr(level).cast("double"), F.raise_error(F.lit("a node without a value")).cast("double"))
    at = coords.select("node", "x", "y", "z", known.alias("v")).withColumn("v", F.when(F.abs("v") <= tolerance, 0.0).otherwise(F.col("v")))
    one, two = (at.select(F.col("node").alias(k), *(F.col(c).alias(c + k) for c in "xyzv")) for k in "ab")
    crossed = sides(rows).select("a", "b").distinct().join(one, "a").join(two, "b").where("va * vb < 0")
    crossed = cut(crossed.select(F.struct("a", "b").alias("ab"), *((F.col(c + "a") + F.col("va") / (F.col("va") - F.col("vb")) * (F.col(c + "b") - F.col(c + "a"))).alias(c) for c in "xyz")))
    top = coords.agg(F.coalesce(F.max("node"), F.lit(-1))).first()[0]
    numbered = numbered_in_order(dealt_in_order(crossed, "ab"))
    roots = numbered.select((F.col("new") + top + 1).alias("node"), "ab.a", "ab.b", "x", "y", "z")
    children = split(rows, roots)
    discard(crossed)

    places = coords.select("node", "x", "y", "z").unionByName(roots.select("node", "x", "y", "z"))
    inside = F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))
    level_at = F.when(F.abs(known) <= tolerance, 0.0).otherwise(known)
    values = coords.select("node", level_at.alias("v"), F.when(level_at == 0, inside).otherwise(False).alias("open")).unionByName(roots.select("node", F.lit(0.0).alias("v"), inside.alias("open")))
    met = incidences(children).join(values, "node").groupBy("elem").agg((F.sum("v") > 0).alias("above"), F.array_sort(F.collect_list(F.struct("pos", "node", (F.col("v") == 0).alias("zero"), "open"))).alias("p"))
    # Children that hold a zero, with what is known of their nodes: only their facets can be opened, or hold elements around a zero together.
    kids = cut(met.where(F.exists("p", lambda q: q["zero"])))
    # A node's place in a child has a number of its own, the first if it stands there twice.
    own = lambda k: (F.col("elem") * size + F.array_position(F.transform("p", lambda q: q["node"]), F.col("p")[k]["node"]) - 1).alias("id")
    zero = lambda some: F.filter(F.array(*(F.struct(F.col("p")[k]["node"].alias("node"), own(k), F.col("p")[k]["zero"].alias("zero")) for k in some)), lambda q: q["zero"])

    def side(without: int) -> Column:
        some = [k for k in range(size) if k != without]
        facet = F.array_sort(F.array(*(F.col("p")[k]["node"] for k in some)))
        ready = F.size(F.array_distinct(facet)) == size - 1
        for k in some:
            ready = ready & F.col("p")[k]["zero"] & F.col("p")[k]["open"]
        return F.struct(facet.alias("facet"), ready.alias("ready"), zero(some).alias("zeros"))

    shared = kids.select("above", F.explode(F.array(*map(side, range(size)))).alias("s")).select("above", "s.*").where("size(zeros) > 0")
    parted = cut(shared.where("ready").groupBy("facet").agg((F.min("above") != F.max("above")).alias("both")).where("both").select("facet"))
    lips = cut(parted.select(F.explode("facet").alias("node")).distinct())

    around = kids.select("elem", "above", F.explode(zero(range(size))).alias("z")).select("z.node", "z.id", "elem", "above").join(lips, "node", "left_semi")
    kept = shared.where("not ready").select("facet", "zeros").unionByName(shared.where("ready").select("facet", "zeros").join(parted, "facet", "left_anti"))
    held = cut(kept.select("facet", F.explode("zeros").alias("z")).select("facet", "z.node", "z.id").join(lips, "node", "left_semi"))
    hub = held.groupBy("facet", "node").agg(F.min("id").alias("first"))
    links = held.join(hub, ["facet", "node"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    sets = connected_components(links, apart=True)
    # The first set below, or else the first of all, keeps the node.
    named = cut(around.join(sets.withColumnRenamed("node", "id"), "id", "left").select("node", "elem", F.coalesce("component", "id").alias("set"), "above"))
    discard(held, parted, lips, kids)
    first = named.groupBy("node", "set").agg(F.bool_and("above").alias("up"), F.min("elem").alias("elem"))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("up", "elem"))).where("nth > 1")
    copied = cut(ranked.select("node", "nth", "set"))
    tip = top + 1 + roots.count()
    copies = numbered_in_order(dealt_in_order(copied, "node", "nth")).select("node", "set", (F.col("new") + tip).alias("copy"))
    moved = named.join(copies, ["node", "set"]).groupBy("elem").agg(F.collect_list(F.struct("node", "copy")).alias("m"))
    renamed = F.transform("nodes", lambda n: F.coalesce(F.get(F.filter("m", lambda c: c["node"] == n), F.lit(0))["copy"], n))
    out = cut(children.join(moved, "elem", "left").select("elem", F.when(F.col("m").isNull(), F.col("nodes")).otherwise(renamed).alias("nodes"), "parent"))
    more = copies.join(places, "node").select(F.col("copy").alias("node"), "x", "y", "z")
    made = roots.select("node", F.col("node").alias("root"), "a", "b").unionByName(copies.select(F.col("copy").alias("node"), F.col("node").alias("root")), allowMissingColumns=True)
    discard(named, copied)
    return out, places.unionByName(more), made


def cracked(rows: DataFrame, coords: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """The mesh and coordinates of ``opened`` along a whole level set."""
    return opened(rows, coords, level)[:2]


def signed_area(loops: DataFrame) -> DataFrame:
    """``loop, area`` of closed polygons given as ``loop, seq, x, y``; counter-clockwise is positive."""
    order = Window.partitionBy("loop").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    turned = loops.select("loop", (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("t"))
    return turned.groupBy("loop").agg((F.sum("t") / 2).alias("area"))


def arc_length(curves: DataFrame) -> DataFrame:
    """``curve, seq, s``: the length along each open curve (curve, seq, x, y, z) up to each point."""
    order = Window.partitionBy("curve").orderBy("seq")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(order)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(order)) ** 2))
    walked = curves.select("curve", "seq", F.coalesce(step, F.lit(0.0)).alias("d"))
    return walked.select("curve", "seq", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))


def boundary_loops(rows: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``loop, seq, node``: the closed boundary curves of consistently turned triangles.

    A boundary edge runs as its triangle does, and each boundary node has one edge out.  A loop is
    named by its smallest node, from which ``seq`` counts.  Places are found by doubling: each round
    every node learns where the next 2^k steps lead, so long curves need few rounds.
    """
    local = F.array(*(F.array(F.col("nodes")[i], F.col("nodes")[j]) for i, j in LOCAL_EDGES[3]))
    directed = rows.where("size(nodes) = 3").select(F.explode(local).alias("e")).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
    back = directed.select(F.col("b").alias("a"), F.col("a").alias("b"))
    step = cut(directed.join(back, ["a", "b"], "left_anti"))
    named = cut(connected_components(step))
    # Distance to the loop's smallest node along the edges, with that node as the end.
    now = cut(step.join(named.select(F.col("node").alias("a"), F.col("component").alias("loop")), "a").select(
        "a", "loop", F.when(F.col("a") == F.col("loop"), F.col("a")).otherwise(F.col("b")).alias("to"), F.when(F.col("a") == F.col("loop"), 0).otherwise(1).cast("long").alias("d")))
    for step in range(max_rounds + 1):
        if now.where("to <> loop").isEmpty():
            break
        if step == max_rounds:
            raise RuntimeError(f"a border of more than 2^{max_rounds} edges, or one that does not close")
        far = now.select(F.col("a").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        now = cut(now.join(far, "to").select("a", "loop", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d")))
    size = now.groupBy("loop").agg(F.count("*").alias("n"))
    return now.join(size, "loop").select("loop", ((F.col("n") - F.col("d")) % F.col("n")).alias("seq"), F.col("a").alias("node"))


def resample(curves: DataFrame, points: int) -> DataFrame:
    """``curve, k, x, y, z``: ``points`` places evenly spaced along each open curve (curve, seq, x, y, z)."""
    along = curves.join(arc_length(curves), ["curve", "seq"])
    order = Window.partitionBy("curve").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    legs = along.select("curve", "s", F.lead("s").over(order).alias("s2"), F.last("s").over(whole).alias("total"), *(c for c in "xyz"), *(F.lead(c).over(order).alias(c + "2") for c in "xyz"))
    upto = lambda s: F.floor(F.col(s) / (F.col("total") / (points - 1)) + 1e-9 * (points - 1))
    # A leg carries the places in (s, s2], the first one with a length also the start: points may repeat there.
    low = F.when(F.col("s") <= 0, F.lit(0)).otherwise(upto("s") + 1)
    high = F.least(upto("s2"), F.lit(points - 1))
    legs = legs.where("s2 > s and total > 0").withColumn("k", F.explode(F.when(high >= low, F.sequence(low.cast("int"), high.cast("int")))))
    # A leg's own length, not the difference of two sums: places that are exact in decimals stay so.
    d = F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2 + (F.col("z2") - F.col("z")) ** 2)
    t = (F.col("k") * F.col("total") / (points - 1) - F.col("s2") + d) / d
    return legs.select("curve", "k", *((F.col(c) + t * (F.col(c + "2") - F.col(c))).alias(c) for c in "xyz"))
