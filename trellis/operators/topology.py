"""Sub-entities, facets, boundaries, tombstones, compaction and extraction of typed relations.

Typed incidences are ``etype, ntype, elem, pos, node``; entities and tombstones are ``type, id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.query import batch_containing_all
from trellis.operators.relation import renumber
from trellis.operators.symmetry import canonical, full
from trellis.plans.lineage import cut

#: Local node numbers of the facets of an element, by its number of nodes and the facet's (fixed values).
FACETS = {
    (3, 2): [(0, 1), (1, 2), (2, 0)],
    (4, 3): [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)],
    (8, 4): [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)],
    (6, 3): [(0, 1, 2), (3, 4, 5)],
}


def _gather(templates: list[tuple[int, ...]]):
    return F.array(*(F.array(*(F.col("nodes")[i] for i in t)) for t in templates))


def sub_entities(rows: DataFrame, templates: list[tuple[int, ...]], group: list[tuple[int, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Different sub-entities of all elements, and who has which.

    ``templates`` give local node numbers.  First result: ``sub, nodes`` in canonical order,
    numbered densely in order of nodes.  Second: ``elem, local, sub``.
    """
    group = group or full(len(templates[0]))
    least = max(max(t) for t in templates) + 1
    each = rows.where(F.size("nodes") >= least).select("elem", F.posexplode(_gather(templates)).alias("local", "s"))
    each = cut(each.select("elem", "local", canonical("s", group).alias("nodes")))
    named = cut(renumber(each, "nodes").select(F.col("old").alias("nodes"), F.col("new").alias("sub")))
    return named.select("sub", "nodes"), each.join(named, "nodes").select("elem", "local", "sub")


def facets(rows: DataFrame, size: int) -> DataFrame:
    """``elem, facet``: sorted node sets of each element's facets of ``size`` nodes.

    Facets of two nodes are consecutive pairs of the row, closed around; others follow the
    element's shape.  Elements without such facets give none.
    """
    if size == 2:
        n = F.size("nodes")
        ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_sort(F.array(F.col("nodes")[i], F.col("nodes")[(i + 1) % n])))
        # A row of two nodes has one edge, not the same one twice.
        cyclic = rows.where("size(nodes) >= 2").select("elem", F.explode(F.when(n == 2, F.array(F.array_sort("nodes"))).otherwise(ring)).alias("facet"))
        return cyclic
    out = None
    for (n, k), templates in FACETS.items():
        if k == size:
            own = rows.where(F.size("nodes") == n).select("elem", F.explode(_gather(templates)).alias("f")).select("elem", F.array_sort("f").alias("facet"))
            out = own if out is None else out.unionAll(own)
    return rows.select("elem", F.col("nodes").alias("facet")).limit(0) if out is None else out


def facet_counts(rows: DataFrame, size: int) -> DataFrame:
    """``facet, elements, first``: how many elements have each facet, and the smallest of them."""
    return facets(rows, size).groupBy("facet").agg(F.count("*").alias("elements"), F.min("elem").alias("first"))


def boundary_facets(rows: DataFrame, size: int) -> DataFrame:
    return facet_counts(rows, size).where("elements = 1").select("facet", F.col("first").alias("elem"))


def internal_facets(rows: DataFrame, size: int) -> DataFrame:
    return facet_counts(rows, size).where("elements = 2").select("facet")


def non_manifold_facets(rows: DataFrame, size: int) -> DataFrame:
    return facet_counts(rows, size).where("elements > 2").select("facet", "elements")


def boundary_nodes(rows: DataFrame, size: int) -> DataFrame:
    return boundary_facets(rows, size).select(F.explode("facet").alias("node")).distinct()


def classify_sub_entities(subs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``sub, parents, place``: elements that hold all nodes of each sub-entity (sub, nodes);
    ``boundary`` for one, ``interior`` for more, ``none`` for no element."""
    probes = subs.select(F.col("sub").alias("probe"), F.explode("nodes").alias("node"))
    counted = batch_containing_all(pairs, probes).groupBy("probe").agg(F.count("*").alias("parents"))
    met = subs.select("sub").join(counted, F.col("sub") == F.col("probe"), "left").select("sub", F.coalesce("parents", F.lit(0)).alias("parents"))
    return met.withColumn("place", F.when(F.col("parents") == 1, "boundary").when(F.col("parents") > 1, "interior").otherwise("none"))


def erased(typed: DataFrame, seeds: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``type, id`` of ``seeds`` and of every entity that holds an erased one, through all types.

    A frontier walk: each round joins only what the last one added.
    """
    up = typed.where("etype <> ntype or elem <> node").select(
        F.col("ntype").alias("type"), F.col("node").alias("id"), F.col("etype").alias("to_type"), F.col("elem").alias("to_id")).distinct()
    done = cut(seeds.select("type", "id").distinct())
    edge = done
    for _ in range(max_rounds):
        edge = cut(edge.join(up, ["type", "id"]).select(F.col("to_type").alias("type"), F.col("to_id").alias("id")).distinct().join(done, ["type", "id"], "left_anti"))
        if edge.isEmpty():
            return done
        done = cut(done.unionByName(edge))
    raise RuntimeError("the closure did not end")


def active(entities: DataFrame, tombstones: DataFrame) -> DataFrame:
    return entities.join(tombstones, ["type", "id"], "left_anti")


def compress(typed: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The typed incidences without the erased, densely renumbered per type, and each type's ``old, new``."""
    gone = erased(typed, tombstones)
    kept = typed.join(gone.select(F.col("type").alias("etype"), F.col("id").alias("elem")), ["etype", "elem"], "left_anti")
    kept = cut(kept.join(gone.select(F.col("type").alias("ntype"), F.col("id").alias("node")), ["ntype", "node"], "left_anti"))
    ids = cut(kept.select(F.col("etype").alias("type"), F.col("elem").alias("id")).union(kept.select("ntype", "node")).distinct())
    maps, out = {}, kept
    for kind in [r[0] for r in ids.select("type").distinct().collect()]:  # types are few and declared
        maps[kind] = cut(renumber(ids.where(F.col("type") == kind), "id"))
    every = None
    for kind, m in maps.items():
        own = m.select(F.lit(kind).alias("type"), "old", "new")
        every = own if every is None else every.unionAll(own)
    if every is None:
        return out, maps
    e = every.select(F.col("type").alias("etype"), F.col("old").alias("elem"), F.col("new").alias("e"))
    n = every.select(F.col("type").alias("ntype"), F.col("old").alias("node"), F.col("new").alias("n"))
    return out.join(e, ["etype", "elem"]).join(n, ["ntype", "node"]).select("etype", "ntype", F.col("e").alias("elem"), "pos", F.col("n").alias("node")), maps


def extract(incidence: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The part of a relation on ``elements`` (elem), with dense ids; and both ``old, new`` maps."""
    kept = cut(incidence.join(elements.select("elem").distinct(), "elem", "left_semi"))
    es, ns = cut(renumber(kept, "elem")), cut(renumber(kept, "node"))
    moved = kept.join(es.select(F.col("old").alias("elem"), F.col("new").alias("e")), "elem").join(ns.select(F.col("old").alias("node"), F.col("new").alias("n")), "node")
    return moved.select(F.col("e").alias("elem"), "pos", F.col("n").alias("node")), es, ns


def in_box(pairs: DataFrame, coords: DataFrame, low: tuple[float, ...], high: tuple[float, ...], every: bool = False) -> DataFrame:
    """Elements with a node inside a closed box, or with all nodes inside."""
    inside = F.lit(True)
    for axis, a, b in zip("xyz", low, high):
        inside = inside & F.col(axis).between(a, b)
    # The box is a filter of the coordinates' scan; only what lies in it is joined.
    within = coords.where(inside).select("node")
    met = pairs.join(within, "node", "left_semi").select("elem").distinct()
    if not every:
        return met
    out = pairs.join(met, "elem", "left_semi").join(within, "node", "left_anti").join(coords.select("node"), "node", "left_semi")
    return met.join(out.select("elem"), "elem", "left_anti")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two relations side by side: the right one's elements and nodes follow the left one's."""
    top = left.agg(F.coalesce(F.max("elem") + 1, F.lit(0)).alias("de"), F.coalesce(F.max("node") + 1, F.lit(0)).alias("dn")).first()
    moved = right.select((F.col("elem") + top.de).alias("elem"), "pos", (F.col("node") + top.dn).alias("node"))
    return left.select("elem", "pos", "node").unionByName(moved)
