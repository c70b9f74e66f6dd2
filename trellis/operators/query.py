"""Questions about a relation, as equi-joins and aggregates on its distinct pairs ``elem, node``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.plans.lineage import cut, cut_counted

#: Probe nodes that are sent to all tasks at most; larger probes are joined by shuffling.
MAX_BROADCAST = 100_000
#: Nodes of an element that travel with it at most; what wider ones share is counted from the pairs that meet.
NARROW = 64
#: Nodes asked for of an element that are paired with each other at most.
PAIRED = 16


def _probe(pairs: DataFrame, nodes: DataFrame | list[int]) -> DataFrame:
    if isinstance(nodes, list):
        nodes = pairs.sparkSession.createDataFrame([(int(n),) for n in nodes], "node long")
    probe = nodes.select("node").distinct()
    return F.broadcast(probe) if probe.count() <= MAX_BROADCAST else probe


def containing_all(pairs: DataFrame, nodes: DataFrame | list[int]) -> DataFrame:
    """Elements that hold every node of the probe (relational division); none for an empty probe."""
    probe = _probe(pairs, nodes)
    n = probe.count()
    return pairs.join(probe, "node").groupBy("elem").agg(F.count("*").alias("n")).where(F.col("n") == n).select("elem")


def containing_any(pairs: DataFrame, nodes: DataFrame | list[int]) -> DataFrame:
    return pairs.join(_probe(pairs, nodes), "node", "left_semi").select("elem").distinct()


def holding_exactly(pairs: DataFrame, nodes: DataFrame | list[int]) -> DataFrame:
    """Elements whose nodes are those of the probe and no others."""
    probe = _probe(pairs, nodes).withColumn("asked", F.lit(1))
    n = probe.count()
    met = pairs.join(probe, "node", "left").groupBy("elem").agg(F.count("*").alias("all"), F.count("asked").alias("met"))
    return met.where((F.col("all") == n) & (F.col("met") == n)).select("elem")


def containing_any_but(pairs: DataFrame, include: DataFrame | list[int], exclude: DataFrame | list[int]) -> DataFrame:
    """Elements that hold a node to include and none to exclude."""
    return containing_any(pairs, include).join(containing_any(pairs, exclude), "elem", "left_anti")


def batch_containing_all(pairs: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe, elem`` for ``probes`` (probe, node): division for many probes at once.

    A probe of several nodes is looked up by its two rarest among the pairs of nodes of each element, so that only elements
    with both meet it; the rest of its nodes are compared there.  Elements with more than ``PAIRED`` of the
    nodes asked for meet probes node by node, and are counted.
    """
    probes = probes.select("probe", "node").distinct()
    asked = cut(pairs.select("elem", "node").join(probes.select("node").distinct(), "node", "left_semi"))
    often = asked.groupBy("node").agg(F.count("*").alias("often"))
    wanted = probes.join(often, "node", "left").groupBy("probe").agg(
        F.count("*").alias("size"), F.count("often").alias("known"), F.array_sort(F.collect_list(F.struct("often", "node"))).alias("rare"))
    wanted = wanted.where("size = known").select("probe", "size", F.transform("rare", lambda r: r["node"]).alias("nodes"))
    alone = wanted.where("size = 1").select("probe", F.get("nodes", F.lit(0)).alias("node")).join(asked, "node").select("probe", "elem")
    rows = asked.groupBy("elem").agg(F.array_sort(F.collect_list("node")).alias("held"))
    wide = rows.where(F.size("held") > PAIRED).select("elem", F.explode("held").alias("node"))
    met = wide.join(probes, "node").groupBy("probe", "elem").agg(F.count("*").alias("n"))
    counted = met.join(wanted.where("size > 1").select("probe", "size"), "probe").where("n = size").select("probe", "elem")
    two = "case when size(held) > 1 then flatten(transform(sequence(1, size(held) - 1), i -> transform(slice(held, i + 1, size(held) - i), n -> struct(held[i - 1] as a, n as b)))) end"
    paired = rows.where(F.size("held").between(2, PAIRED)).select("elem", "held", F.explode(F.expr(two)).alias("p")).select("elem", "held", "p.a", "p.b")
    first, second = F.get("nodes", F.lit(0)), F.get("nodes", F.lit(1))
    keyed = wanted.where("size > 1").select("probe", "nodes", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    found = paired.join(keyed, ["a", "b"]).where((F.size("nodes") == 2) | (F.size(F.array_intersect("nodes", "held")) == F.size("nodes")))
    return alone.unionByName(counted).unionByName(found.select("probe", "elem"))


def shared_counts(pairs: DataFrame, least: int = 1) -> DataFrame:
    """``e1, e2, shared`` for e1 < e2: how many nodes both hold, if ``least`` or more.

    Elements with fewer than ``least`` nodes cannot qualify and are left out.  For ``least`` above one,
    an element's nodes are ordered by how many elements hold them; two elements that share ``least`` nodes
    meet in the first n - least + 1 of each, so only those meet, and nodes that most elements hold seldom do.
    Elements bring their nodes along, so that candidates are counted where they meet and only those that
    qualify go on; pairs with an element of more than ``NARROW`` nodes are counted afterwards.
    """
    if least <= 1:
        met = pairs.select("node", F.col("elem").alias("e1")).join(pairs.select("node", F.col("elem").alias("e2")), "node")
        return met.where("e1 < e2").groupBy("e1", "e2").agg(F.count("*").alias("shared"))
    held = pairs.groupBy("node").agg(F.count("*").alias("often")).where("often > 1")  # a node of one element meets nothing
    own = Window.partitionBy("elem")
    ranked = pairs.join(held, "node").select("elem", "node", F.row_number().over(own.orderBy("often", "node")).alias("nth"), F.count("*").over(own).alias("n"))
    ranked = ranked.where(F.col("n") >= least).withColumn("nodes", F.collect_list(F.when(F.col("n") <= NARROW, F.col("node"))).over(own))
    ranked, (widest,) = cut_counted(ranked, F.max("n"))
    first = ranked.where(F.col("nth") <= F.col("n") - (least - 1))
    shared = F.size(F.array_intersect("ne1", "ne2")).cast("long").alias("shared")
    one, two = (first.where(F.col("n") <= NARROW).select("node", F.col("elem").alias(e), F.col("nodes").alias("n" + e)) for e in ("e1", "e2"))
    found = one.join(two, "node").where("e1 < e2").select("e1", "e2", shared).where(F.col("shared") >= least).distinct()
    if (widest or 0) <= NARROW:
        return found
    wide = first.where(F.col("n") > NARROW).select("node", F.col("elem").alias("w"))
    met = wide.join(first.select("node", "elem", "n"), "node").where((F.col("n") <= NARROW) | (F.col("w") < F.col("elem")))
    met = met.select(F.least("w", "elem").alias("e1"), F.greatest("w", "elem").alias("e2")).distinct()
    one, two = (ranked.groupBy(F.col("elem").alias(e)).agg(F.collect_list("node").alias("n" + e)) for e in ("e1", "e2"))  # an element's own nodes
    return found.unionByName(met.join(one, "e1").join(two, "e2").select("e1", "e2", shared).where(F.col("shared") >= least))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges ``e1, e2, ...``."""
    turned = {"e1": "e2", "e2": "e1"}
    both = F.array(F.struct(*edges.columns), F.struct(*(F.col(turned.get(c, c)).alias(c) for c in edges.columns)))
    return edges.select(F.explode(both).alias("x")).select("x.*")  # in one pass: what makes the edges runs once


def neighbours(pairs: DataFrame) -> DataFrame:
    """Distinct ``elem, neighbour`` of elements that share a node."""
    return mirrored(shared_counts(pairs)).select(F.col("e1").alias("elem"), F.col("e2").alias("neighbour"))


def node_neighbours(pairs: DataFrame) -> DataFrame:
    """Distinct ``node, neighbour`` of nodes that share an element."""
    turned = pairs.select(F.col("node").alias("elem"), F.col("elem").alias("node"))
    return neighbours(turned).withColumnRenamed("elem", "node")


def neighbours_of(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, elem, shared`` of the elements that share nodes with ``seeds`` (elem), and how many.

    Only the seeds' nodes are looked up, so work follows the answer, not the relation's square.
    """
    own = pairs.join(seeds.select("elem").distinct(), "elem", "left_semi").select(F.col("elem").alias("seed"), "node")
    return pairs.join(own, "node").where("elem <> seed").groupBy("seed", "elem").agg(F.count("*").alias("shared"))


def dual_graph(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Edges ``e1, e2, shared`` between elements with ``least`` common nodes or more."""
    return shared_counts(pairs, least)


def degrees(edges: DataFrame) -> DataFrame:
    """``elem, degree`` of the ends of undirected edges."""
    return mirrored(edges.select("e1", "e2")).groupBy(F.col("e1").alias("elem")).agg(F.count("*").alias("degree"))


def degree_histogram(pairs: DataFrame) -> DataFrame:
    """``degree, elements``: how many elements have how many nodes."""
    return pairs.groupBy("elem").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("elements"))


def node_valence(pairs: DataFrame) -> DataFrame:
    """``node, elements``: how many elements hold each node."""
    return pairs.groupBy("node").agg(F.count("*").alias("elements"))


def bandwidth(edges: DataFrame) -> DataFrame:
    """One row: the largest and the total distance between the ids that edges join."""
    gap = F.abs(F.col("e1") - F.col("e2"))
    return edges.agg(F.coalesce(F.max(gap), F.lit(0)).alias("bandwidth"), F.coalesce(F.sum(gap), F.lit(0)).alias("total_gap"), F.count("*").alias("edges"))


def profile(edges: DataFrame) -> DataFrame:
    """One row: the sum over ids of the distance to the smallest neighbour not above them."""
    low = mirrored(edges.select("e1", "e2")).groupBy("e1").agg(F.min("e2").alias("m"))
    return low.agg(F.coalesce(F.sum(F.col("e1") - F.least("e1", "m")), F.lit(0)).alias("profile"))


def connectivity_statistics(pairs: DataFrame) -> DataFrame:
    """One row: elements, nodes, incidences, and the largest and mean number of nodes of an element and of elements of a node."""
    per = pairs.groupBy("elem").agg(F.count("*").alias("n")).agg(F.count("*").alias("elements"), F.sum("n").alias("incidences"), F.max("n").alias("most_nodes"), F.avg("n").alias("mean_nodes"))
    at = node_valence(pairs).agg(F.count("*").alias("nodes"), F.max("elements").alias("most_elements"), F.avg("elements").alias("mean_elements"))
    return per.join(at, F.lit(True))  # one row each
