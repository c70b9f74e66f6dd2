"""Walks over graphs given as edges, by frontier loops.

Each round joins the frontier alone with the edges and writes what it adds to the shared folder;
the driver sees only whether anything was added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators.components import connected_components
from trellis.operators.query import mirrored, shared_counts
from trellis.plans.lineage import Pile, cut, cut_counted, discard


def distances(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``id, hop`` of all that ``seeds`` (id) reach along ``src, dst``, or within ``max_hops``."""
    steps = cut(edges.select("src", "dst").distinct())
    done = Pile(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    hop = 0
    while done.count and (max_hops is None or hop < max_hops):
        hop += 1
        near = done.last.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        done.add(near.join(done.all(), "id", "left_anti").withColumn("hop", F.lit(hop)))
    discard(steps)
    return done.all()


def as_directed(undirected: DataFrame) -> DataFrame:
    return mirrored(undirected.select("e1", "e2")).select(F.col("e1").alias("src"), F.col("e2").alias("dst"))


def k_hop(pairs: DataFrame, seeds: DataFrame, hops: int, least_shared: int = 1, include_seeds: bool = False) -> DataFrame:
    """``id, hop`` of elements within ``hops`` of ``seeds`` (id), where one hop shares ``least_shared`` nodes.

    Neighbours of the frontier are found from its own nodes; the relation's full dual graph is not built.
    """
    done = Pile(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        if not done.count:
            break
        own = pairs.join(done.last.select(F.col("id").alias("elem")), "elem", "left_semi").select(F.col("elem").alias("from"), "node")
        met = pairs.join(own, "node").where("elem <> from").groupBy("from", "elem").agg(F.count("*").alias("shared"))
        near = met.where(F.col("shared") >= least_shared).select(F.col("elem").alias("id")).distinct()
        done.add(near.join(done.all(), "id", "left_anti").withColumn("hop", F.lit(hop)))
    return done.all() if include_seeds else done.all().where("hop > 0")


def components(pairs: DataFrame, least_shared: int = 1) -> DataFrame:
    """``elem, component``: elements that reach each other by shared nodes; alone ones are their own.

    With one shared node the bipartite graph of elements and nodes is contracted, whose size is
    that of the relation; the pairs of elements at a node are never listed.
    """
    every = pairs.select("elem").distinct()
    if least_shared == 1:
        # Nodes become negative ids, so that they cannot be taken for elements.
        found = connected_components(pairs.select(F.col("elem").alias("a"), (-F.col("node") - 1).alias("b")))
        lowest = found.where("node >= 0").groupBy("component").agg(F.min("node").alias("low"))
        found = found.where("node >= 0").join(lowest, "component").select(F.col("node").alias("elem"), F.col("low").alias("component"))
    else:
        edges = shared_counts(pairs, least_shared)
        found = connected_components(edges, "e1", "e2").withColumnRenamed("node", "elem")
    return every.join(found, "elem", "left").select("elem", F.coalesce("component", "elem").alias("component"))


def shortest_paths(edges: DataFrame, source: int, weight: Column | str = "weight", max_rounds: int = 100_000) -> DataFrame:
    """``id, dist, pred`` of all that ``source`` reaches along ``src, dst``; the source's pred is -1.

    Rounds of relaxation: only ids whose distance fell are extended.  A negative weight is an
    error.  Equal distances keep the smallest predecessor.
    """
    steps = edges.select("src", "dst", (F.col(weight) if isinstance(weight, str) else weight).cast("double").alias("w"))
    steps = cut(steps.withColumn("w", F.when(F.col("w") >= 0, F.col("w")).otherwise(F.raise_error(F.lit("negative weight")).cast("double"))))
    spark = edges.sparkSession
    done = cut(spark.createDataFrame([(source, 0.0, -1)], "id long, dist double, pred long"))
    edge, fallen = done, 1
    for _ in range(max_rounds):
        tried = edge.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("pred"))
        best = tried.groupBy("id").agg(F.min(F.struct("dist", "pred")).alias("n"))
        old = done.select("id", F.col("dist").alias("d0"), F.col("pred").alias("p0"))
        fell = best.join(old, "id", "left").where("d0 is null or n.dist < d0 or (n.dist = d0 and p0 >= 0 and n.pred < p0)").select("id", "n.dist", "n.pred")
        before = (edge, done) if edge is not done else (done,)
        edge, (fallen,) = cut_counted(fell, F.count(F.lit(1)))
        if not fallen:
            return done
        done = cut(done.join(edge.select("id"), "id", "left_anti").unionByName(edge))
        discard(*before)
    raise RuntimeError("distances did not settle")


def typed_shortest_paths(edges: DataFrame, sources: DataFrame, width: float | None = None) -> DataFrame:
    """``type, id, dist, pred_type, pred`` of all that ``sources`` (type, id) reach along ``src_type, src, dst_type, dst, weight``.

    Distances are settled in buckets of ``width`` (by default the mean weight).  Within a bucket, edges whose ends both lie in it are relaxed in rounds,
    over this bucket's rows alone; then all its edges that lead further are relaxed once, and its rows are written for good.  Each is written
    once; later rounds read of them no more than which ids are settled.  What waits for later buckets is one row for each id.

    Sources have a null pred.  Of equal distances the smallest predecessor (type, id) stays, behind one over an edge of weight zero any other.
    A negative or null weight is an error.
    """
    weight = F.col("weight").cast("double")
    checked = F.when(weight >= 0, weight).otherwise(F.raise_error(F.concat(F.lit("no way over a weight of "), F.coalesce(F.col("weight").cast("string"), F.lit("null")))).cast("double"))
    steps, (mean,) = cut_counted(edges.select("src_type", "src", "dst_type", "dst", checked.alias("w")), F.avg("w"))
    width = width or mean or 1.0
    rank = lambda: F.min(F.struct("dist", "zero", "pred_type", "pred")).alias("n")
    flat = ("type", "id", "n.dist", "n.zero", "n.pred_type", "n.pred")

    def relaxed(rows: DataFrame) -> DataFrame:
        met = rows.select("type", "id", "dist").join(steps, (F.col("type") == F.col("src_type")) & (F.col("id") == F.col("src")))
        return met.select(F.col("dst_type").alias("type"), F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.when(F.col("w") == 0, 1).otherwise(0).alias("zero"),
                          F.col("src_type").alias("pred_type"), F.col("src").alias("pred"))

    lowest = (F.min("dist"),)
    waiting, (low,) = cut_counted(sources.select("type", F.col("id").cast("long").alias("id")).distinct().select(
        "type", "id", F.lit(0.0).alias("dist"), F.lit(-1).alias("zero"), F.lit(None).cast("string").alias("pred_type"), F.lit(None).cast("long").alias("pred")), *lowest)
    settled = Pile(waiting.limit(0).select("type", "id", "dist", "pred_type", "pred"))
    while low is not None:
        end = max((low // width + 1) * width, math.nextafter(low, math.inf))
        inside, (some,) = cut_counted(waiting.where(F.col("dist") < end).join(settled.all().select("type", "id"), ["type", "id"], "left_anti"), F.count(F.lit(1)))
        active = inside
        while some:
            near = relaxed(active).where(F.col("dist") < end).groupBy("type", "id").agg(rank()).select(*flat)
            near = near.join(settled.all().select("type", "id"), ["type", "id"], "left_anti")
            old = inside.select("type", "id", F.col("dist").alias("d0"), F.col("zero").alias("z0"), F.struct("pred_type", "pred").alias("p0"))
            tie = (F.col("dist") == F.col("d0")) & (F.col("zero") == 0) & ((F.col("z0") > 0) | (F.col("z0") == 0) & (F.struct("pred_type", "pred") < F.col("p0")))
            fell = near.join(old, ["type", "id"], "left").where(F.col("d0").isNull() | (F.col("dist") < F.col("d0")) | tie).drop("d0", "z0", "p0")
            better, (some,) = cut_counted(fell, F.count(F.lit(1)))
            if some:
                wider = cut(inside.join(better.select("type", "id"), ["type", "id"], "left_anti").unionByName(better))
                discard(inside, *([active] if active is not inside else []))
                inside, active = wider, better
            else:
                discard(better)
        settled.add(inside)
        beyond = waiting.where(F.col("dist") >= end).unionByName(relaxed(inside).where(F.col("dist") >= end)).groupBy("type", "id").agg(rank()).select(*flat)
        later, (low,) = cut_counted(beyond, *lowest)
        discard(waiting, inside, *([active] if active is not inside else []))
        waiting = later
    discard(steps, waiting)
    return settled.all()


def paths(tree: DataFrame, targets: DataFrame, max_length: int = 100_000) -> DataFrame:
    """``target, nth, id``: the way from the source to each of ``targets`` (id) in a tree of ``id, pred``.

    An error if a way is longer than ``max_length``, as it is where predecessors run in a circle.
    """
    step = cut(tree.select("id", "pred"))
    out = Pile(targets.select(F.col("id").alias("target"), "id").distinct().join(step.select("id"), "id", "left_semi").withColumn("back", F.lit(0)))
    for back in range(1, max_length + 1):
        out.add(out.last.join(step, "id").where("pred >= 0").select("target", F.col("pred").alias("id"), F.lit(back).alias("back")))
        if not out.count:
            break
    else:
        raise RuntimeError(f"a way has more than {max_length} ids")
    discard(step)
    order = Window.partitionBy("target").orderBy(F.col("back").desc())
    return out.all().select("target", (F.row_number().over(order) - 1).alias("nth"), "id")


def topological_levels(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100_000) -> tuple[DataFrame, bool]:
    """``id, level`` of all that no cycle holds back, and whether that is everything.

    ``level`` is the length of the longest way from a source; self loops are cycles.
    """
    steps = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select("id").distinct())
    done = Pile(left.limit(0).withColumn("level", F.lit(0)))
    for level in range(max_rounds):
        free = done.add(left.join(steps.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if not done.count:
            return done.all(), left.isEmpty()
        before = left, steps
        left = cut(left.join(free, "id", "left_anti"))
        steps = cut(steps.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        discard(*before)
    raise RuntimeError(f"more than {max_rounds} levels")


def colouring(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``id, colour``: what greedy colouring in ascending order of id gives, in parallel rounds.

    An id is coloured once all its smaller neighbours are; rounds are as many as the longest
    ascending chain.  Neighbours' colours are aggregated before they meet.
    """
    down = cut(edges.select(F.greatest("e1", "e2").alias("id"), F.least("e1", "e2").alias("low")).where("id <> low").distinct())
    waiting = cut(nodes.select("id").distinct())
    done = Pile(waiting.join(down.select("id").distinct(), "id", "left_anti").withColumn("colour", F.lit(0)))
    for _ in range(max_rounds):
        if not done.count:
            discard(down, waiting)
            return done.all()
        last = waiting
        waiting = cut(last.join(done.last, "id", "left_anti"))
        discard(last)
        open_ = down.join(waiting.select(F.col("id").alias("low")), "low", "left_semi").select("id").distinct()
        ready = waiting.join(open_, "id", "left_anti")
        taken = down.join(ready, "id").join(done.all().select(F.col("id").alias("low"), "colour"), "low").groupBy("id").agg(F.collect_set("colour").alias("cs"))
        gap = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("cs")), F.col("cs")))
        done.add(taken.select("id", gap.alias("colour")))
    raise RuntimeError(f"colouring did not end in {max_rounds} rounds")


def colouring_statistics(coloured: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ids, colours, the largest and smallest class, and edges whose ends have one colour."""
    sizes = coloured.groupBy("colour").agg(F.count("*").alias("n"))
    one, two = (coloured.select(F.col("id").alias(e), F.col("colour").alias("c" + e)) for e in ("e1", "e2"))
    clashes = edges.join(one, "e1").join(two, "e2").where("ce1 = ce2 and e1 <> e2")
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ids"), F.count("*").alias("colours"), F.max("n").alias("most"), F.min("n").alias("least")).join(
        clashes.agg(F.count("*").alias("clashes")), F.lit(True))


def typed_distances(typed: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``type, id, hop``: how many steps of the typed incidences (etype, ntype, elem, node), taken either way,
    lead from ``seeds`` (type, id) to each entity."""
    e, n = F.struct(F.col("etype").alias("type"), F.col("elem").alias("id")), F.struct(F.col("ntype").alias("type"), F.col("node").alias("id"))
    both = typed.select(e.alias("src"), n.alias("dst")).unionAll(typed.select(n.alias("src"), e.alias("dst")))
    found = distances(both, seeds.select(F.struct("type", "id").alias("id")), max_hops)
    return found.select("id.type", F.col("id.id").alias("id"), "hop")


def eccentricity_bound(edges: DataFrame, start: int) -> int:
    """A lower bound of the diameter of ``start``'s component: two walks, the second from where the first ended."""
    spark = edges.sparkSession
    steps = as_directed(edges)
    far = distances(steps, spark.createDataFrame([(start,)], "id long")).orderBy(F.col("hop").desc(), "id").first()
    return distances(steps, spark.createDataFrame([(far.id,)], "id long")).agg(F.max("hop")).first()[0]


def type_order(typed: DataFrame) -> tuple[DataFrame, bool]:
    """``id, level`` of the types of typed incidences, those that refer to no other first, and whether no cycle holds any back.

    A type whose entities name entities of their own type is no cycle for that.
    """
    steps = typed.select(F.col("ntype").alias("src"), F.col("etype").alias("dst")).distinct()
    kinds = steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct()
    return topological_levels(steps.where("src <> dst"), kinds)
