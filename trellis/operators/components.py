"""Connected components of an edge list by alternating star contractions.

Every round is two grouped minima and two joins over the edges that are left; nothing is
gathered on the driver but the number of edges and a sum of their hashes, taken as they are written.
Joins are never by broadcast: rounds would leave one table after the other on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.plans.lineage import cut, cut_counted, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select(F.bitwise_not("a").alias("k"), F.least("a", "m").alias("m"))
    far = both.where("b > a").select(F.bitwise_not("a").alias("k"), "b")
    return far.join(low.hint("merge"), "k").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), "u", "m")
    near = down.select(F.bitwise_not("u").alias("k"), "v").join(low.hint("merge"), "k").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return near.unionAll(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def _apart(edges: DataFrame) -> DataFrame:
    """``a, b, open`` (a < b): closed are the edges of whole components that are stars around their smallest node.

    A node is amiss if it has two smaller neighbours, or both a smaller and a larger one; open is what lies around the smaller neighbours of these, and around them.
    """
    ends = edges.select(F.col("a").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")).unionAll(edges.select(F.col("b").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")))
    amiss = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
    amiss = cut(amiss.select(F.bitwise_not("n").alias("k")))
    around = edges.select("a", F.bitwise_not("b").alias("k")).join(amiss.hint("merge"), "k", "left_semi").select(F.bitwise_not("a").alias("k"))
    around = around.unionAll(amiss).distinct().withColumn("open", F.lit(True))
    out = edges.select("a", "b", F.bitwise_not("a").alias("k")).join(around.hint("merge"), "k", "left")
    return out.select("a", "b", F.coalesce("open", F.lit(False)).alias("open"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, apart: bool = False) -> DataFrame:
    """``(node, component)`` for each node that an edge names; component is its smallest node.

    Edges are undirected; self loops and null ends are ignored, repeated edges count once.  Node
    ids are 64-bit integers.  A hub's join rows can be split by adaptive execution, because each
    join shuffles both sides afresh.  With ``apart``, components that a round has made stars are left out of the next
    ones: more work a round, but less in all where most are small.
    """
    seal = (F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))
    now, before = cut_counted(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
                              .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), *seal)
    stars = []
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last = now
        if apart:
            found = cut(_small_star(_large_star(last)))
            dealt, before = cut_counted(_apart(found), F.coalesce(F.sum(F.col("open").cast("long")), F.lit(0)))
            discard(last, found)
            now = cut(dealt.where("open").select("a", "b"))
            stars.append(dealt.where("not open").select("a", "b"))
            continue
        now, after = cut_counted(_small_star(_large_star(last)), *seal)
        discard(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    for more in stars:
        now = now.unionAll(more)
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
