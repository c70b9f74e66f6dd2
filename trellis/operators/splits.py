"""Splits of bars, triangles and tetrahedra at nodes on their edges, in which neighbours agree without talking.

An element's nodes are taken in their global order.  Its corners are lifted by heights that rise in that order, the nodes on
its edges stay almost on the ground, and the split is the lower hull seen from below.  The part of that hull over a
side is the hull of the side's own nodes, whose order both neighbours share: so a side is split alike from both, whatever
else is split in each element.  A side with all edges split falls into its regular parts; with two, the free diagonal
starts at the lower-numbered corner.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.relation import dealt_in_order, numbered_in_order
from trellis.plans.lineage import cut, discard

#: Heights of corners in their order, and of nodes on edges in the order of edges: any that rise, and that no two diagonals share.
_CORNERS, _EDGES = (1_000_000, 1_010_000, 1_030_000, 1_070_000), (1, 2, 4, 8, 16, 31)


@cache
def template(size: int, mask: int) -> list[list[int]]:
    """Children of an element of ``size`` sorted nodes by which of its edges, (0, 1), (0, 2) and so on, are split.

    Numbers from ``size`` on are the nodes on the edges.  Children are turned as the sorted element is.
    """
    edges = list(combinations(range(size), 2))
    on = [k for k in range(len(edges)) if mask >> k & 1]
    corner = np.vstack([np.zeros(size - 1), 2 * np.eye(size - 1)]) if size > 1 else np.zeros((1, 0))
    where = np.vstack([corner, *((corner[a] + corner[b])[None] / 2 for a, b in (edges[k] for k in on))])
    height = np.array([*_CORNERS[:size], *(_EDGES[k] for k in on)], float)
    number = [*range(size), *(size + k for k in on)]
    flat = np.hstack([where, np.ones((len(where), 1))])
    out = []
    for some in combinations(range(len(where)), size):
        turn = np.linalg.det(flat[list(some)])
        if abs(turn) < 1e-9:
            continue
        floor = flat @ np.linalg.solve(flat[list(some)], height[list(some)])
        if all(height[i] > floor[i] + 1e-6 for i in range(len(where)) if i not in some):
            child = [number[i] for i in some]
            if (turn > 0) != (np.linalg.det(flat[:size]) > 0):
                child[:2] = child[1::-1]
            out.append(child)
    return out


#: Children of elements whose edges are all split, in their own order of nodes (fixed values): corners, then edge middles.
LOCAL_EDGES = {2: [(0, 1)], 3: [(0, 1), (1, 2), (2, 0)], 4: [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]}
WHOLE = {
    2: [[0, 2], [2, 1]],
    3: [[0, 3, 5], [3, 1, 4], [5, 4, 2], [3, 4, 5]],
    4: [[0, 4, 5, 6], [4, 1, 7, 8], [5, 7, 2, 9], [6, 8, 9, 3], [4, 5, 6, 8], [4, 5, 8, 7], [5, 6, 8, 9], [5, 8, 7, 9]],
}


def sides(rows: DataFrame) -> DataFrame:
    """``elem, k, a, b``: the edges (a < b) of every simplex, by number among its nodes in global order."""
    ends = lambda size: F.array(*(F.struct(F.col("s")[i].alias("a"), F.col("s")[j].alias("b")) for i, j in combinations(range(size), 2)))
    sorted_ = rows.where("size(nodes) between 2 and 4").select("elem", F.sort_array("nodes").alias("s"))
    every = F.when(F.size("s") == 2, ends(2)).when(F.size("s") == 3, ends(3)).otherwise(ends(4))
    return sorted_.select("elem", F.posexplode(every).alias("k", "e")).select("elem", "k", "e.a", "e.b")


@cache
def _plans() -> list[tuple[int, int, int, list[list[int]]]]:
    """Children of every size, mask and order of nodes, by their places among the sorted nodes and the nodes on their edges."""
    out = []
    for size in (1, 2, 3, 4):
        edges = list(combinations(range(size), 2))
        full = (1 << len(edges)) - 1
        out.append((size, 0, 0, [list(range(size))]))
        for order in permutations(range(size)):
            code = sum(1 << n for n, (i, j) in enumerate(combinations(range(4), 2)) if j < size and order[i] > order[j])
            local = [*order, *(size + edges.index((min(order[i], order[j]), max(order[i], order[j]))) for i, j in LOCAL_EDGES.get(size, []))]
            for mask in range(1, full + 1):
                if mask == full:
                    children = [[local[c] for c in child] for child in WHOLE[size]]
                else:  # sorting an odd order turns the element over
                    children = [c[1::-1] + c[2:] if code.bit_count() % 2 else list(c) for c in template(size, mask)]
                out.append((size, mask, code, children))
    return out


def split(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``elem, nodes, parent``: elements of one to four nodes, which may be mixed, split at ``cuts`` (node, a, b).

    A cut is a node on the edge between a < b; each edge has at most one.  Elements without any stay whole.  Children are numbered
    densely by parent and place, and turned as their parents.  An element of more nodes is an error.  Parents meet the table of
    all splits, are dealt by range and sorted, so that children are numbered where they are made.
    """
    met = sides(rows).join(cuts.select("a", "b", F.col("node").alias("m")), ["a", "b"])
    per = met.groupBy("elem").agg(*(F.max(F.when(F.col("k") == k, F.col("m"))).alias(f"m{k}") for k in range(6)), F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("mask"))
    both = rows.select("elem", "nodes").join(per, "elem", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    # Which nodes stand behind smaller ones, null being the smallest: the order of the nodes, of which whole elements need none.
    behind = lambda i, j: (F.get("nodes", F.lit(i)) > F.get("nodes", F.lit(j))) | (F.get("nodes", F.lit(j)).isNull() & (F.size("nodes") > j) & F.get("nodes", F.lit(i)).isNotNull())
    code = sum((F.when(behind(i, j), 1 << n).otherwise(0) for n, (i, j) in enumerate(combinations(range(4), 2))), F.lit(0))
    whole = F.col("mask") == 0
    points = F.when(whole, F.col("nodes")).otherwise(F.concat(F.sort_array("nodes"), F.array(*(F.col(f"m{k}") for k in range(6)))))
    asked = both.select(F.col("elem").alias("parent"), points.alias("points"), F.size("nodes").alias("size"), "mask", F.when(whole, 0).otherwise(code).alias("code"))
    plans = rows.sparkSession.createDataFrame(_plans(), "size int, mask int, code int, plan array<array<int>>")
    # Dealt after the join, below which a sort would be left out.
    found = dealt_in_order(asked.join(F.broadcast(plans), ["size", "mask", "code"], "left"), "parent")
    said = F.concat(F.lit("no split of an element of "), F.col("size").cast("string"), F.lit(" nodes"))
    born = found.select("parent", "points", F.explode(F.coalesce("plan", F.raise_error(said).cast("array<array<int>>"))).alias("c"))
    corners = [F.get("points", F.get("c", F.lit(i))) for i in range(4)]
    return numbered_in_order(born.select("parent", F.slice(F.array(*corners), F.lit(1), F.size("c")).alias("nodes"))).select(F.col("new").alias("elem"), "nodes", "parent")


def closed_marks(rows: DataFrame, marks: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``a, b``: marks (a < b), widened to all six edges of every tetrahedron that has one or two, until none has.

    Each round looks only at tetrahedra that the last one's marks touch.  An error if ``max_rounds`` are not enough.
    """
    own = cut(sides(rows.where("size(nodes) = 4")))
    marks = more = cut(marks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        touched = own.join(own.join(more, ["a", "b"]).select("elem").distinct(), "elem", "left_semi")
        counted = touched.join(marks.withColumn("marked", F.lit(1)), ["a", "b"], "left")
        few = counted.groupBy("elem").agg(F.count("marked").alias("n")).where("n in (1, 2)")
        fresh = cut(own.join(few, "elem", "left_semi").select("a", "b").distinct().join(marks, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            discard(fresh, own)
            return marks
        wider = cut(marks.unionByName(fresh))
        discard(*({id(t): t for t in (more, marks)}.values()))
        marks, more = wider, fresh
    raise RuntimeError("marks did not settle")
