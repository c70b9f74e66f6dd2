"""Rows that are the same up to a group of reorderings."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(generators: list[tuple[int, ...]], limit: int = 40_320) -> list[tuple[int, ...]]:
    """The group that permutations generate, sorted; the identity is in it."""
    n = len(generators[0])
    if any(sorted(g) != list(range(n)) for g in generators):
        raise ValueError("a generator is not a permutation")
    group, edge = {tuple(range(n))}, [tuple(range(n))]
    while edge:
        edge = [p for p in {tuple(g[i] for i in q) for q in edge for g in generators} if p not in group]
        group.update(edge)
        if len(group) > limit:
            raise ValueError(f"the group has more than {limit} members")
    return sorted(group)


def identity(n: int) -> list[tuple[int, ...]]:
    return [tuple(range(n))]


def cyclic(n: int) -> list[tuple[int, ...]]:
    return closure([tuple((i + 1) % n for i in range(n))])


def dihedral(n: int) -> list[tuple[int, ...]]:
    return closure([tuple((i + 1) % n for i in range(n)), tuple(range(n))[::-1]])


def full(n: int) -> list[tuple[int, ...]]:
    if n > 8:
        raise ValueError("full groups are given up to 8 nodes; sort the row instead")
    return sorted(permutations(range(n)))


def canonical(nodes: Column | str, group: list[tuple[int, ...]]) -> Column:
    """The lexicographically smallest reordering of an array by the group.

    The full group is a sort; others compare their reorderings inside one expression.  An array
    of another length than the group's is left as it is.
    """
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    n = len(group[0])
    if len(group) == 1:
        return nodes
    factorial = 1
    for i in range(2, n + 1):
        factorial *= i
    best = F.array_sort(nodes) if len(group) == factorial else F.array_min(F.array(*(F.array(*(nodes[i] for i in p)) for p in group)))
    return F.when(F.size(nodes) == n, best).otherwise(nodes)


def equivalent(a: Column, b: Column, group: list[tuple[int, ...]]) -> Column:
    return canonical(a, group) == canonical(b, group)


def unique(rows: DataFrame, group: list[tuple[int, ...]]) -> tuple[DataFrame, DataFrame]:
    """Rows kept once up to symmetry, in canonical order, and ``elem, kept`` for every row.

    The smallest element of each class is kept.
    """
    keyed = rows.select("elem", canonical("nodes", group).alias("nodes"))
    first = keyed.groupBy("nodes").agg(F.min("elem").alias("kept"))
    return first.select(F.col("kept").alias("elem"), "nodes"), keyed.join(first, "nodes").select("elem", "kept")


def find(rows: DataFrame, probes: DataFrame, group: list[tuple[int, ...]]) -> DataFrame:
    """``probe, elem``: the smallest element that equals each probe (probe, nodes) up to symmetry, or null."""
    known = rows.select("elem", canonical("nodes", group).alias("key")).groupBy("key").agg(F.min("elem").alias("elem"))
    asked = probes.select("probe", canonical("nodes", group).alias("key"))
    return asked.join(known, "key", "left").select("probe", "elem")
