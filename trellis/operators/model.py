"""A typed relation with the attributes and symmetries of its entities, which every renumbering moves along."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.relation import renumber
from trellis.operators.symmetry import canonical
from trellis.operators.topology import erased
from trellis.plans.lineage import cut, discard


@dataclass(frozen=True)
class Model:
    """``typed`` holds incidences ``etype, ntype, elem, pos, node``.

    ``attributes`` has for a type a table with ``id`` and any other columns, one row for each entity that has any; entities that only occur there
    belong to the model too.  ``symmetries`` has for a type the orders of its nodes that are the same entity, as places.
    """

    typed: DataFrame
    attributes: dict[str, DataFrame] = field(default_factory=dict)
    symmetries: dict[str, list[tuple[int, ...]]] = field(default_factory=dict)

    def entities(self) -> DataFrame:
        """Different ``type, id`` of incidences and attributes."""
        every = self.typed.select(F.col("etype").alias("type"), F.col("elem").alias("id")).union(self.typed.select("ntype", "node"))
        for kind, table in self.attributes.items():
            every = every.union(table.select(F.lit(kind), F.col("id").cast("long")))
        return every.distinct()

    def types(self) -> list[str]:
        """Names of all types, sorted; there are few."""
        return sorted({r[0] for r in self.entities().select("type").distinct().collect()} | {*self.attributes, *self.symmetries})


def restricted(model: Model, kept: DataFrame) -> tuple[Model, DataFrame]:
    """The part of a model on the entities ``kept`` (type, id), each type renumbered densely in the order of its ids; and ``type, old, new``.

    Incidences stay where both their ends do.
    """
    named = cut(kept.select(F.struct("type", "id").alias("ti")).distinct())
    dense = renumber(named, "ti").select("old.type", F.col("old.id").alias("old"), "new")
    # Numbers run through all types in their order; each type then starts at 0.
    start = dense.groupBy("type").agg(F.min("new").alias("start"))
    moved = cut(dense.join(start, "type").select("type", "old", (F.col("new") - F.col("start")).alias("new")))
    discard(named)
    e, n = (moved.select(F.col("type").alias(t), F.col("old").alias(i), F.col("new").alias("_" + i)) for t, i in (("etype", "elem"), ("ntype", "node")))
    typed = model.typed.join(e, ["etype", "elem"]).join(n, ["ntype", "node"]).select("etype", "ntype", F.col("_elem").alias("elem"), "pos", F.col("_node").alias("node"))
    attributes = {}
    for kind, table in model.attributes.items():
        own = moved.where(F.col("type") == kind).select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        attributes[kind] = table.join(own, F.col("id") == F.col("_old")).select(*(F.col("_new").alias("id") if c == "id" else F.col(f"`{c}`") for c in table.columns))
    return replace(model, typed=typed, attributes=attributes), moved


def compress(model: Model, tombstones: DataFrame) -> tuple[Model, DataFrame]:
    """The model without the ``tombstones`` (type, id) and all that holds one, directly or not, renumbered; and ``type, old, new``."""
    gone = erased(model.typed, tombstones)
    return restricted(model, model.entities().join(gone, ["type", "id"], "left_anti"))


def clone_where(model: Model, etype: str, ntype: str, predicate: str, orphans: bool = False) -> tuple[Model, DataFrame]:
    """A model of the elements of one type whose attributes meet ``predicate``, an SQL condition on ``id`` and the type's attributes, and of their nodes.

    An element without attributes has nulls; one for which the condition is not true is left out.  With ``orphans`` all nodes of the type are kept.
    Attributes of both types and all symmetries go along; other types do not.  Also ``type, old, new``.
    """
    typed = model.typed.where((F.col("etype") == etype) & (F.col("ntype") == ntype))
    attributes = {k: v for k, v in model.attributes.items() if k in (etype, ntype)}
    part = replace(model, typed=typed, attributes=attributes)
    every = model.entities().where(F.col("type") == etype).select("id")
    if etype in attributes:
        every = every.join(attributes[etype].withColumn("id", F.col("id").cast("long")), "id", "left")
    elements = cut(every.where(predicate).select(F.lit(etype).alias("type"), "id"))
    if orphans:
        nodes = model.entities().where(F.col("type") == ntype)
    else:
        nodes = typed.join(elements.select(F.col("id").alias("elem")), "elem", "left_semi").select(F.lit(ntype).alias("type"), F.col("node").alias("id"))
    return restricted(part, elements.union(nodes))


def canonical_rows(model: Model, etype: str, ntype: str) -> DataFrame:
    """``elem, nodes`` of a type in the order that its symmetries make the least; as they are without any."""
    own = model.typed.where((F.col("etype") == etype) & (F.col("ntype") == ntype)).groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("x"))
    rows = own.select("elem", F.transform("x", lambda p: p["node"]).alias("nodes"))
    group = model.symmetries.get(etype)
    return rows if group is None else rows.select("elem", F.when(F.size("nodes") == len(group[0]), canonical("nodes", group)).otherwise(F.col("nodes")).alias("nodes"))


def without_duplicates(model: Model, etype: str, ntype: str) -> tuple[Model, DataFrame]:
    """The model with one entity for each class of equal rows of a type, up to its symmetries: the smallest, to which all references then lead; and ``type, old, new``.

    What it alone had of attributes stays; those of its doubles go.
    """
    rows = cut(canonical_rows(model, etype, ntype))
    first = rows.groupBy("nodes").agg(F.min("elem").alias("first"), F.count("*").alias("n")).where("n > 1")
    double = cut(rows.join(first, "nodes").where("elem <> first").select(F.col("elem").alias("id"), "first"))
    discard(rows)
    to = double.select(F.lit(etype).alias("ntype"), F.col("id").alias("node"), "first")
    typed = model.typed.join(to, ["ntype", "node"], "left").select("etype", "ntype", "elem", "pos", F.coalesce("first", "node").alias("node"))
    kept = model.entities().join(double.select(F.lit(etype).alias("type"), "id"), ["type", "id"], "left_anti")
    return restricted(replace(model, typed=typed), kept)
