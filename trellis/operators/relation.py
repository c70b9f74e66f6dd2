"""Many-to-many relations: ordered rows of nodes for each element.

Two shapes of the same data are used.  *Rows* are ``elem LONG, nodes ARRAY<LONG>``; *incidences*
are ``elem, pos, node``, one line per place.  ``pairs`` are distinct ``elem, node``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _none() -> Column:
    """An empty row."""
    return F.array().cast("array<bigint>")


def incidences(rows: DataFrame) -> DataFrame:
    """``elem, pos, node`` of every place of every row; empty rows give none."""
    return rows.select("elem", F.posexplode("nodes").alias("pos", "node"))


def rows(incidence: DataFrame) -> DataFrame:
    """``elem, nodes`` in order of ``pos``."""
    listed = incidence.groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("x"))
    return listed.select("elem", F.transform("x", lambda p: p["node"]).alias("nodes"))


def pairs(incidence: DataFrame) -> DataFrame:
    return incidence.select("elem", "node").distinct()


def numbered(pairs_: DataFrame) -> DataFrame:
    """``elem, pos, node`` of distinct pairs, placed in order of node."""
    order = Window.partitionBy("elem").orderBy("node")
    return pairs_.select("elem", (F.row_number().over(order) - 1).alias("pos"), "node")


def with_gaps(rows_: DataFrame, count: int, key: str = "elem", value: str = "nodes") -> DataFrame:
    """Rows 0 to ``count`` - 1, empty where ``rows_`` has none."""
    every = rows_.sparkSession.range(count).select(F.col("id").alias(key))
    return every.join(rows_, key, "left").select(key, F.coalesce(value, _none()).alias(value))


def transpose(incidence: DataFrame, strict: bool = False) -> DataFrame:
    """``node, elems``: the sorted different elements of each node.

    Negative nodes are skipped, or an error when ``strict``.  Nodes without elements have no row;
    ``with_gaps`` adds them.
    """
    if strict:
        incidence = incidence.withColumn("node", F.when(F.col("node") >= 0, F.col("node")).otherwise(
            F.raise_error(F.concat(F.lit("negative node "), F.col("node").cast("string"))).cast("long")))
    kept = incidence.where("node >= 0")
    return kept.groupBy("node").agg(F.array_sort(F.collect_set("elem")).alias("elems"))


def statistics(rows_: DataFrame) -> DataFrame:
    """One row: number of rows and incidences, smallest, largest and mean row length, largest node."""
    n = F.size("nodes")
    return rows_.agg(
        F.count("*").alias("elements"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("incidences"),
        F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_degree"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_degree"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_degree"), F.coalesce(F.max(F.array_max("nodes")), F.lit(-1)).cast("long").alias("max_node"))


def shortlex(rows_: DataFrame) -> DataFrame:
    """Rows by length, then lexicographically, then by element; sorted across all partitions."""
    return rows_.orderBy(F.size("nodes"), "nodes", "elem")


def duplicates(rows_: DataFrame) -> DataFrame:
    """``elem, first``: rows that repeat an earlier one exactly, and the smallest element that has it."""
    first = rows_.groupBy("nodes").agg(F.min("elem").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows_.join(first, "nodes").where("elem <> first").select("elem", "first")


def _both(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.select("elem", F.col("nodes").alias("l")).join(right.select("elem", F.col("nodes").alias("r")), "elem", how)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row by row: all nodes of either, sorted; elements of either."""
    return _both(left, right, "full").select("elem", F.array_sort(F.array_union(F.coalesce("l", _none()), F.coalesce("r", _none()))).alias("nodes"))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row by row: nodes of both, sorted; elements of both."""
    return _both(left, right, "inner").select("elem", F.array_sort(F.array_intersect("l", "r")).alias("nodes"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row by row: nodes of the left only, sorted; rows the right lacks stay as they are."""
    kept = F.when(F.col("r").isNull(), F.col("l")).otherwise(F.array_sort(F.array_except("l", "r")))
    return _both(left, right, "left").select("elem", kept.alias("nodes"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row by row: nodes of one side only, sorted; elements of either."""
    a, b = F.coalesce("l", _none()), F.coalesce("r", _none())
    return _both(left, right, "full").select("elem", F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a))).alias("nodes"))


#: Places that travel with a pair at most (``product``).
CARRIED = 64


def _carried(pairs_: DataFrame, key: str, below: str, most: int) -> tuple[DataFrame, DataFrame]:
    """``key, via`` of keys with ``most`` vias or less, each with the smaller vias of its key (``below``), and of all other keys."""
    counted = pairs_.withColumn("n", F.count("*").over(Window.partitionBy(key)))
    listed = counted.where(F.col("n") <= most).groupBy(key).agg(F.array_sort(F.collect_set("via")).alias("l"))
    few = listed.select(key, F.posexplode("l").alias("pos", "via"), "l").select(key, "via", F.slice("l", F.lit(1), F.col("pos")).alias(below))
    return few, counted.where(F.col("n") > most).select(key, "via")


def dealt(made: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by some columns into a set number of parts, which are not put together."""
    return made.repartition(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _different(made: DataFrame) -> DataFrame:
    """Distinct ``elem, node``, dealt first and into a set number of parts: a task that makes many of few rows would hold them all, and parts that are put together are large."""
    return dealt(made, "elem", "node").distinct()


def product(a: DataFrame, b: DataFrame, carried: int = CARRIED) -> DataFrame:
    """Distinct ``elem, node``: the nodes that b has for the nodes that a has (pairs in, pairs out).

    An element and a node of up to ``carried`` vias each bring them along, and make their pair where the smallest via that they share
    meets: so these pairs are different as they are made.  All others are made at every via, dealt, and made different then.
    """
    left = a.select("elem", F.col("node").alias("via")).where("via is not null")
    right = b.select(F.col("elem").alias("via"), "node").where("via is not null")
    # Where one side has no such keys, nothing travels.
    if any(side.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") <= carried).isEmpty() for side, key in ((left, "elem"), (right, "node"))):
        return _different(left.join(right.hint("merge"), "via").select("elem", "node"))
    few, many = _carried(left, "elem", "low", carried)
    short, long = _carried(right, "node", "least", carried)
    once = few.join(short.hint("merge"), "via").where(~F.arrays_overlap("low", "least")).select("elem", "node")
    rest = few.select("elem", "via").join(long.hint("merge"), "via").select("elem", "node").unionAll(many.join(right.hint("merge"), "via").select("elem", "node"))
    return once.unionAll(_different(rest))


def same(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows."""
    a, b = left.select("elem", "nodes"), right.select("elem", "nodes")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def same_rows_in_any_order(left: DataFrame, right: DataFrame) -> bool:
    a, b = left.select("nodes"), right.select("nodes")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def permute_nodes(rows_: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with each node replaced by ``mapping`` (node, to); a node without an image is an error."""
    moved = incidences(rows_).join(mapping.select("node", "to"), "node", "left")
    moved = moved.withColumn("to", F.coalesce("to", F.raise_error(F.lit("node without an image")).cast("long")))
    return rows(moved.select("elem", "pos", F.col("to").alias("node")))


def dealt_in_order(rows_: DataFrame, *columns: str) -> DataFrame:
    """``rows_`` dealt by ranges of some columns and sorted by them."""
    return rows_.repartitionByRange(*columns).sortWithinPartitions(*columns)


def numbered_in_order(dealt: DataFrame) -> DataFrame:
    """Rows in the order of their partitions, with ``new``: dense numbers from 0 in that order.

    They are written once with their places; a partition's numbers follow those of the partitions before it.
    """
    from trellis.plans.lineage import cut

    placed = cut(dealt.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").select(*dealt.columns, (F.col("offset") + F.col("at")).alias("new"))


def renumber(pairs_or_rows: DataFrame, column: str) -> DataFrame:
    """``old, new``: dense numbers from 0 for the different values of a column, in their order.

    Numbers are made without gathering: values are dealt by range, a partition's values follow
    those of the partitions before it.
    """
    values = pairs_or_rows.select(F.col(column).alias("old")).where("old is not null").distinct()
    return numbered_in_order(dealt_in_order(values, "old"))


def invalid(rows_: DataFrame) -> DataFrame:
    """Rows with a null, negative or repeated node, and which it is."""
    why = (F.when(F.col("nodes").isNull(), "null row").when(F.exists("nodes", lambda x: x.isNull()), "null node")
           .when(F.exists("nodes", lambda x: x < 0), "negative node")
           .when(F.size(F.array_distinct("nodes")) < F.size("nodes"), "repeated node"))
    return rows_.select("elem", "nodes", why.alias("why")).where("why is not null")


def is_sorted() -> Column:
    """Whether ``nodes`` ascends."""
    return F.array_sort("nodes") == F.col("nodes")


def to_csr(rows_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(elem, start, stop)`` and ``(at, node)``: rows end to end in order of element.

    Starts are prefix sums from totals of range-dealt partitions, not from one global window.
    """
    from trellis.plans.lineage import cut

    dealt = cut(rows_.select("elem", "nodes", F.size("nodes").cast("long").alias("n")).repartitionByRange("elem").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    run = Window.partitionBy("part").orderBy("elem").rowsBetween(Window.unboundedPreceding, 0)
    stops = dealt.withColumn("upto", F.sum("n").over(run)).join(F.broadcast(offsets), "part")
    stops = stops.select("elem", "nodes", (F.col("offset") + F.col("upto") - F.col("n")).alias("start"), (F.col("offset") + F.col("upto")).alias("stop"))
    cells = stops.select("start", F.posexplode("nodes").alias("k", "node")).select((F.col("start") + F.col("k")).alias("at"), "node")
    return stops.select("elem", "start", "stop"), cells


def from_csr(pointers: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows from ``(elem, start, stop)`` and ``(at, node)``; each cell's row is found by an equi-join."""
    places = pointers.select("elem", "start", F.explode(F.when(F.col("stop") > F.col("start"), F.sequence("start", F.col("stop") - 1))).alias("at"))
    full = rows(places.join(cells, "at").select("elem", (F.col("at") - F.col("start")).alias("pos"), "node"))
    return pointers.select("elem").join(full, "elem", "left").select("elem", F.coalesce("nodes", _none()).alias("nodes"))


def to_boolean(rows_: DataFrame, columns: int) -> DataFrame:
    """``elem, flags``: for each of ``columns`` nodes, whether the row holds it."""
    return rows_.select("elem", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.array_contains("nodes", j.cast("long"))).alias("flags"))


def from_boolean(flags: DataFrame) -> DataFrame:
    held = F.filter(F.transform("flags", lambda f, j: F.when(f, j.cast("long"))), lambda j: j.isNotNull())
    return flags.select("elem", held.alias("nodes"))


def to_flags(rows_: DataFrame, columns: int) -> DataFrame:
    """``elem, flags``: as ``to_boolean``, as a text of 0 and 1; other nodes are left out.

    Texts are made and read by runs between nodes, so wide rows cost their letters and no step of a plan for each of them.
    """
    held = F.array_sort(F.array_distinct(F.filter("nodes", lambda n: (n >= 0) & (n < columns))))
    # Each node's text ends with its 1: what lies before it, and last what lies behind the last.
    runs = F.transform(held, lambda n, k: F.concat(F.repeat(F.lit("0"), (n - F.coalesce(F.get(held, k - 1), F.lit(-1)) - 1).cast("int")), F.lit("1")))
    tail = F.repeat(F.lit("0"), (F.lit(columns - 1) - F.coalesce(F.array_max(held), F.lit(-1))).cast("int"))
    return rows_.select("elem", F.concat(F.array_join(runs, ""), tail).alias("flags"))


def from_flags(flags: DataFrame) -> DataFrame:
    """Rows of ``to_flags``: sorted different nodes."""
    runs = F.split("flags", "1")
    # The k-th 1 stands behind k ones and the zeros of k + 1 runs; what follows the last 1 is no node's.
    ends = F.aggregate(F.slice(runs, 1, F.size(runs) - 1), _none(), lambda out, run: F.array_append(out, F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(-1).cast("long")) + F.length(run) + 1))
    return flags.select("elem", ends.alias("nodes"))


def to_runs(rows_: DataFrame, columns: int) -> DataFrame:
    """``elem, runs``: the flags of ``to_flags`` as lengths of runs, zeros and ones in turn, from zeros on; they add up to ``columns``.

    The same flags, whose size follows the nodes and not the columns.
    """
    held = F.array_sort(F.array_distinct(F.filter("nodes", lambda n: (n >= 0) & (n < columns))))
    first = F.filter(held, lambda n, k: (k == 0) | (F.get(held, k - 1) != n - 1))
    last = F.filter(held, lambda n, k: (k == F.size(held) - 1) | (F.get(held, k + 1) != n + 1))
    ends = rows_.select("elem", first.alias("first"), last.alias("last"))
    ones = F.transform("first", lambda n, k: F.array(n - F.coalesce(F.get("last", k - 1), F.lit(-1)) - 1, F.get("last", k) - n + 1))
    tail = F.lit(columns - 1).cast("long") - F.coalesce(F.get("last", F.size("last") - 1), F.lit(-1).cast("long"))
    return ends.select("elem", F.concat(F.flatten(ones), F.array(tail)).alias("runs"))


def from_runs(runs: DataFrame) -> DataFrame:
    """Rows of ``to_runs``: sorted different nodes."""
    none = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))
    # Runs at odd places are ones.
    step = lambda s, r: F.struct((s["at"] + r["n"]).alias("at"), F.when((r["k"] % 2 == 1) & (r["n"] > 0), F.concat(s["out"], F.sequence(s["at"], s["at"] + r["n"] - 1))).otherwise(s["out"]).alias("out"))
    each = F.transform("runs", lambda n, k: F.struct(n.alias("n"), k.alias("k")))
    return runs.select("elem", F.aggregate(each, none, step, lambda s: s["out"]).alias("nodes"))


def node_positions(incidence: DataFrame) -> DataFrame:
    """``node, elem, pos, nth``: where each node stands in its elements, and which of its elements that is."""
    order = Window.partitionBy("node").orderBy("elem", "pos")
    return incidence.select("node", "elem", "pos", (F.row_number().over(order) - 1).alias("nth"))


def random_relation(spark: SparkSession, elements: int, nodes: int, degree: int, seed: int = 0) -> DataFrame:
    """Rows of up to ``degree`` different nodes drawn at random, the same for the same seed."""
    drawn = F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(nodes)))
    return spark.range(elements).select(F.col("id").alias("elem"), F.array_sort(F.array_distinct(drawn)).alias("nodes"))


#: Places of a node up to which its meetings are numbered in one task (``clique_indices``).
TOGETHER = 1 << 16


def clique_indices(incidence: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``elem, i, j, slot``: for each ordered pair of places of an element, where the second place's node
    stands among the different nodes that the first one's node meets, in order of first meeting.

    A node's meetings are ordered by element and place; this is the cell order of an assembled row.  Each place is sent to its
    node once, with the element's row, and pairs are made there; those of nodes of more than ``together`` places are met by joins.
    """
    from trellis.plans.lineage import cut_counted

    at = incidence.select("elem", "pos", "node").where("elem is not null and node is not null")
    placed = at.groupBy("elem").agg(F.collect_list(F.struct("pos", "node")).alias("p")).select("elem", "p", F.explode("p").alias("x"))
    placed = placed.select("elem", F.col("x.pos").alias("i"), F.col("x.node").alias("n1"), "p")
    hot, (some,) = cut_counted(at.groupBy(F.col("node").alias("n1")).agg(F.count("*").alias("n")).where(F.col("n") > together).select("n1"), F.count(F.lit(1)))
    few = placed.join(hot, "n1", "left_anti") if some else placed
    # A set number of parts: what is made of a place is many times its size.
    pairs_ = dealt(few, "n1").select("n1", "elem", "i", F.explode("p").alias("y")).select("n1", "elem", "i", F.col("y.pos").alias("j"), F.col("y.node").alias("n2"))
    first = F.min(F.struct("elem", "i", "j")).over(Window.partitionBy("n1", "n2"))
    order = Window.partitionBy("n1").orderBy("first")
    out = pairs_.withColumn("first", first).select("elem", "i", "j", (F.dense_rank().over(order) - 1).cast("long").alias("slot"))
    if not some:
        return out
    met = placed.join(hot, "n1", "left_semi").select("n1", "elem", "i", F.explode("p").alias("y")).select("n1", "elem", "i", F.col("y.pos").alias("j"), F.col("y.node").alias("n2"))
    firsts = met.groupBy("n1", "n2").agg(F.min(F.struct("elem", "i", "j")).alias("first"))
    slots = firsts.select("n1", "n2", (F.row_number().over(order) - 1).cast("long").alias("slot"))
    return out.unionByName(met.join(slots, ["n1", "n2"]).select("elem", "i", "j", "slot"))


def nodes_of(rows_: DataFrame, elements: DataFrame) -> DataFrame:
    """The rows of some elements (elem)."""
    return rows_.join(elements.select("elem").distinct(), "elem", "left_semi")


def elements_at(pairs_: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, elem`` of some nodes (node)."""
    return pairs_.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "elem")


def dangling(incidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Places whose node is not among ``nodes`` (node)."""
    return incidence.join(nodes.select("node"), "node", "left_anti").select("elem", "pos", "node")


def membership(pairs_: DataFrame, probes: DataFrame) -> DataFrame:
    """``elem, node, found`` for ``probes`` (elem, node): whether the element exists and holds the node."""
    return probes.join(pairs_.select("elem", "node").distinct().withColumn("found", F.lit(True)), ["elem", "node"], "left").select("elem", "node", F.coalesce("found", F.lit(False)).alias("found"))


def local_index(incidence: DataFrame, probes: DataFrame) -> DataFrame:
    """``elem, node, pos`` for ``probes`` (elem, node): the first place of the node in the element, or -1."""
    first = incidence.groupBy("elem", "node").agg(F.min("pos").alias("pos"))
    return probes.join(first, ["elem", "node"], "left").select("elem", "node", F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"))


def _signed(*columns: str) -> tuple[Column, Column, Column]:
    """The number of rows and 128 bits of them, whatever their order: two hashes, each combined by exclusive or."""
    return F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("s1"), F.bit_xor(F.xxhash64(F.lit("trellis"), *reversed(columns))).alias("s2")


def signatures(typed: DataFrame) -> DataFrame:
    """``etype, elem, n, s1, s2``: a signature of each entity's different (ntype, node), free of their order.

    Rows that are added or taken away change it by their own hashes, so it can be kept up by differences.
    """
    return typed.select("etype", "elem", "ntype", "node").distinct().groupBy("etype", "elem").agg(*_signed("ntype", "node"))


def relation_signature(typed: DataFrame) -> DataFrame:
    """One row ``n, s1, s2`` for the different rows of a whole relation; of an empty one 0, 0, 0."""
    n, one, two = _signed("etype", "elem", "ntype", "node")
    # A set number of parts: rows of small numbers shrink so well that parts which are put together are large.
    rows_ = dealt(typed.select("etype", "elem", "ntype", "node"), "etype", "elem", "ntype", "node").distinct().agg(n, one, two)
    return rows_.select("n", F.coalesce("s1", F.lit(0)).cast("long").alias("s1"), F.coalesce("s2", F.lit(0)).cast("long").alias("s2"))


def changed_signature(signature: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The signature after rows are ``added`` that were not there and ``removed`` that were."""
    plus, minus = (relation_signature(x).select(F.col("n").alias("n" + k), F.col("s1").alias("s1" + k), F.col("s2").alias("s2" + k)) for x, k in ((added, "a"), (removed, "r")))
    xor = lambda c: F.col(c).bitwiseXOR(F.col(c + "a")).bitwiseXOR(F.col(c + "r")).alias(c)
    return signature.join(plus).join(minus).select((F.col("n") + F.col("na") - F.col("nr")).alias("n"), xor("s1"), xor("s2"))


def composite_duplicates(typed: DataFrame) -> DataFrame:
    """``etype, elem, first``: entities with the same nodes of every type as an earlier one of their own type, and the smallest that has them.

    Only entities whose signatures meet are compared, in full.
    """
    signed = signatures(typed)
    met = signed.groupBy("etype", "n", "s1", "s2").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    again = signed.join(met, ["etype", "n", "s1", "s2"]).select("etype", "elem", "s1", "s2")
    full = typed.select("etype", "elem", "ntype", "node").distinct().join(again, ["etype", "elem"]).groupBy("etype", "s1", "s2", "elem").agg(F.array_sort(F.collect_list(F.struct("ntype", "node"))).alias("all"))
    first = full.groupBy("etype", "s1", "s2", "all").agg(F.min("elem").alias("first"))
    return full.join(first, ["etype", "s1", "s2", "all"]).where("elem <> first").select("etype", "elem", "first")
