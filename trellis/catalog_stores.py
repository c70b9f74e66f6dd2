"""Registered queries of walks over types, several eigenvalues, composite duplicates and stored relations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trellis.catalog import _TRIPLES, _triples, orders_to_parts, orders_to_suppliers, query, table
from trellis.operators import graph, model, relation as rel, solvers, sparse, symmetry
from trellis.plans.lineage import cut, shared_dir
from trellis.sources import meshes
from trellis.sources.store import CanonicalIndex, refresh_transpose, relation_store

#: Orders, suppliers and nations by weighted ways, both ways each.
_WAYS = """, one AS (SELECT 'order' AS st, l_orderkey AS s, 'supplier' AS dt, l_suppkey AS d, min(l_quantity)::double AS w FROM lineitem GROUP BY 2, 4
UNION ALL SELECT 'supplier', s_suppkey, 'nation', s_nationkey, 100.0::double FROM supplier),
ways AS MATERIALIZED (SELECT st || ':' || s AS s, dt || ':' || d AS d, st, s AS si, dt, d AS di, w FROM one UNION ALL SELECT dt || ':' || d, st || ':' || s, dt, d, st, s, w FROM one)"""


def _ways(spark, d):
    bought = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.min("l_quantity").cast("double").alias("weight"))
    one = bought.select(F.lit("order").alias("src_type"), "src", F.lit("supplier").alias("dst_type"), "dst", "weight").unionByName(table(spark, d, "supplier").select(
        F.lit("supplier").alias("src_type"), F.col("s_suppkey").alias("src"), F.lit("nation").alias("dst_type"), F.col("s_nationkey").cast("long").alias("dst"), F.lit(100.0).alias("weight")))
    return one.unionByName(one.select(F.col("dst_type").alias("src_type"), F.col("dst").alias("src"), F.col("src_type").alias("dst_type"), F.col("src").alias("dst"), "weight"))


@query("typed_shortest_paths", _WAYS + """,
far(id, type, key, dist) USING KEY (id) AS (SELECT 'nation:0', 'nation', 0::bigint, 0.0::double UNION SELECT t.d, t.dt, t.di, t.dist FROM
  (SELECT ways.d, dt, di, min(dist + w) AS dist FROM far JOIN ways ON far.id = ways.s GROUP BY ALL) t LEFT JOIN recurring.far AS old ON old.id = t.d WHERE old.id IS NULL OR t.dist < old.dist - 1e-12),
back AS (SELECT b.id, min((st, si)) AS p FROM far b JOIN ways ON b.id = ways.d JOIN far a ON a.id = ways.s AND abs(a.dist + w - b.dist) < 1e-9 WHERE b.dist > 0 GROUP BY b.id)
SELECT type, key AS id, dist, p[1] AS pred_type, p[2]::bigint AS pred FROM far LEFT JOIN back USING (id)""")
def _(spark, d):
    return graph.typed_shortest_paths(_ways(spark, d), spark.createDataFrame([("nation", 0)], "type string, id long"))


@query("smallest_eigenpairs")
def _(spark, d):
    """How suppliers share orders, as a grounded network: the five slowest modes."""
    shared = rel.pairs(orders_to_suppliers(spark, d))
    met = shared.select("elem", F.col("node").alias("i")).join(shared.select("elem", F.col("node").alias("j")), "elem").where("i <> j").groupBy("i", "j").agg(F.count("*").cast("double").alias("w"))
    ground = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (1 + F.abs("s_acctbal") / 100).cast("double").alias("w"))
    diagonal = met.select("i", "w").unionByName(ground).groupBy("i").agg(F.sum("w").alias("v")).select("i", F.col("i").alias("j"), "v")
    cells = met.select("i", "j", (-F.col("w")).alias("v")).unionByName(diagonal)
    return solvers.smallest_eigenpairs(sparse.Matrix(cells, 1 << 40, 1 << 40), 5)[0]


@query("matrix_blocked_product", "SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def _(spark, d):
    """Parts by parts, over the orders that hold both; blocks of two cells a side, so that most orders are dealt."""
    from trellis.catalog import quantities

    m = quantities(spark, d)
    return m.transpose().times(m, block=2).cells.select("i", "j", F.col("v").cast("double").alias("v"))


_TYPED = """, ty AS (SELECT DISTINCT 'order' AS etype, elem, 'part' AS ntype, node FROM i UNION ALL SELECT DISTINCT 'order', elem, 'supplier', node FROM s)"""


def _typed_lines(spark, d):
    typed = lambda pairs, kind: pairs.select(F.lit("order").alias("etype"), "elem", F.lit(kind).alias("ntype"), "node")
    return typed(orders_to_parts(spark, d), "part").unionByName(typed(orders_to_suppliers(spark, d), "supplier"))


@query("composite_duplicates", _TYPED + """, l AS (SELECT elem, list((ntype, node) ORDER BY ntype, node) AS nodes FROM ty GROUP BY elem), f AS (SELECT nodes, min(elem) AS first FROM l GROUP BY nodes)
SELECT 'order' AS etype, elem, first FROM l JOIN f USING (nodes) WHERE elem <> first""")
def _(spark, d):
    return rel.composite_duplicates(_typed_lines(spark, d))


@query("changed_signature", "SELECT count(*) AS n, true AS same FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R')")
def _(spark, d):
    """Orders and parts of lines that were not returned: the signature by differences is that of the rows."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"), (F.col("l_returnflag") != "R").alias("left"))
    pairs = cut(rel.dealt(lines, "elem", "node").groupBy("elem", "node").agg(F.coalesce(F.bool_or("left"), F.lit(False)).alias("left")))
    typed = lambda some: some.select(F.lit("order").alias("etype"), "elem", F.lit("part").alias("ntype"), "node")
    every, left = typed(pairs), typed(pairs.where("left"))
    kept = rel.changed_signature(rel.relation_signature(every), every.limit(0), typed(pairs.where("not left")))
    own = rel.relation_signature(left).select(F.col("s1").alias("o1"), F.col("s2").alias("o2"))
    return kept.join(own).select("n", ((F.col("s1") == F.col("o1")) & (F.col("s2") == F.col("o2"))).alias("same"))


def _fresh(spark) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@query("stored_relation", "SELECT node, elem FROM i WHERE (elem, node) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    """Three batches into a stored relation, the last of which takes out what was returned, and its transpose after each."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"), "l_shipdate", "l_returnflag")
    store, back = relation_store(spark, _fresh(spark), 16), relation_store(spark, _fresh(spark), 16, by="node")
    for number, (added, removed) in enumerate([(lines.where("l_shipdate < '1995-06-17'"), None), (lines, None), (lines.limit(0), lines.where("l_returnflag = 'R'"))]):
        store.apply(added, removed, ("query", number))
        refresh_transpose(store, back)
    return back.read().select("node", "elem")


@query("stored_canonical_index", _TRIPLES + """, d AS (SELECT elem, list_sort(nodes) AS nodes, (SELECT any_value(o_orderdate) FROM orders WHERE o_orderkey = elem // 1000) < '1995-06-17' AS early FROM t),
f AS (SELECT nodes, coalesce(min(elem) FILTER (early), min(elem)) AS first FROM d GROUP BY nodes) SELECT elem, first FROM d JOIN f USING (nodes)""")
def _(spark, d):
    """Triples of suppliers, those of earlier orders first: a class stays with the element that brought it in."""
    rows = _triples(spark, d)
    early = table(spark, d, "orders").where("o_orderdate < '1995-06-17'").select("o_orderkey")
    index = CanonicalIndex(spark, _fresh(spark), symmetry.full(3), 16)
    index.store.apply(index._canonical(rows.join(early, F.expr("elem div 1000") == F.col("o_orderkey"), "left_semi")))
    return index.add(rows)


def _order_model(spark, d):
    """Orders of parts, with prices and sizes; an order's parts may stand in any order."""
    typed = rel.numbered(orders_to_parts(spark, d)).select(F.lit("order").alias("etype"), F.lit("part").alias("ntype"), "elem", "pos", "node")
    prices = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus")
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"), "p_name")
    return model.Model(typed, {"order": prices, "part": sizes}, {"order": symmetry.full(2)})


def _model_rows(made):
    orders = made.attributes["order"].select(F.col("id").alias("elem"), "price", "o_orderstatus")
    return made.typed.join(orders, "elem").join(made.attributes["part"].select(F.col("id").alias("node"), "size"), "node").select("elem", F.col("pos").cast("long").alias("pos"), "node", "price", "o_orderstatus", "size")


@query("clone_where", """, k AS (SELECT o_orderkey AS elem, o_totalprice::double AS price, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000),
e AS (SELECT *, row_number() OVER (ORDER BY elem) - 1 AS e FROM k), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS n FROM (SELECT DISTINCT node FROM p JOIN k USING (elem)))
SELECT e AS elem, pos, n AS node, price, o_orderstatus, p_size::bigint AS size FROM p JOIN e USING (elem) JOIN n USING (node) JOIN part ON p_partkey = p.node""")
def _(spark, d):
    return _model_rows(model.clone_where(_order_model(spark, d), "order", "part", "o_orderstatus = 'F' and price > 100000")[0])


@query("compressed_attributes", """, gone AS (SELECT DISTINCT elem FROM i JOIN part ON p_partkey = node WHERE p_size > 45),
e AS (SELECT o_orderkey AS elem, o_totalprice::double AS price, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS e FROM orders WHERE o_orderkey NOT IN (SELECT elem FROM gone)),
n AS (SELECT p_partkey AS node, p_size::bigint AS size, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part WHERE p_size <= 45)
SELECT e AS elem, pos, n AS node, price, o_orderstatus, size FROM p JOIN e USING (elem) JOIN n USING (node)""")
def _(spark, d):
    gone = table(spark, d, "part").where("p_size > 45").select(F.lit("part").alias("type"), F.col("p_partkey").alias("id"))
    return _model_rows(model.compress(_order_model(spark, d), gone)[0])


@query("model_without_doubles", """, f AS (SELECT nodes, min(elem) AS first FROM r GROUP BY nodes), e AS (SELECT o_orderkey AS elem, o_totalprice::double AS price, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS e
  FROM orders WHERE o_orderkey NOT IN (SELECT elem FROM r JOIN f USING (nodes) WHERE elem <> first)), n AS (SELECT p_partkey AS node, p_size::bigint AS size, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)
SELECT e AS elem, pos, n AS node, price, o_orderstatus, size FROM p JOIN e USING (elem) JOIN n USING (node)""")
def _(spark, d):
    """Written to files and read again, then with one order for each set of parts."""
    path = _fresh(spark)
    meshes.write_model(_order_model(spark, d), path)
    return _model_rows(model.without_duplicates(meshes.read_model(spark, path), "order", "part")[0])


@query("matrix_transposed_positions", "SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS at, row_number() OVER (ORDER BY j, i) - 1 AS \"to\" FROM m")
def _(spark, d):
    from trellis.catalog import quantities

    return sparse.transposed_positions(quantities(spark, d))


@query("type_order", "SELECT unnest(['region', 'nation', 'part', 'supplier', 'customer', 'order']) AS id, unnest([0, 1, 0, 2, 2, 3])::bigint AS level", shared=False)
def _(spark, d):
    """Which types refer to which, from the keys of all tables."""
    refers = lambda name, e, key, n, other: table(spark, d, name).select(F.lit(e).alias("etype"), F.lit(n).alias("ntype"), F.col(key).cast("long").alias("elem"), F.col(other).cast("long").alias("node"))
    typed = refers("nation", "nation", "n_nationkey", "region", "n_regionkey")
    for more in (refers("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), refers("customer", "customer", "c_custkey", "nation", "c_nationkey"), refers("orders", "order", "o_orderkey", "customer", "o_custkey"),
                 refers("lineitem", "order", "l_orderkey", "part", "l_partkey"), refers("lineitem", "order", "l_orderkey", "supplier", "l_suppkey")):
        typed = typed.unionByName(more)
    return graph.type_order(typed)[0].select("id", F.col("level").cast("long").alias("level"))


@query("tree_paths", """WITH t AS (SELECT s_suppkey AS target, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT 1000 + target AS target, 0::bigint AS nth, 0::bigint AS id FROM t UNION ALL SELECT 1000 + target, 1, 1 + n_regionkey FROM t UNION ALL SELECT 1000 + target, 2, 100 + s_nationkey FROM t UNION ALL SELECT 1000 + target, 3, 1000 + target FROM t""", shared=False)
def _(spark, d):
    """The ways from a root through regions and nations to every supplier."""
    long = lambda c: F.col(c).cast("long")
    tree = table(spark, d, "region").select((1 + long("r_regionkey")).alias("id"), F.lit(0).cast("long").alias("pred")).unionByName(
        table(spark, d, "nation").select((100 + long("n_nationkey")).alias("id"), (1 + long("n_regionkey")).alias("pred"))).unionByName(
        table(spark, d, "supplier").select((1000 + long("s_suppkey")).alias("id"), (100 + long("s_nationkey")).alias("pred")))
    root = spark.createDataFrame([(0, -1)], "id long, pred long")
    ways = graph.paths(tree.unionByName(root), table(spark, d, "supplier").select((1000 + long("s_suppkey")).alias("id")))
    return ways.select("target", F.col("nth").cast("long").alias("nth"), "id")
