"""The registered queries of the library and their DuckDB equivalents.

Orders and parts of ``lineitem`` serve as elements and nodes, with a part's place in an order by
its key; orders, customers, nations and regions as typed entities; quantities as matrix cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import geometry as g
from trellis.operators import dense, graph, mesh, query as q, relation as rel, solvers, sparse, symmetry, topology
from trellis.operators.components import connected_components
from trellis.plans.lineage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the DuckDB side.
_WITH = """WITH RECURSIVE i AS (SELECT DISTINCT l_orderkey AS elem, l_partkey AS node FROM lineitem),
s AS (SELECT DISTINCT l_orderkey AS elem, l_suppkey AS node FROM lineitem),
p AS (SELECT elem, node, row_number() OVER (PARTITION BY elem ORDER BY node) - 1 AS pos FROM i),
r AS (SELECT elem, list(node ORDER BY node) AS nodes FROM i GROUP BY elem),
rs AS (SELECT elem, list(node ORDER BY node) AS nodes FROM s GROUP BY elem),
m AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
dual AS (SELECT a.elem AS e1, b.elem AS e2, count(*) AS shared FROM i a JOIN i b ON a.node = b.node AND a.elem < b.elem GROUP BY 1, 2)
"""


def query(name: str, oracle: str | None = None, shared: bool = True):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``; ``oracle`` may use the common tables."""

    def add(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = (_WITH if shared else "") + oracle
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_to_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of orders (elements) and parts (nodes)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node")).distinct()


def orders_to_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_suppkey").alias("node")).distinct()


def as_rows(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("elem").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def quantities(spark: SparkSession, sf_dir: str) -> sparse.Matrix:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return sparse.from_cells(cells, 1 << 40, 1 << 40)


def said(column: str) -> Column:
    """An array of numbers as text."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


# Relations


@query("transpose", "SELECT node, array_to_string(list(DISTINCT elem ORDER BY elem), ',') AS elems FROM i GROUP BY node")
def _(spark, d):
    return rel.transpose(orders_to_parts(spark, d)).select("node", said("elems"))


@query("transpose_with_gaps", """, t AS (SELECT node, list(DISTINCT elem ORDER BY elem) AS elems FROM s GROUP BY node)
SELECT n AS node, coalesce(array_to_string(elems, ','), '') AS elems FROM range((SELECT max(node) + 1 FROM s)) x(n) LEFT JOIN t ON n = node""")
def _(spark, d):
    pairs = orders_to_suppliers(spark, d)
    top = pairs.agg(F.max("node")).first()[0]
    return rel.with_gaps(rel.transpose(pairs), top + 1, "node", "elems").select("node", said("elems"))


@query("relation_statistics", """SELECT count(*) AS elements, sum(len(nodes))::bigint AS incidences, min(len(nodes)) AS min_degree,
max(len(nodes)) AS max_degree, round(avg(len(nodes)), 6) AS avg_degree, max(list_max(nodes)) AS max_node FROM r""")
def _(spark, d):
    return rel.statistics(as_rows(orders_to_parts(spark, d))).withColumn("avg_degree", F.round("avg_degree", 6))


@query("shortlex_order", "SELECT elem, array_to_string(nodes, ',') AS nodes FROM r ORDER BY len(nodes), nodes, elem")
def _(spark, d):
    return rel.shortlex(as_rows(orders_to_parts(spark, d))).select("elem", said("nodes"))


@query("duplicate_rows", """, f AS (SELECT nodes, min(elem) AS first FROM rs GROUP BY nodes HAVING count(*) > 1)
SELECT elem, first FROM rs JOIN f USING (nodes) WHERE elem <> first""")
def _(spark, d):
    return rel.duplicates(as_rows(orders_to_suppliers(spark, d)))


_ROWWISE = """SELECT elem, array_to_string(list_sort({}), ',') AS nodes FROM r {} JOIN (SELECT elem, nodes AS other FROM rs) USING (elem)"""


def _two(spark, d):
    return as_rows(orders_to_parts(spark, d)), as_rows(orders_to_suppliers(spark, d))


@query("row_union", _ROWWISE.format("list_distinct(list_concat(coalesce(nodes, []), coalesce(other, [])))", "FULL"))
def _(spark, d):
    return rel.union(*_two(spark, d)).select("elem", said("nodes"))


@query("row_intersection", _ROWWISE.format("list_distinct(list_intersect(nodes, other))", ""))
def _(spark, d):
    return rel.intersection(*_two(spark, d)).select("elem", said("nodes"))


@query("row_difference", _ROWWISE.format("list_filter(nodes, lambda x: NOT list_contains(coalesce(other, []), x))", "LEFT"))
def _(spark, d):
    return rel.difference(*_two(spark, d)).select("elem", said("nodes"))


@query("row_symmetric_difference", _ROWWISE.format("list_concat(list_filter(coalesce(nodes, []), lambda x: NOT list_contains(coalesce(other, []), x)), list_filter(coalesce(other, []), lambda x: NOT list_contains(coalesce(nodes, []), x)))", "FULL"))
def _(spark, d):
    return rel.symmetric_difference(*_two(spark, d)).select("elem", said("nodes"))


@query("boolean_product", ", t AS (SELECT DISTINCT node, elem FROM s) SELECT DISTINCT a.node AS elem, b.node AS node FROM t a JOIN i b ON a.elem = b.elem")
def _(spark, d):
    turned = orders_to_suppliers(spark, d).select(F.col("node").alias("elem"), F.col("elem").alias("node"))
    return rel.product(turned, orders_to_parts(spark, d))


@query("csr_pointers", "SELECT elem, sum(len(nodes)) OVER (ORDER BY elem)::bigint - len(nodes) AS start, sum(len(nodes)) OVER (ORDER BY elem)::bigint AS stop FROM r")
def _(spark, d):
    return rel.to_csr(as_rows(orders_to_parts(spark, d)))[0]


@query("csr_round_trip", "SELECT elem, array_to_string(nodes, ',') AS nodes FROM r")
def _(spark, d):
    return rel.from_csr(*rel.to_csr(as_rows(orders_to_parts(spark, d)))).select("elem", said("nodes"))


@query("renumbered_nodes", "SELECT node AS old, row_number() OVER (ORDER BY node) - 1 AS new FROM (SELECT DISTINCT node FROM i)")
def _(spark, d):
    return rel.renumber(orders_to_parts(spark, d), "node")


@query("node_positions", "SELECT node, elem, pos, row_number() OVER (PARTITION BY node ORDER BY elem, pos) - 1 AS nth FROM p")
def _(spark, d):
    return rel.node_positions(rel.numbered(orders_to_parts(spark, d))).select("node", "elem", F.col("pos").cast("long"), F.col("nth").cast("long"))


@query("boolean_rows", "SELECT elem, array_to_string(list_transform(range((SELECT max(node) + 1 FROM s)), lambda k: CASE WHEN list_contains(nodes, k) THEN 1 ELSE 0 END), '') AS flags FROM rs")
def _(spark, d):
    pairs = orders_to_suppliers(spark, d)
    return rel.to_flags(as_rows(pairs), pairs.agg(F.max("node") + 1).first()[0])


@query("invalid_rows", "SELECT l_orderkey AS elem, 'repeated node' AS why FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT l_partkey)")
def _(spark, d):
    raw = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("elem")).agg(F.collect_list("l_partkey").alias("nodes"))
    return rel.invalid(raw).select("elem", "why")


# Questions

_PROBE = [1, 7]


@query("containing_all", "SELECT elem FROM s WHERE node IN (1, 7) GROUP BY elem HAVING count(*) = 2")
def _(spark, d):
    return q.containing_all(orders_to_suppliers(spark, d), _PROBE)


@query("containing_any", "SELECT DISTINCT elem FROM i WHERE node IN (1, 7)")
def _(spark, d):
    return q.containing_any(orders_to_parts(spark, d), _PROBE)


@query("holding_exactly", "SELECT elem FROM s GROUP BY elem HAVING count(*) = 2 AND count(*) FILTER (node IN (1, 7)) = 2")
def _(spark, d):
    return q.holding_exactly(orders_to_suppliers(spark, d), _PROBE)


@query("containing_any_but", "SELECT DISTINCT elem FROM s WHERE node IN (1, 7) AND elem NOT IN (SELECT elem FROM s WHERE node IN (2, 3))")
def _(spark, d):
    return q.containing_any_but(orders_to_suppliers(spark, d), _PROBE, [2, 3])


@query("batch_containing_all", """, pr AS (SELECT elem AS probe, node, count(*) OVER (PARTITION BY elem) AS size FROM s WHERE elem % 100 = 0)
SELECT probe, s.elem FROM pr JOIN s USING (node) GROUP BY probe, s.elem, size HAVING count(*) = size""")
def _(spark, d):
    pairs = orders_to_suppliers(spark, d)
    return q.batch_containing_all(pairs, pairs.where("elem % 100 = 0").select(F.col("elem").alias("probe"), "node"))


@query("dual_graph", "SELECT e1, e2, shared FROM dual WHERE shared >= 2")
def dual_graph(spark, d):
    return q.dual_graph(orders_to_parts(spark, d), 2)


@query("shared_with_seeds", "SELECT a.elem AS seed, b.elem AS elem, count(*) AS shared FROM i a JOIN i b ON a.node = b.node AND a.elem <> b.elem WHERE a.elem % 100 = 0 GROUP BY 1, 2")
def _(spark, d):
    pairs = orders_to_parts(spark, d)
    return q.neighbours_of(pairs, pairs.where("elem % 100 = 0").select("elem"))


@query("node_neighbours", "SELECT DISTINCT a.node AS node, b.node AS neighbour FROM s a JOIN s b ON a.elem = b.elem AND a.node <> b.node")
def _(spark, d):
    return q.node_neighbours(orders_to_suppliers(spark, d))


@query("dual_degrees", "SELECT elem, count(*) AS degree FROM (SELECT e1 AS elem FROM dual WHERE shared >= 2 UNION ALL SELECT e2 FROM dual WHERE shared >= 2) GROUP BY elem")
def _(spark, d):
    return q.degrees(q.dual_graph(orders_to_parts(spark, d), 2))


@query("degree_histogram", "SELECT degree, count(*) AS elements FROM (SELECT elem, count(*) AS degree FROM i GROUP BY elem) GROUP BY degree")
def _(spark, d):
    return q.degree_histogram(orders_to_parts(spark, d))


@query("node_valence", "SELECT node, count(*) AS elements FROM i GROUP BY node")
def _(spark, d):
    return q.node_valence(orders_to_parts(spark, d))


@query("dual_bandwidth", "SELECT max(e2 - e1) AS bandwidth, sum(e2 - e1)::bigint AS total_gap, count(*) AS edges FROM dual WHERE shared >= 2")
def _(spark, d):
    return q.bandwidth(q.dual_graph(orders_to_parts(spark, d), 2))


@query("dual_profile", "SELECT sum(e1 - least(e1, m))::bigint AS profile FROM (SELECT e1, min(e2) AS m FROM (SELECT e1, e2 FROM dual WHERE shared >= 2 UNION ALL SELECT e2, e1 FROM dual WHERE shared >= 2) GROUP BY e1)")
def _(spark, d):
    return q.profile(q.dual_graph(orders_to_parts(spark, d), 2))


# Symmetry and topology

#: Every three consecutive nodes of a row are a triangle.
_TRIPLES = """, t AS (SELECT elem * 1000 + k AS elem, [nodes[k + 1], nodes[k + 2], nodes[k]] AS nodes FROM (SELECT elem, nodes, unnest(range(1, len(nodes) - 1)) AS k FROM rs WHERE len(nodes) >= 3))"""


def _triples(spark, d):
    rows = as_rows(orders_to_suppliers(spark, d)).where("size(nodes) >= 3")
    every = rows.select("elem", F.posexplode(F.expr("transform(sequence(0, size(nodes) - 3), k -> array(nodes[k + 1], nodes[k + 2], nodes[k]))")).alias("k", "nodes"))
    return every.select((F.col("elem") * 1000 + F.col("k") + 1).alias("elem"), "nodes")


@query("canonical_cyclic", _TRIPLES + "SELECT elem, array_to_string(list_min([nodes, [nodes[2], nodes[3], nodes[1]], [nodes[3], nodes[1], nodes[2]]]), ',') AS nodes FROM t")
def _(spark, d):
    return _triples(spark, d).select("elem", symmetry.canonical("nodes", symmetry.cyclic(3)).alias("nodes")).select("elem", said("nodes"))


@query("unique_up_to_symmetry", _TRIPLES + "SELECT min(elem) AS elem, array_to_string(list_sort(nodes), ',') AS nodes FROM t GROUP BY list_sort(nodes)")
def _(spark, d):
    return symmetry.unique(_triples(spark, d), symmetry.full(3))[0].select("elem", said("nodes"))


_EDGES = _TRIPLES + """, f AS (SELECT elem, list_sort([nodes[k], nodes[k % 3 + 1]]) AS facet FROM t, range(1, 4) x(k)),
c AS (SELECT facet, count(*) AS n, min(elem) AS elem FROM f GROUP BY facet)"""


@query("sub_entities", _EDGES + "SELECT row_number() OVER (ORDER BY facet) - 1 AS sub, array_to_string(facet, ',') AS nodes FROM c")
def _(spark, d):
    return topology.sub_entities(_triples(spark, d), [(0, 1), (1, 2), (2, 0)])[0].select("sub", said("nodes"))


@query("boundary_facets", _EDGES + "SELECT array_to_string(facet, ',') AS facet, elem FROM c WHERE n = 1")
def _(spark, d):
    return topology.boundary_facets(_triples(spark, d), 2).select(said("facet"), "elem")


@query("internal_facets", _EDGES + "SELECT array_to_string(facet, ',') AS facet FROM c WHERE n = 2")
def _(spark, d):
    return topology.internal_facets(_triples(spark, d), 2).select(said("facet"))


@query("non_manifold_facets", _EDGES + "SELECT array_to_string(facet, ',') AS facet, n AS elements FROM c WHERE n > 2")
def _(spark, d):
    return topology.non_manifold_facets(_triples(spark, d), 2).select(said("facet"), "elements")


@query("boundary_nodes", _EDGES + "SELECT DISTINCT unnest(facet) AS node FROM c WHERE n = 1")
def _(spark, d):
    return topology.boundary_nodes(_triples(spark, d), 2)


def _typed(spark, d):
    """Regions, nations, customers and orders: each holds the one above."""
    link = lambda name, upper, e, n, ec, nc: table(spark, d, name).select(
        F.lit(e).alias("etype"), F.lit(n).alias("ntype"), F.col(ec).cast("long").alias("elem"), F.lit(0).alias("pos"), F.col(nc).cast("long").alias("node"))
    return link("nation", "", "nation", "region", "n_nationkey", "n_regionkey").unionAll(
        link("customer", "", "customer", "nation", "c_custkey", "c_nationkey")).unionAll(link("orders", "", "order", "customer", "o_orderkey", "o_custkey"))


_GONE = """, gone AS (SELECT 'region' AS type, 1::bigint AS id UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'customer', c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'order', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)"""


@query("erased_closure", _GONE + "SELECT DISTINCT type, id FROM gone")
def _(spark, d):
    return topology.erased(_typed(spark, d), spark.createDataFrame([("region", 1)], "type string, id long"))


@query("compressed", _GONE + """, k AS (SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_orderkey NOT IN (SELECT id FROM gone WHERE type = 'order') AND o_custkey IN (SELECT c_custkey FROM customer)),
cs AS (SELECT c_custkey AS c, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone WHERE type = 'customer'))
SELECT row_number() OVER (ORDER BY o) - 1 AS elem, n AS node FROM k JOIN cs USING (c)""")
def _(spark, d):
    out, _ = topology.compress(_typed(spark, d), spark.createDataFrame([("region", 1)], "type string, id long"))
    return out.where("etype = 'order'").select("elem", "node")


@query("extracted", """, k AS (SELECT elem, node FROM i WHERE elem IN (SELECT elem FROM i WHERE node < 100)),
es AS (SELECT elem, row_number() OVER (ORDER BY elem) - 1 AS e FROM (SELECT DISTINCT elem FROM k)), ns AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS n FROM (SELECT DISTINCT node FROM k))
SELECT e AS elem, n AS node FROM k JOIN es USING (elem) JOIN ns USING (node)""")
def _(spark, d):
    pairs = orders_to_parts(spark, d)
    return topology.extract(rel.numbered(pairs), pairs.where("node < 100").select("elem"))[0].select("elem", "node")


# Graphs


@query("components", """, e AS (SELECT e1, e2 FROM dual WHERE shared >= 2), b AS (SELECT e1, e2 FROM e UNION ALL SELECT e2, e1 FROM e),
w(id, seen) AS (SELECT DISTINCT e1, e1 FROM b UNION SELECT id, e2 FROM w JOIN b ON seen = e1)
SELECT id AS elem, min(seen) AS component FROM w GROUP BY id""")
def _(spark, d):
    return connected_components(q.dual_graph(orders_to_parts(spark, d), 2), "e1", "e2").select(F.col("node").alias("elem"), "component")


@query("k_hop", """, b AS (SELECT e1, e2 FROM dual WHERE shared >= 2 UNION ALL SELECT e2, e1 FROM dual WHERE shared >= 2),
h1 AS (SELECT DISTINCT e2 AS id FROM b WHERE e1 % 100 = 0 AND e2 % 100 <> 0), h2 AS (SELECT DISTINCT e2 AS id FROM b JOIN h1 ON e1 = id WHERE e2 % 100 <> 0 AND e2 NOT IN (SELECT id FROM h1))
SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def _(spark, d):
    pairs = orders_to_parts(spark, d)
    return graph.k_hop(pairs, pairs.where("elem % 100 = 0").select(F.col("elem").alias("id")), 2, least_shared=2)


def _network(spark, d):
    """Links of the dual graph, weighted by how few nodes are shared."""
    both = q.mirrored(cut(q.dual_graph(orders_to_parts(spark, d), 2)))
    return both.select(F.col("e1").alias("src"), F.col("e2").alias("dst"), (1.0 / F.col("shared")).alias("weight"))


@query("shortest_paths", """, b AS MATERIALIZED (SELECT e1, e2, 1.0 / shared AS w FROM dual WHERE shared >= 2 UNION ALL SELECT e2, e1, 1.0 / shared FROM dual WHERE shared >= 2),
w(id, dist) USING KEY (id) AS (SELECT min(e1), 0.0::double FROM b UNION SELECT t.e2, t.d FROM (SELECT e2, min(dist + b.w) AS d FROM w JOIN b ON id = e1 GROUP BY e2) t LEFT JOIN recurring.w AS old ON old.id = t.e2 WHERE old.id IS NULL OR t.d < old.dist - 1e-12)
SELECT id, round(dist, 6) AS dist FROM w""")
def _(spark, d):
    edges = _network(spark, d)
    start = edges.agg(F.min("src")).first()[0]
    return graph.shortest_paths(edges, start).select("id", F.round("dist", 6).alias("dist"))


@query("hop_distances", """, b AS (SELECT e1, e2 FROM dual WHERE shared >= 2 UNION ALL SELECT e2, e1 FROM dual WHERE shared >= 2),
w(id, hop) AS (SELECT min(e1), 0 FROM b UNION SELECT e2, hop + 1 FROM w JOIN b ON id = e1 WHERE hop < 60) SELECT id, min(hop) AS hop FROM w GROUP BY id""")
def _(spark, d):
    edges = _network(spark, d)
    return graph.distances(edges, edges.agg(F.min("src").alias("id")))


@query("topological_levels", """, b AS (SELECT DISTINCT n_nationkey AS x FROM nation)
SELECT 'r' || r_regionkey AS id, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer""")
def _(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    edges = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionAll(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    nodes = table(spark, d, "region").select(name("r", "r_regionkey").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    return graph.topological_levels(edges, nodes)[0]


@query("greedy_colouring", """, lows AS (SELECT greatest(e1, e2) AS id, list(least(e1, e2)) AS low FROM dual WHERE shared >= 2 GROUP BY 1),
ids AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT e1 AS id FROM dual WHERE shared >= 2 UNION SELECT e2 FROM dual WHERE shared >= 2)),
nb AS MATERIALIZED (SELECT ids.k, coalesce(list(x.k) FILTER (x.k IS NOT NULL), []) AS low FROM ids LEFT JOIN (SELECT id, unnest(low) AS other FROM lows) l USING (id) LEFT JOIN ids x ON x.id = l.other GROUP BY ids.k),
g AS (SELECT 0::bigint AS k, []::int[] AS cs
  UNION ALL SELECT g.k + 1, list_append(cs, list_min(list_filter(range(0, len(low) + 1), lambda c: NOT list_contains(list_transform(low, lambda l: cs[l]), c::int)))::int) FROM g JOIN nb ON nb.k = g.k + 1)
SELECT id, cs[k]::int AS colour FROM ids, (SELECT cs FROM g ORDER BY k DESC LIMIT 1)""")
def _(spark, d):
    edges = cut(q.dual_graph(orders_to_parts(spark, d), 2))
    nodes = q.mirrored(edges).select(F.col("e1").alias("id")).distinct()
    return graph.colouring(edges, nodes)


# Matrices


@query("matrix_cells", "SELECT i, j, v FROM m")
def _(spark, d):
    return quantities(spark, d).cells


@query("matrix_times_vector", "SELECT i, round(sum(v * (j % 10)), 6) AS v FROM m GROUP BY i")
def _(spark, d):
    m = quantities(spark, d)
    x = m.cells.select(F.col("j").alias("i")).distinct().select("i", (F.col("i") % 10).cast("double").alias("v"))
    return m.apply(x).select("i", F.round("v", 6).alias("v"))


@query("gram_matrix", "SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def _(spark, d):
    m = quantities(spark, d)
    return m.transpose().times(m).cells


@query("matrix_sum", ", k AS (SELECT l_orderkey AS i, l_suppkey AS j, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2) SELECT i, j, round(sum(v), 6) AS v FROM (SELECT * FROM m UNION ALL SELECT i, j, -0.5 * v FROM k) GROUP BY i, j")
def _(spark, d):
    m = quantities(spark, d)
    other = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_discount").alias("v"))
    return m.add(sparse.from_cells(other, m.rows, m.columns), -0.5).cells.withColumn("v", F.round("v", 6))


@query("matrix_hadamard", "SELECT i, j, m.v * k.v AS v FROM m JOIN (SELECT * FROM m WHERE v > 20) k USING (i, j)")
def _(spark, d):
    m = quantities(spark, d)
    return m.hadamard(sparse.Matrix(m.cells.where("v > 20"), m.rows, m.columns)).cells


@query("matrix_summary", """SELECT count(*) AS cells, coalesce(sum(v) FILTER (i = j), 0) AS trace, sum(v) AS total, round(sqrt(sum(v * v)), 6) AS norm_frobenius, max(abs(v)) AS norm_max,
(SELECT max(t) FROM (SELECT sum(abs(v)) AS t FROM m GROUP BY i)) AS norm_inf, (SELECT max(t) FROM (SELECT sum(abs(v)) AS t FROM m GROUP BY j)) AS norm_one FROM m""")
def _(spark, d):
    return quantities(spark, d).summary().withColumn("norm_frobenius", F.round("norm_frobenius", 6))


@query("matrix_triangle", "SELECT i, j, v FROM m WHERE i > j")
def _(spark, d):
    return quantities(spark, d).triangle(upper=False, strict=True).cells


@query("matrix_kronecker", ", t(a, b, w) AS (VALUES (0, 0, 2.0), (1, 0, -1.0)) SELECT i * 2 + a AS i, j * 2 + b AS j, (v * w)::double AS v FROM m, t")
def _(spark, d):
    m = quantities(spark, d)
    small = sparse.Matrix(spark.createDataFrame([(0, 0, 2.0), (1, 0, -1.0)], "i long, j long, v double"), 2, 2)
    return m.kronecker(small).cells


@query("assembled_system", """SELECT a.node AS i, b.node AS j, sum(CASE WHEN a.node = b.node THEN 2.0 ELSE -1.0 END)::double AS v FROM s a JOIN s b ON a.elem = b.elem GROUP BY 1, 2""")
def _(spark, d):
    conn = rel.numbered(orders_to_suppliers(spark, d)).select("elem", F.col("pos").alias("li"), F.col("node").alias("dof"))
    k = conn.select("elem", "li").join(conn.select("elem", F.col("li").alias("lj")), "elem").withColumn("v", F.when(F.col("li") == F.col("lj"), 2.0).otherwise(-1.0))
    return sparse.assemble(conn, k)[0]


@query("sparse_solve", "SELECT DISTINCT node AS i, true AS solved FROM s")
def _(spark, d):
    conn = rel.numbered(orders_to_suppliers(spark, d)).select("elem", F.col("pos").alias("li"), F.col("node").alias("dof"))
    k = conn.select("elem", "li").join(conn.select("elem", F.col("li").alias("lj")), "elem").withColumn("v", F.when(F.col("li") == F.col("lj"), 20.0).otherwise(-1.0))
    cells, load = sparse.assemble(conn, k, conn.select("elem", "li", F.lit(1.0).alias("v")))
    cells, load = cut(cells), cut(load)  # both are read several times
    n = load.agg(F.max("i") + 1).first()[0]
    system = sparse.Matrix(cells, n, n)
    # The product with the solution is the load again.
    left = system.apply(sparse.solve(system, load)).join(load.select("i", F.col("v").alias("b")), "i")
    return left.select("i", (F.abs(F.col("v") - F.col("b")) <= 1e-6 * F.col("b")).alias("solved"))


# Vectors

_COMPONENTS = "x AS (SELECT vec_id, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS k FROM embeddings)"


@query("covariance", f"WITH {_COMPONENTS} SELECT a.k AS i, b.k AS j, round(covar_samp(a.v, b.v), 8) AS v FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2", shared=False)
def _(spark, d):
    return dense.covariance(table(spark, d, "embeddings"), "embedding").select("i", "j", F.round("v", 8).alias("v"))


@query("correlation", f"WITH {_COMPONENTS} SELECT a.k AS i, b.k AS j, round(corr(a.v, b.v), 8) AS v FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2", shared=False)
def _(spark, d):
    return dense.correlation(table(spark, d, "embeddings"), "embedding").select("i", "j", F.round("v", 8).alias("v"))


@query("vector_norms", f"WITH {_COMPONENTS} SELECT vec_id, round(sqrt(sum(v * v)), 6) AS norm FROM x GROUP BY 1", shared=False)
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(dense.norm("embedding"), 6).alias("norm"))


@query("principal_projections")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    _, axes = dense.principal_axes(rows, 2, "embedding")
    axes = axes * np.where(axes[np.abs(axes).argmax(0), [0, 1]] < 0, -1, 1)
    return dense.transformed(rows, axes, "embedding").select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[1], 6).alias("second"))


# Geometry and meshes: part sizes and prices serve as coordinates.


def _corner(k: int) -> g.Point:
    key = F.col("l_partkey")
    return g.Point((key * (k + 3) % 17).cast("double"), (key * (2 * k + 5) % 19).cast("double"), F.lit(0.0))


@query("triangle_measures", """SELECT l_partkey, round(abs(j) / 2, 6) AS area, round(CASE WHEN j = 0 THEN -1 ELSE greatest(ab, bc, ca) * (ab + bc + ca) / (2 * abs(j)) END, 6) AS aspect FROM (
SELECT *, sqrt((bx - ax)^2 + (by_ - ay)^2) AS ab, sqrt((cx - bx)^2 + (cy - by_)^2) AS bc, sqrt((ax - cx)^2 + (ay - cy)^2) AS ca, ((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay))::double AS j FROM (
SELECT DISTINCT l_partkey, l_partkey * 3 % 17 AS ax, l_partkey * 5 % 19 AS ay, l_partkey * 4 % 17 AS bx, l_partkey * 7 % 19 AS by_, l_partkey * 5 % 17 AS cx, l_partkey * 9 % 19 AS cy FROM lineitem))""", shared=False)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey").distinct()
    a, b, c = (_corner(k) for k in range(3))
    aspect = g.triangle_aspect(a, b, c)
    return rows.select("l_partkey", F.round(g.triangle_area(a, b, c), 6).alias("area"), F.round(F.when(aspect == g.INFINITY, -1.0).otherwise(aspect), 6).alias("aspect"))


@query("segment_crossings", """SELECT l_partkey, coalesce(t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1, false) AS meets FROM (SELECT l_partkey,
CASE WHEN w <> 0 THEN ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / w::double END AS t, CASE WHEN w <> 0 THEN ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / w::double END AS u FROM (
SELECT *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS w FROM (
SELECT DISTINCT l_partkey, l_partkey * 3 % 17 AS ax, l_partkey * 5 % 19 AS ay, l_partkey * 4 % 17 AS bx, l_partkey * 7 % 19 AS by_, l_partkey * 5 % 17 AS cx, l_partkey * 9 % 19 AS cy, l_partkey * 6 % 17 AS dx, l_partkey * 11 % 19 AS dy FROM lineitem)))""", shared=False)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey").distinct()
    return rows.select("l_partkey", g.segments_meet(*(_corner(k) for k in range(4)))[0].alias("meets"))


@query("polygon_areas", """, o AS (SELECT elem, pos, (node % 101)::double AS x, (node % 103)::double AS y FROM p),
n AS (SELECT elem, x, y, coalesce(lead(x) OVER w, first(x) OVER w2) AS bx, coalesce(lead(y) OVER w, first(y) OVER w2) AS by_ FROM o WINDOW w AS (PARTITION BY elem ORDER BY pos), w2 AS (PARTITION BY elem ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT elem AS loop, sum(x * by_ - bx * y) / 2 AS area FROM n GROUP BY elem""")
def _(spark, d):
    loops = rel.numbered(orders_to_parts(spark, d)).select(F.col("elem").alias("loop"), F.col("pos").alias("seq"), (F.col("node") % 101).cast("double").alias("x"), (F.col("node") % 103).cast("double").alias("y"))
    return mesh.signed_area(loops)


@query("points_in_polygons", """, o AS (SELECT elem, pos, (node * 37 % 101)::double AS x, (node * 53 % 103)::double AS y FROM (SELECT elem, node, row_number() OVER (PARTITION BY elem ORDER BY node) - 1 AS pos FROM s)),
n AS (SELECT elem, x, y, coalesce(lead(x) OVER w, first(x) OVER w2) AS bx, coalesce(lead(y) OVER w, first(y) OVER w2) AS by_ FROM o WINDOW w AS (PARTITION BY elem ORDER BY pos), w2 AS (PARTITION BY elem ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT p_partkey AS point, (p_partkey * 7 % 101)::double AS px, (p_partkey * 11 % 103)::double AS py FROM part)
SELECT point, elem AS loop FROM q JOIN n ON (y > py) <> (by_ > py) AND px < (bx - x) * (py - y) / (by_ - y) + x GROUP BY point, elem HAVING count(*) % 2 = 1""")
def _(spark, d):
    points = table(spark, d, "part").select(F.col("p_partkey").alias("point"), (F.col("p_partkey") * 7 % 101).cast("double").alias("x"), (F.col("p_partkey") * 11 % 103).cast("double").alias("y"))
    loops = rel.numbered(orders_to_suppliers(spark, d)).select(F.col("elem").alias("loop"), F.col("pos").alias("seq"), (F.col("node") * 37 % 101).cast("double").alias("x"), (F.col("node") * 53 % 103).cast("double").alias("y"))
    return mesh.points_in_polygons(points, loops)


@query("scalar_roots", "SELECT p_partkey, round(sqrt(p_size), 6) AS root FROM part", shared=False)
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.lit(0.0).alias("low"), F.lit(60.0).alias("high"))
    return solvers.roots(rows, lambda x: x * x - F.col("p_size")).select("p_partkey", F.round("root", 6).alias("root"))


from trellis import catalog_meshes, catalog_more, catalog_stores  # noqa: E402, F401  (register the rest)
