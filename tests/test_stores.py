"""Stored relations by versions, canonical indices, typed paths and signatures."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis import catalog
from trellis.operators import graph, relation, symmetry
from trellis.sources.store import CanonicalIndex, refresh_transpose, relation_store

SF = "/root/testdata/sf0.001"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "elem long, node long")


def held(frame):
    return sorted(map(tuple, frame.collect()))


def test_a_batch_touches_its_own_buckets_alone(spark, tmp_path):
    store = relation_store(spark, str(tmp_path / "s"), buckets=8)
    assert store.read().collect() == [] and store.version().number == -1
    first = store.apply(pairs(spark, [(e, n) for e in range(40) for n in range(3)]), batch=("w", 0))
    second = store.apply(pairs(spark, [(7, 1), (7, 9), (7, 9)]), batch=("w", 1))
    moved = [b for b in first.buckets if first.buckets[b] != second.buckets[b]]
    assert len(first.buckets) == 8 and len(moved) == 1
    # The rest of the rows lies in files that the second batch neither read nor wrote.
    assert set(store.read().where("elem <> 7").select(F.col("elem")).distinct().toPandas()["elem"]) == set(range(40)) - {7}
    assert store._read(second, moved).inputFiles() != store._read(first, moved).inputFiles()
    assert held(store.read().where("elem = 7")) == [(7, 0), (7, 1), (7, 2), (7, 9)]
    assert store.apply(pairs(spark, [(8, 100)]), batch=("w", 1)).number == second.number and store.read().where("node = 100").count() == 0  # replayed
    assert store.apply(pairs(spark, [(7, 9)])).number == second.number  # nothing new
    assert held(store.read(0)) == [(e, n) for e in range(40) for n in range(3)]
    third = store.apply(pairs(spark, [(50, 1)]), pairs(spark, [(7, n) for n in range(10)] + [(99, 1)]))
    assert store.read().where("elem = 7").count() == 0 and store.read().count() == 39 * 3 + 1 and third.number == 2
    added, removed = store.changes(1, 2)
    assert held(added) == [(50, 1)] and held(removed) == [(7, 0), (7, 1), (7, 2), (7, 9)]
    assert store.vacuum(1) == [0, 1] and store.numbers() == [2] and store.read().count() == 39 * 3 + 1
    with pytest.raises(ValueError, match="no version 0"):
        store.read(0)
    with pytest.raises(Exception, match="a null node"):
        store.apply(pairs(spark, [(1, None)]))


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    store = relation_store(spark, str(tmp_path / "s"), buckets=2)
    made = store.apply(pairs(spark, [(1, 1)]))
    with pytest.raises(Exception, match="exist"):
        store._publish(made)


def test_transposes_follow_by_bucket(spark, tmp_path):
    store, back = relation_store(spark, str(tmp_path / "s"), 8), relation_store(spark, str(tmp_path / "t"), 8, by="node")
    store.apply(pairs(spark, [(e, n) for e in range(9) for n in range(30)]))
    before = refresh_transpose(store, back)
    assert refresh_transpose(store, back).number == before.number
    store.apply(pairs(spark, [(100, 3)]), pairs(spark, [(4, 3)]))
    after = refresh_transpose(store, back)
    assert sum(before.buckets[b] != after.buckets[b] for b in before.buckets) == 1
    assert held(back.read()) == held(store.read()) and held(back.read().where("node = 3")) == [(e, 3) for e in (0, 1, 2, 3, 5, 6, 7, 8, 100)]


def test_a_second_batch_adds_only_unseen_classes(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "elem long, nodes array<long>")
    index = CanonicalIndex(spark, str(tmp_path / "i"), symmetry.cyclic(3), 4)
    assert held(index.add(rows([(5, [1, 2, 3]), (4, [2, 3, 1]), (6, [3, 2, 1])]))) == [(4, 4), (5, 4), (6, 6)]
    assert held(index.find(rows([(0, [3, 1, 2]), (1, [7, 8, 9])]))) == [(0, 4), (1, None)]
    assert held(index.add(rows([(1, [3, 1, 2]), (2, [9, 7, 8])]))) == [(1, 4), (2, 2)]
    assert index.store.read().count() == 3


# Paths over types


def slow_paths(edges, sources):
    out, heap = {}, [(0.0, s) for s in sources]
    while heap:
        dist, at = heapq.heappop(heap)
        if at in out:
            continue
        out[at] = dist
        for (a, b), w in edges.items():
            if a == at and b not in out:
                heapq.heappush(heap, (dist + w, b))
    return out


@pytest.mark.parametrize("width", [None, 1.0, 50.0])
def test_typed_paths_are_those_of_brute_force(spark, width):
    rng = random.Random(3)
    ids = [(t, i) for t in ("a", "b") for i in range(15)]
    edges = {(rng.choice(ids), rng.choice(ids)): float(rng.choice([0, 1, 2, 3, 7, 20])) for _ in range(70)}
    table = spark.createDataFrame([(*s, *d, w) for (s, d), w in edges.items()], "src_type string, src long, dst_type string, dst long, weight double")
    sources = [("a", 0), ("b", 3)]
    got = graph.typed_shortest_paths(table, spark.createDataFrame([*sources, ("a", 0)], "type string, id long"), width).collect()
    want = slow_paths(edges, sources)
    assert {(r.type, r.id): r.dist for r in got} == want and len(got) == len(want)  # each is settled once
    tree = {(r.type, r.id): (r.pred_type, r.pred) for r in got}
    for at, up in tree.items():
        if at in sources:
            assert up == (None, None)
            continue
        assert want[up] + edges[up, at] == want[at]
        tight = [a for (a, b), w in edges.items() if b == at and a in want and want[a] + w == want[at]]
        assert up == min([a for a in tight if edges[a, at] > 0] or [up])
        steps, here = 0, at
        while here not in sources:  # ways end at a source
            here, steps = tree[here], steps + 1
            assert steps < 100


def test_typed_paths_at_the_edges(spark):
    shape = "src_type string, src long, dst_type string, dst long, weight double"
    start = spark.createDataFrame([("a", 0)], "type string, id long")
    assert held(graph.typed_shortest_paths(spark.createDataFrame([], shape), start)) == [("a", 0, 0.0, None, None)]
    assert held(graph.typed_shortest_paths(spark.createDataFrame([], shape), start.limit(0))) == []
    for w in (-1.0, None):
        with pytest.raises(Exception, match="no way over a weight of"):
            graph.typed_shortest_paths(spark.createDataFrame([("a", 0, "a", 1, w)], shape), start).collect()


def test_signatures(spark):
    shape = "etype string, elem long, ntype string, node long"
    rows = [("e", 1, "n", 1), ("e", 1, "m", 1), ("e", 2, "m", 1), ("e", 2, "n", 1), ("e", 2, "n", 1), ("e", 3, "n", 1), ("f", 0, "n", 1), ("f", 0, "m", 1)]
    typed = spark.createDataFrame(rows, shape)
    assert held(relation.composite_duplicates(typed)) == [("e", 2, 1)]
    assert held(relation.relation_signature(typed.limit(0))) == [(0, 0, 0)]
    whole, some = relation.relation_signature(typed), relation.relation_signature(typed.where("elem <> 3"))
    assert held(relation.changed_signature(some, typed.where("elem = 3"), typed.limit(0))) == held(whole)
    assert held(relation.changed_signature(whole, typed.limit(0), typed.where("elem = 3"))) == held(some) != held(whole)
    assert held(relation.relation_signature(typed.orderBy(F.desc("node"), "etype"))) == held(whole)


def test_eigenpairs_of_the_query(spark):
    got = catalog.QUERIES["smallest_eigenpairs"](spark, SF).orderBy("nth").collect()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().toPandas()
    ground = spark.read.parquet(f"{SF}/supplier.parquet").toPandas().set_index("s_suppkey")["s_acctbal"].astype(float)
    keys = sorted(ground.index)
    x = np.zeros((len(keys), len(keys)))
    for _, own in lines.groupby("l_orderkey")["l_suppkey"]:
        for a in own:
            for b in own:
                x[keys.index(a), keys.index(b)] -= a != b
    x -= np.diag(x.sum(axis=1) - 1 - np.abs(ground[keys].to_numpy()) / 100)
    assert np.allclose([r.value for r in got], np.linalg.eigvalsh(x)[:5], rtol=1e-8) and [r.nth for r in got] == [1, 2, 3, 4, 5]


def test_a_batch_meets_its_buckets_once(spark, tmp_path):
    """Removed, kept and added rows of a key meet in one grouping; both sides of changes in another."""
    store = relation_store(spark, str(tmp_path / "met"), 2, schema="elem long, node long, w long")
    table = lambda *rows: spark.createDataFrame(list(rows), "elem long, node long, w long")
    keys = lambda *rows: spark.createDataFrame(list(rows), "elem long, node long")
    first = store.apply(table((1, 1, 5), (1, 1, 4), (2, 2, None), (3, 3, 3))).number
    assert sorted(map(tuple, store.read().na.fill(-1).collect())) == [(1, 1, 4), (2, 2, -1), (3, 3, 3)]
    second = store.apply(table((1, 1, 1), (2, 2, 7), (4, 4, 4)), keys((2, 2), (3, 3), (9, 9))).number
    assert sorted(map(tuple, store.read().collect())) == [(1, 1, 4), (2, 2, 7), (4, 4, 4)]
    added, removed = store.changes(first, second)
    assert sorted(map(tuple, added.collect())) == [(2, 2, 7), (4, 4, 4)]
    assert sorted(map(tuple, removed.na.fill(-1).collect())) == [(2, 2, -1), (3, 3, 3)]
    for df in (added, removed):  # written once, not made twice
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
