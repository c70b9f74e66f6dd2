"""What is written besides results is deleted as soon as nothing will read it, and little is sent."""

import time

from pyspark.sql import functions as F

from trellis import catalog
from trellis.operators import cells, relation as rel
from trellis.plans.lineage import _CLEANUP, Pile, cut


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    numbers = spark.range(1000).withColumn("k", F.col("id") % 7)
    before, kept = _shuffle_files(spark), spark.conf.get(_CLEANUP, None)
    made = cut(numbers.groupBy("k").agg(F.count("*").alias("n")).join(numbers.hint("merge"), "k"))
    pile = Pile(numbers.groupBy("k").agg(F.max("id").alias("m")))
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert made.count() == 1000 and pile.all().count() == 7 and spark.conf.get(_CLEANUP, None) == kept


def test_flags_by_runs(spark):
    some = [(0, [0, 1, 2, 7]), (1, []), (2, [9]), (3, [5, 3, 3, 4, -1, 12]), (4, list(range(10))), (5, [0, 9]), (6, [8, 9])]
    rows = spark.createDataFrame(some, "elem long, nodes array<long>")
    runs = {r.elem: r.runs for r in rel.to_runs(rows, 10).collect()}
    flags = {r.elem: r.flags for r in rel.to_flags(rows, 10).collect()}
    assert {e: "".join("01"[k % 2] * n for k, n in enumerate(found)) for e, found in runs.items()} == flags
    back = {r.elem: r.nodes for r in rel.from_runs(rel.to_runs(rows, 10)).collect()}
    assert back == {e: sorted({n for n in nodes if 0 <= n < 10}) for e, nodes in some}
    # As texts these would be 2 GB a row.
    wide = spark.createDataFrame([(0, [1, 2_000_000_000])], "elem long, nodes array<long>")
    assert rel.from_runs(rel.to_runs(wide, 2_000_000_001)).first().nodes == [1, 2_000_000_000]
    assert rel.to_runs(wide, 1 << 40).first().runs == [1, 1, 1_999_999_998, 1, (1 << 40) - 2_000_000_001]


def test_clique_indices_send_each_place_once(spark):
    rows = spark.createDataFrame([(e, [0, *((e * k) % 37 + 1 for k in range(1, 6))]) for e in range(60)] + [(60, [5, None, 7])], "elem long, nodes array<long>")
    every = rel.incidences(rows)
    slots, meetings, by = {}, {}, {}
    for r in every.collect():
        if r.node is not None:
            by.setdefault(r.elem, []).append((r.pos, r.node))
    for e in sorted(by):
        for i, n1 in sorted(by[e]):
            for j, n2 in sorted(by[e]):
                met = meetings.setdefault(n1, {})
                slots[e, i, j] = met.setdefault(n2, len(met))
    few, hot = rel.clique_indices(every), rel.clique_indices(every, together=10)
    for found in (few, hot):
        assert {(r.elem, r.i, r.j): r.slot for r in found.collect()} == slots
        assert found.count() == len(slots)
    plan = rel.clique_indices(every)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join " in line]


def test_boxes_are_sent_to_eight_cells_at_most(spark, monkeypatch):
    sent, spread = [], cells._spread
    monkeypatch.setattr(cells, "_spread", lambda kept: sent.append(spread(kept)) or sent[-1])
    corners = [(b, *(float(b * k % 50 - 20) + 0.25 * (b % 3) for k in (7, 11, 13)), float(b % 17)) for b in range(200)]
    boxes = spark.createDataFrame([(b, x, y, z, x + s, y + s / 2, z + s) for b, x, y, z, s in corners], "box long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    spots = [(p, float(p * 3 % 60 - 20), float(p * 7 % 60 - 20), float(p * 11 % 60 - 20)) for p in range(300)]
    found = cells.points_in_boxes(spark.createDataFrame(spots, "point long, x double, y double, z double"), boxes).collect()
    want = {(p, b) for p, x, y, z in spots for b, a, c, e, s in corners if a <= x <= a + s and c <= y <= c + s / 2 and e <= z <= e + s}
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 0
    assert sent[0].groupBy("box").count().agg(F.max("count")).first()[0] <= 8


def test_refined_boundary_is_known_by_parent_without_a_join(spark):
    plan = catalog.QUERIES["refined_boundary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Join " not in plan.split("Union")[0]
