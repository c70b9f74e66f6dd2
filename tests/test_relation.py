import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.operators import query as q
from trellis.operators import relation as rel


def frame(spark, rows):
    return spark.createDataFrame([(i, list(r)) for i, r in rows.items()], "elem long, nodes array<long>")


def read(df):
    return {r[0]: list(r[1]) for r in df.collect()}


def test_transpose_gaps_negatives_and_repeats(spark):
    out = rel.transpose(rel.incidences(frame(spark, {0: [0, 3], 1: [3]})))
    assert read(rel.with_gaps(out, 4, "node", "elems")) == {0: [0], 1: [], 2: [], 3: [0, 1]}
    assert read(rel.transpose(rel.incidences(frame(spark, {0: [-1, 2]})))) == {2: [0]}
    assert read(rel.transpose(rel.incidences(frame(spark, {0: [2, 2]})))) == {2: [0]}
    with pytest.raises(Exception, match="negative node"):
        rel.transpose(rel.incidences(frame(spark, {0: [-1, 2]})), strict=True).collect()


def test_shortlex_and_duplicates(spark):
    out = rel.shortlex(frame(spark, {0: [5], 1: [1, 2], 2: [0, 9], 3: [3]}))
    assert [r.elem for r in out.collect()] == [3, 0, 2, 1]
    assert rel.duplicates(frame(spark, {0: [1, 2], 1: [2, 1], 2: [1, 2]})).collect() == [(2, 0)]


def test_row_wise_sets(spark):
    left, right = frame(spark, {0: [1, 2], 1: [3]}), frame(spark, {0: [2, 4]})
    assert read(rel.union(left, right)) == {0: [1, 2, 4], 1: [3]}
    assert read(rel.intersection(left, right)) == {0: [2]}
    assert read(rel.difference(left, right)) == {0: [1], 1: [3]}
    assert read(rel.symmetric_difference(left, right)) == {0: [1, 4], 1: [3]}


relations = st.dictionaries(st.integers(0, 5), st.lists(st.integers(0, 6), max_size=4), min_size=1, max_size=5)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(relations, relations)
def test_symmetric_difference_is_union_without_intersection(spark, a, b):
    left, right = (frame(spark, {k: sorted(set(v)) for k, v in x.items()}) for x in (a, b))
    got = read(rel.symmetric_difference(left, right))
    assert got == {k: sorted(set(a.get(k, [])) ^ set(b.get(k, []))) for k in {*a, *b}}


def test_csr_round_trip_and_boolean(spark):
    rows = frame(spark, {0: [4, 1], 1: [], 2: [7]})
    pointers, cells = rel.to_csr(rows)
    assert sorted(map(tuple, pointers.collect())) == [(0, 0, 2), (1, 2, 2), (2, 2, 3)]
    assert read(rel.from_csr(pointers, cells)) == {0: [4, 1], 1: [], 2: [7]}
    assert read(rel.from_boolean(rel.to_boolean(rows, 8))) == {0: [1, 4], 1: [], 2: [7]}


def test_validity_numbers_and_permutation(spark):
    assert rel.invalid(frame(spark, {0: [2, 2], 1: [1, 2], 2: [-1]})).select("elem", "why").orderBy("elem").collect() == [(0, "repeated node"), (2, "negative node")]
    assert sorted(map(tuple, rel.renumber(spark.createDataFrame([(30,), (10,), (10,), (None,)], "x long"), "x").collect())) == [(10, 0), (30, 1)]
    moved = rel.permute_nodes(frame(spark, {0: [1, 2]}), spark.createDataFrame([(1, 2), (2, 1)], "node long, to long"))
    assert read(moved) == {0: [2, 1]}
    stats = rel.statistics(spark.createDataFrame([], "elem long, nodes array<long>")).first()
    assert (stats.elements, stats.incidences, stats.max_degree, stats.max_node) == (0, 0, 0, -1)


def test_division(spark):
    pairs = rel.pairs(rel.incidences(frame(spark, {0: [1, 2, 3], 1: [1, 2], 2: [2]})))
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(q.containing_all(pairs, [1, 2])) == [0, 1]
    assert ids(q.holding_exactly(pairs, [1, 2])) == [1]
    assert ids(q.containing_any(pairs, [1, 2])) == [0, 1, 2]
    assert ids(q.containing_any_but(pairs, [2], [3])) == [1, 2]
    assert ids(q.containing_all(pairs, [])) == [] and ids(q.containing_all(pairs, [99])) == []


def test_shared_counts_and_products(spark):
    pairs = rel.pairs(rel.incidences(frame(spark, {0: [0, 1, 2], 1: [1, 3, 2]})))
    assert q.shared_counts(pairs).collect() == [(0, 1, 2)]
    assert sorted(map(tuple, q.neighbours(pairs).collect())) == [(0, 1), (1, 0)]
    turned = pairs.select(F.col("node").alias("elem"), F.col("elem").alias("node"))
    assert sorted(map(tuple, rel.product(pairs, turned).collect())) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_cliques_lookups_and_find(spark):
    from trellis.operators import symmetry

    rows = frame(spark, {0: [5, 6], 1: [6, 7]})
    got = {tuple(r)[:3]: r.slot for r in rel.clique_indices(rel.incidences(rows)).collect()}
    assert got == {(0, 0, 0): 0, (0, 0, 1): 1, (0, 1, 0): 0, (0, 1, 1): 1, (1, 0, 0): 1, (1, 0, 1): 2, (1, 1, 0): 0, (1, 1, 1): 1}
    assert read(rel.nodes_of(rows, spark.createDataFrame([(1,), (9,)], "elem long"))) == {1: [6, 7]}
    assert sorted(map(tuple, rel.elements_at(rel.pairs(rel.incidences(rows)), spark.createDataFrame([(6,)], "node long")).collect())) == [(6, 0), (6, 1)]
    assert rel.dangling(rel.incidences(rows), spark.createDataFrame([(5,), (6,)], "node long")).collect() == [(1, 1, 7)]
    probes = spark.createDataFrame([(0, [6, 5]), (1, [5, 7])], "probe long, nodes array<long>")
    assert dict(map(tuple, symmetry.find(rows, probes, symmetry.full(2)).collect())) == {0: 0, 1: None}


def test_rows_as_flags_of_text(spark):
    rows = spark.createDataFrame([(0, [4, 1, 1]), (1, []), (2, [7]), (3, [0, 1, 2, 3, 4, 5, 6, 7]), (4, [0, 9, -2])], "elem long, nodes array<long>")
    flags = rel.to_flags(rows, 8)
    assert {r.elem: r.flags for r in flags.collect()} == {0: "01001000", 1: "00000000", 2: "00000001", 3: "11111111", 4: "10000000"}
    assert read(rel.from_flags(flags)) == {0: [1, 4], 1: [], 2: [7], 3: list(range(8)), 4: [0]}
    wide = 40_000  # a step of a plan for each flag would take minutes here
    many = spark.range(20_000).select(F.col("id").alias("elem"), F.array(F.col("id"), F.col("id") + 19_999).alias("nodes"))
    assert rel.from_flags(rel.to_flags(many, wide)).exceptAll(many).isEmpty()


@pytest.mark.parametrize("carried", [0, 2, 64])
def test_product_makes_each_pair_once(spark, carried):
    """Whatever travels with the pairs; repeated pairs and null nodes change nothing."""
    import random

    rng = random.Random(carried)
    a = [(rng.randrange(12), rng.randrange(9)) for _ in range(50)] + [(1, 1), (1, 1), (20, None), (21, 77)]
    b = [(rng.randrange(9), rng.randrange(15)) for _ in range(50)] + [(1, 3), (1, 3), (None, 4), (78, 5)]
    schema = "elem long, node long"
    made = [tuple(r) for r in rel.product(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), carried).collect()]
    assert len(made) == len(set(made)) and set(made) == {(e, n) for e, v in a for w, n in b if v == w and v is not None}
