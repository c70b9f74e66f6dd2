"""Near copies against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trellis.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(texts, width=5):
    def grams(t):
        w = [x.lower() for x in (t or "").split()]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [i for i in range(len(texts)) if find(i) == i]


def edited(r, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"e{r.random()}"
    return " ".join(w)


def corpus(hot_copies=60, boilers=30, families=12):
    r = random.Random(8)
    fresh = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    bases = [fresh(r.randrange(60, 200)) for _ in range(families)]
    texts = [edited(r, b, n) for b in bases for n in (0, 1, 1, 2, 3, 4, 6)]
    hot = fresh(150)
    texts += [edited(r, hot, r.randrange(1, 5)) for _ in range(hot_copies)]  # a large group, many pairs of which are below the limit
    boiler = fresh(40)
    texts += [boiler + " " + fresh(20) for _ in range(boilers)] + [fresh(12) for _ in range(20)]
    r.shuffle(texts)
    return [*texts, texts[0], texts[0].upper(), None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("sizes, how", [((), {}), ((), {"few_pairs": 0, "rounds": 2}), ((), {"few_pairs": 0, "sample": 1, "rounds": 1}), ((4, 0, 1), {"max_broadcast": 0, "sample": 1, "few_pairs": 0})])
def test_kept_documents_by_brute_force(spark, sizes, how):
    texts = corpus(*sizes)
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).withColumn("component", F.lit("clash"))
    kept = neardup.keep_one(rows, **how)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(texts)
    assert neardup.keep_one(rows.limit(0)).count() == 0


def test_stage_takes_edited_copies(spark):
    r = random.Random(1)
    text = " ".join(f"w{r.randrange(3000)}" for _ in range(150))
    texts = [text, *(edited(r, text, 2) for _ in range(10)), edited(r, text, 40)]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [0, 11]


def test_sketches_never_tell_more_than_differs():
    import numpy as np

    r = np.random.default_rng(7)
    for n, m, shared in ((1, 1, 0), (1, 1, 1), (3, 900, 2), (500, 620, 480), (4000, 4100, 3700), (200, 5000, 0)):
        both, one, two = (r.integers(-(2**63), 2**63 - 1, k) for k in (shared, n - shared, m - shared))
        x, y = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
        apart = neardup.differing(neardup.sketch(x), neardup.sketch(y))
        assert apart <= len(np.setxor1d(x, y)) and (apart - len(np.setxor1d(x, y))) % 2 == 0
        assert neardup.differing(neardup.sketch(x), neardup.sketch(x)) == 0
    # Long texts without a common shingle are told apart, which a map of 256 bits cannot do.
    x, y = (r.integers(-(2**63), 2**63 - 1, 4000) for _ in range(2))
    assert (8000 - neardup.differing(neardup.sketch(x), neardup.sketch(y))) * 9 < 8000 * 8
