"""Cases that once gave wrong rows, and columns of any name."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trellis.llm import decontamination, licenses, linededup, packing, quality, secrets, simhash, urlfilter
from trellis.plans.lineage import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["of", "of_gone", "of_first", "starts", "lines", "nth", "left_lines", "low_words", "word_line", "keywords_met", "all_found", "hit_text", "hit_places", "hit_words",
         "hit_left", "hit_gaps", "w", "t", "th", "u", "h", "p", "pos", "at", "blob", "low", "spans", "of_url", "best_rule", "of_page", "__low", "__w", "__at", "__words", "__h", "__row", "Of", "a.b"]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(range(len(texts)) if ids is None else ids, texts)], SCHEMA)


def named(df):
    for c in NAMES:
        if c.lower() not in {x.lower() for x in df.columns}:
            df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def untouched(before, after):
    row = after.first()
    return all(row[c] == f"own {c}" for c in before.columns if c in NAMES and c in after.columns)


def test_tokens_of_odd_strings():
    from tokenizers import Tokenizer

    r = random.Random(11)
    encode, plain = packing.Encoder(packing.tokenizer_path(), room=20_000), Tokenizer.from_file(packing.tokenizer_path())
    pool = [*"abIiSsKkéÉßİıΣσςΔάΆ.,'\"!?-–…0123٣½ \n\t 　̧́̇ͅक़क़漢字ªºǅǆﬁＡ㌀ſK🙂‍<|>", "<|endoftext|>", "'s", "'ll", "..."]
    odd = [c for c in map(chr, range(0x80, 0x3000)) if c.isprintable()]
    for _ in range(25):
        texts = ["".join(r.choice(pool) if r.random() < 0.8 else r.choice(odd) for _ in range(r.randrange(0, 9))) for _ in range(1000)]
        texts += [r.choice(odd) + r.choice(odd) * r.randrange(2) + r.choice(".,") for _ in range(1000)] + ["İ.", "İ,", "aİ."]
        ids, at = encode(pa.array(texts))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("bound", [1000, 0])
def test_only_a_to_z_are_lower_cased(spark, bound):
    tail = " ".join(f"w{i}" for i in range(12))
    items = [(1, "ΑΒΣ ΓΔ " + " ".join(f"w{i}" for i in range(8))), (2, "İST I İI"), (3, "Σ")]
    texts = ["ΑΒΣ.ΓΔ " + tail, "ΑΒΣ'ΓΔ:" + tail, "αβς γδ " + tail, "x İst. i: İI", "x i̇st i İI", "σ ς", "a Σ"]
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.scan(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), max_broadcast=bound).collect()}
    for i, t in enumerate(texts):
        w, hit, met = words(t), set(), []
        for item, text in items:
            v = words(text)
            places = [k for k in range(len(w) - len(v) + 1) if w[k : k + len(v)] == v]
            hit.update(k + j for k in places for j in range(len(v)))
            met += [str(item)] * bool(places)
        assert got[i] == (len(hit), sorted(met))


def test_a_ledger_that_repeats_blobs(spark):
    rows = docs(spark, ["token = abcdefgh12", "nothing", "token = abcdefgh12"])
    once, ledger = secrets.scan(rows)
    ledger = cut(ledger.unionByName(ledger))
    again, gained = secrets.scan(rows, ledger)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect())) and gained.count() == 0


def test_names_do_not_clash(spark):
    shared = "\n".join(f"shared line {i}" for i in range(5))
    rows = named(docs(spark, ["licensed under the MIT license b0 b1 b2 b3 b4 b5 b6 b7 b8 b9 b10", shared, shared, None, "plain"]))
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(10)))], "item_id long, text string")
    for out in (licenses.detect(rows), linededup.dedup_lines(rows), simhash.keep_one(rows), decontamination.clean(rows, bench), decontamination.clean(rows, bench, drop_share=0.99)):
        out = cut(out.select(*(F.col(f"`{c}`").alias(c.replace("a.b", "a_b")) for c in out.columns)))
        assert untouched(rows, out) and set(out.columns) >= {c.replace("a.b", "a_b") for c in rows.columns}
    pages = named(spark.createDataFrame([(1, "http://a.com/en/1"), (2, None), (2, None)], "page_id long, url string"))
    judged = urlfilter.judge(pages, urlfilter.rules_frame(spark, [urlfilter.UrlRule("block", "com", "/en/")]))
    assert untouched(pages, judged.drop("a.b")) and sorted(r.verdict for r in judged.collect()) == ["allow", "allow", "block"]


def test_bytes_of_different_characters_differ():
    keys = [tuple(quality.keys_of([c.encode()])[0].tolist()) for c in map(chr, range(0xD800))]
    assert len(set(keys)) == len(keys)


def test_quality_keeps_columns_of_any_name(spark):
    rows = docs(spark, ["some plain words here"] * 3 + [None, ""])
    for c in ("kept", "n", "lp", "s", "low", "high", "good", "held_out", "n_bytes", "__n", "own", "row"):
        rows = rows.withColumn(c, F.lit(f"own {c}"))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for bound in (quality.MAX_BROADCAST, 0):
        out = quality.keep_good(rows, labels, bound)
        assert out.columns == rows.columns and out.count() == 5 and out.first()["good"] == "own good"


def test_every_row_is_a_document(spark):
    t = "a\nb\nc"
    got = linededup.dedup_lines(docs(spark, [t, t, t, t, "q\nr\ns\nt", "q\nr\ns\nt"], [None, None, 7, 7, 9, 9])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 3), (7, 3), (7, 3), (9, 0), (9, 4)]


def test_signatures(spark):
    said = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
        "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "cc-by-nc-sa": "https://creativecommons.org/licenses/by-nc-sa/4.0/",
        "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "non-commercial": "For non-commercial use only.",
        "copyright": "(Copyright (c) 2019 Somebody",
        "gpl": "You should have received a copy of the GNU General Public License along with this program.",
    }
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.summary(licenses.detect(docs(spark, list(said.values())))).collect()}
    for i, label in enumerate(said):
        assert label in got[i], (label, got[i])
    assert "0bsd" not in got[1] and "isc" not in got[2]
    rules = [licenses.Rule("one", "a b", (), 5, 0.5), licenses.Rule("two", "a b", (), 5, 0.5), licenses.Rule("three", "b c d", (), 4, 0.5)]
    assert [d.label for d in licenses.detect(docs(spark, ["a b c d"]), rules).first().detections] == ["one", "three"]  # the first of equals stands; overlaps stay
    many = licenses.summary(licenses.detect(docs(spark, ["under the mit license " * 3000]))).first()
    assert (many.n_base, many.first_word, many.last_word) == (3000, 0, 4 * 2999)


def test_islands_beat_best_fit(spark):
    r = np.random.default_rng(3)
    a = r.integers(26, 50, 300)  # three items fill each bin exactly
    b = r.integers(25, 100 - a - 25 + 1)
    sizes = np.concatenate([a, b, 100 - a - b])
    r.shuffle(sizes)
    parts = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    first = len(set(packing._fresh(sizes, 100, None)))
    got = packing.pack(parts, max_tokens=100, block=900, islands=3, epochs=3, population=10, generations=150).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(x.n for x in got) == sizes.sum() and max(x.n for x in got) <= 100
    assert 300 <= len(got) < first


def test_blocks_share_their_emptiest_bins(spark):
    parts = spark.createDataFrame([(i, 0, 0, 1 + i % 7, 0) for i in range(400)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    got = packing.pack(parts, max_tokens=64, block=20).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("to")).collect()
    assert all(x.n == x.to <= 64 for x in got) and len(got) == -(-sum(1 + i % 7 for i in range(400)) // 64)
    tiny = packing.pack(parts.withColumn("length", F.lit(1).cast("long")), max_tokens=512, block=20).groupBy("sequence_id").count().collect()
    assert len(tiny) == 1
