"""Licenses in texts of very many detections."""

import time

from trellis.llm import licenses


def test_many_detections_of_one_text(spark):
    near = "licensed under the gnu general public license version 3. see the zlib license. under the mit license. "
    texts = [near * n for n in (1, 8_000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    began = time.time()
    one, many = (r.detections for r in licenses.detect(rows).orderBy("doc_id").collect())
    assert time.time() - began < 60
    words, found = len(licenses_words(near)), [(d.label, d.start, d.stop) for d in one]
    assert [(d.label, d.start, d.stop) for d in many] == [(label, start + k * words, stop + k * words) for k in range(8_000) for label, start, stop in found]


def licenses_words(text):
    return text.replace(".", " ").split()
