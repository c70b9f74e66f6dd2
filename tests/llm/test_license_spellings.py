"""Spellings and notices against labels that are written down here."""

import pytest

from trellis.llm import licenses

SAID = [
    ("Licensed under the Creative Commons Attribution NonCommercial ShareAlike 4.0", "cc-by-nc-sa"),
    ("licensed under the creative commons attribution-non-commercial-share-alike 4.0", "cc-by-nc-sa"),
    ("licensed under the Creative Commons Attribution NoDerivs 4.0", "cc-by-nd"),
    ("licensed under the Creative Commons Attribution NonCommercial", "cc-by-nc"),
    ("licensed under the GPLv3", "gpl-3"), ("licensed under GPLv2", "gpl-2"), ("licensed under the LGPLv3", "lgpl-3"), ("licensed under the GPL v3", "gpl-3"), ("licensed under GPL 3.0", "gpl-3"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and", "mit"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
    ("terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", "lgpl-2.1"),
]


def test_spellings(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.summary(licenses.detect(docs)).collect()}
    assert got == {i: label for i, (_, label) in enumerate(SAID)}


@pytest.mark.parametrize("text", ["licensed under the creative commons attribution noncommercialsale", "licensed under gplv33"])
def test_longer_words_are_not_taken(spark, text):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    assert not {"cc-by-nc", "gpl-3"} & set(licenses.summary(licenses.detect(docs)).first().labels.split(","))
