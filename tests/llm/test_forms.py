"""The SQL forms of the corpus queries, and the pipeline from end to end, at the smallest scale."""

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trellis.llm.queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_queries import SF, duck, float_, rows  # noqa: E402, F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):  # noqa: F811
    a, b = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLES[name]).fetchdf())
    assert [tuple(map(float_, r)) for r in a] == [tuple(map(float_, r)) for r in b]


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    ends = out.withColumn("end", F.col("offset") + F.col("length")).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("end").alias("to"))
    assert out.count() and ends.where("n <> to or n > 4096").isEmpty()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.join(docs, "doc_id", "left_anti").isEmpty()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name
