"""A corpus cleaned and packed in stages, each of which calls one operator of ``trellis.llm``.

Every stage works on all documents that the one before kept, and but for the last returns their columns,
whatever their names.  Null ids and texts pass as the operators say, empty tables stay empty, and rows that
repeat an id and its text are documents of their own until near dedup keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import decontamination, linededup, neardup, packing, quality
from trellis.plans.lineage import cut, discard


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is beyond their language's limits go; null and empty texts stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go; so do documents of which nothing is left.

    ``n_chars``, where there is one, becomes that of the new text.
    """
    left = linededup.dedup_lines(docs)
    left = left.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return left.drop(*(c for c in ("n_lines", "n_removed") if c not in docs.columns)).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word Jaccard similarity 0.8 or more, stays: the smallest id.

    SimHash groups first, whose links are confirmed; an exact join finds what three bits miss.  Texts without words are alike.
    """
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; an empty benchmark takes none."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 4096 tokens; a null text is its end token alone."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", best_fit_packing),
]

#: The language model, fingerprints and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(before)
    return docs
