"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.rows import grown
from trellis.plans.lineage import cut


def byte_shards(docs: DataFrame, shards: int = 8, text: str = "text", per_task: int = 200_000) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row, in ``doc_id`` order.

    Rows are dealt by range, the totals of the partitions (one row each) are summed into
    offsets, and every task adds its own running sum.  A row goes to the shard in which its
    first byte falls when the total is cut at ``shards`` equal targets, so a shard misses its
    target by less than one row.  ``slot`` counts rows within the shard.

    Null ids come first; rows that share an id are ordered by text hash, and equal rows by where
    they are read, so a repeated row is spread over as many partitions as it needs.  A null text
    has size 1 and checksum 0.  An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = cut(docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("tie"), F.monotonically_increasing_id().alias("at")))
    n = max(1, -(-narrow.count() // per_task), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("doc_id", "tie", "at")
    dealt = cut(_running(narrow.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "doc_id", "size", "text_crc32")))
    # A row for each partition of the deal, so this window and its broadcast are bounded by n.
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = cut(totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"), F.sum("bytes").over(every).alias("total")))
    placed = dealt.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", (F.col("ahead") + F.col("nth")).alias("nth"),
        F.expr(f"cast(((offset + start) * cast({shards} as decimal(10,0))) div total as int)").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def _running(rows: DataFrame) -> DataFrame:
    """``rows`` and their first byte ``start`` and place ``nth`` within the partition, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = nth = 0
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False)
            ends = start + np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends - size, pa.int64()), pa.array(np.arange(nth, nth + len(size)), pa.int64())],
                names=["part", "doc_id", "size", "text_crc32", "start", "nth"])
            start, nth = int(ends[-1]) if len(ends) else start, nth + len(size)

    return rows.mapInArrow(run, grown(rows.schema, "start long, nth long"))
