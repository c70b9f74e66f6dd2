"""Relations kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.sources.store import relation_store


def new_pairs(events: DataFrame, elem: str = "user_id", node: str = "event_type", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """``elem, node, ts`` the first time each pair is seen within the watermark."""
    pairs = events.select(F.col(elem).alias("elem"), F.col(node).alias("node"), F.col(ts).alias("ts"))
    return pairs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["elem", "node"])


def windowed_degrees(events: DataFrame, node: str = "event_type", elem: str = "user_id", ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, node, incidences, elements`` for tumbling windows; ``elements`` is approximate, as streams require."""
    seen = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(node).alias("node"))
    return seen.agg(F.count("*").alias("incidences"), F.approx_count_distinct(elem).alias("elements")).select(F.col("w.start").alias("start"), "node", "incidences", "elements")


def maintain(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Start a query that brings each micro-batch's pairs into the stored relation (``relation_store``) at ``path``.

    A batch reads and writes the buckets of its own elements alone, and counts once however often it is replayed.
    """
    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in ("elem", "node"))
    store = relation_store(stream.sparkSession, path, buckets, schema=schema)

    def merge(batch: DataFrame, number: int) -> None:
        store.apply(batch.select("elem", "node"), batch=(checkpoint, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
