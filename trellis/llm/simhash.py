"""Near-duplicate documents by SimHash fingerprints and anchor-point covering.

A fingerprint's two halves of 32 bits are covered one by one: two fingerprints that differ in
at most three bits differ in at most one bit of some half.  The anchors of a half are the
code words of the perfect Hamming code on its 31 lower bits, whose covering radius is one.  A
fingerprint's home is the one anchor within that radius; it is replicated to every anchor
within radius plus threshold (1 + 1), 1 or 16 of them, and compared per anchor with those
whose home it is.  A pair that is that close on the half therefore always meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.rows import forget_kept, grown, small_batches, trimmed
from trellis.llm.text import free_name, row_key
from trellis.operators.components import connected_components
from trellis.plans.lineage import cut

SEED = 42
SHINGLE = 3
MAX_BITS = 3


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of a text's word shingles as a signed 64-bit integer; zero without words.

    Words are runs of other than ASCII white space in the text with A-Z lower-cased.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - width + 1)
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(line)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        part = np.array([digest(line[a:b], SEED) for a, b in zip(starts[lo : lo + 65536], stops[lo : lo + 65536])], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp`` of every row, from shingles of ``width`` words; a null text has no words."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = grown(rows.drop("__text").schema, "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            fps = pa.array([fingerprint(t, width) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fps], names=[*keep, "fp"])

    return rows.mapInArrow(trimmed(run), schema)


#: Column i holds, for syndrome i + 1, the masks that lead to the anchors within distance two.
_MASKS = np.array([[1 << (s - 1)] + [(1 << (x - 1)) | (1 << ((x ^ s) - 1)) for x in range(1, 32) if x < x ^ s] for s in range(1, 32)], np.int64)
_PARITY = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def _covered(fps: DataFrame) -> DataFrame:
    """``(half, anchor, fp, home)``: a row for each anchor that a fingerprint goes to.

    The key is half and anchor in one integer; ``home`` marks the anchor within radius one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            out = []
            for half in (0, 1):
                bits = (fp >> (32 * half)) & 0x7FFFFFFF
                syndrome = sum((np.bitwise_count(bits & m).astype(np.int64) & 1) << k for k, m in enumerate(_PARITY))
                exact = syndrome == 0
                near = bits[~exact, None] ^ _MASKS[syndrome[~exact] - 1]
                out.append((np.full(exact.sum(), half), bits[exact], fp[exact], np.ones(exact.sum(), bool)))
                out.append((np.full(near.size, half), near.ravel(), np.repeat(fp[~exact], 16), np.tile(np.arange(16) == 0, len(near))))
            half, anchor, own, home = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(half << 31 | anchor), pa.array(own), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``, a < b: the different fingerprints at ``max_bits`` (0 to 3) or fewer differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves of covering threshold one find up to three differing bits")
    rows = _covered(fps.select("fp").distinct())
    home = rows.where("home").select("anchor", F.col("fp").alias("a"))
    near = rows.select("anchor", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = home.join(near.hint("merge"), (home.anchor == near.anchor) & (F.col("a") < F.col("b")) & close)
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id``, ``th`` (a hash of its text), ``fp``, ``component``.

    Documents of one component reach each other by links of at most ``max_bits`` bits;
    ``component`` is its smallest fingerprint.  Texts without words have fingerprint zero and link
    like any other.  Equal fingerprints are one node, so copies are never expanded into pairs;
    repeated rows and null ids keep their rows.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("__t"))
    fps = cut(fingerprints(keyed, "__t", ("doc_id", "th")))
    group = cut(connected_components(links(fps, max_bits)))
    return fps.join(group.select(F.col("node").alias("fp"), "component").hint("merge"), "fp", "left").select(
        "doc_id", "th", "fp", F.coalesce("component", "fp").alias("component"))


def with_smallest_id(members: DataFrame) -> DataFrame:
    """``members`` and ``component_id``, the smallest doc_id in each component (null if all are null)."""
    low = cut(members.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return members.join(low.hint("merge"), "component")


def first_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of ``members`` (doc_id, th, component): the smallest id, nulls last."""
    first = members.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))).alias("k"))
    key, other = free_name("of", docs.columns), free_name("of_first", docs.columns)
    # A struct, so that null ids are equal, and that the join and the choice of one row share one shuffle of texts.
    first = cut(first.select(F.struct(F.col("k.th").alias("th"), F.col("k.doc_id").alias("doc_id")).alias(other))).hint("merge")
    rows = docs.withColumn(key, row_key())
    return rows.join(first, F.col(key) == F.col(other), "left_semi").dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id, nulls last.

    Columns and their order stay.  Rows that repeat an id and its text count as one.
    """
    return first_of(docs, near_duplicates(docs))
