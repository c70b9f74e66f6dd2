"""Near copies: SimHash groups confirmed by the Jaccard similarity of word shingles, then all other similar pairs.

SimHash fingerprints of five-word shingles that anchor-point covering finds within three bits are
candidates; those whose texts are similar enough are linked.  Three bits find only almost equal
texts, and the wider radius that a similarity of 4/5 needs (about ten bits of 64) has no selective
covering, so an exact join by prefixes finds the rest.

Shingles have one order for all texts, rare ones first.  Two texts of a similarity of 4/5 or more
share that part of the shingles of each, so that the first n - ceil(4/5 n) + 1 of their n shingles
meet in at least one.  Texts that meet are compared shingle by shingle: no pair is missed, and none
is linked below the limit (but for equal 64-bit hashes).

Many texts that meet in a shingle are not paired with each other.  In a few rounds, all are compared
with the one that has fewest rarer shingles, which is nearest to what they share.  After that only
texts outside of a shingle's largest group are compared with the others there.  Pairs whose sizes, places
or parity maps show that they cannot be similar enough are left out where they would be made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.rows import forget_kept, small_batches, trimmed
from trellis.llm.simhash import MAX_BITS, SEED, fingerprints, first_of
from trellis.llm.simhash import links as close_fingerprints
from trellis.llm.text import text_hash
from trellis.operators.components import connected_components
from trellis.operators.query import mirrored
from trellis.plans.lineage import cut, discard

WIDTH = 5
#: The least similarity as a fraction.
SIMILAR = (4, 5)
#: Documents from which common shingles are learned, and how many are kept.  They set the order
#: of shingles, thus the number of comparisons, never the result.
SAMPLE, COMMON = 20_000, 100_000
#: Rounds against a shingle's most typical text at most, and how many pairs need none.  A round that does
#: not halve the pairs is the last.
ROUNDS, FEW_PAIRS = 3, 1_000_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a shorter text is one shingle.

    Words are runs of other than ASCII white space in the text with A-Z lower-cased.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64).view(np.int64)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *stops[: len(words) - width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, (stops[width - 1 :] - 1).tolist())], np.uint64).view(np.int64))


def _common(keyed: DataFrame, width: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that several texts of a sample hold, and in how many."""
    step = max(1, keyed.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shingles(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]))], names=["h"])

    each = keyed.where(F.pmod("node", F.lit(step)) == 0).mapInArrow(trimmed(run), "h long")
    top = each.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    pairs = np.array(sorted((r[0], r[1]) for r in top), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _postings(keyed: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(key, node, n, at)``: the first shingles of each text, how many it has in all, and how many come before."""
    told = keyed.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        known, often = told.value
        seen: set[int] = set()  # copies in a task count once
        for batch in batches:
            keys, nodes, sizes, places = ([np.zeros(0, np.int64)] for _ in range(4))
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node in seen:
                    continue
                seen.add(node)
                h = shingles(t, width)
                most = len(h) + (-len(h) * SIMILAR[0] // SIMILAR[1]) + 1
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, often[at], 0)
                keys.append(h[np.lexsort((h, rank))[:most]])
                nodes.append(np.full(most, node)), sizes.append(np.full(most, len(h))), places.append(np.arange(most))
            key, node, n, at = map(np.concatenate, (keys, nodes, sizes, places))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n, pa.int32()), pa.array(at, pa.int32())], names=["key", "node", "n", "at"])

    return keyed.mapInArrow(trimmed(run), "key long, node long, n int, at int")


#: Bits of a text's parity map, in columns of 64.
MAP = 256
_MAPS = [f"m{i}" for i in range(MAP // 64)]


def parity(h: np.ndarray) -> np.ndarray:
    """For each of ``MAP`` classes of shingles, whether a text holds an odd number, as 64-bit integers.

    Two maps differ in at most as many bits as there are shingles that only one of the texts holds.
    """
    return np.packbits(np.bincount(h & (MAP - 1), minlength=MAP).astype(np.uint8) & 1).view(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """A parity map as ``parity``'s, of two to four classes a shingle, as bytes: long texts fill no map of one size."""
    bits = max(MAP, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount(h & (bits - 1), minlength=bits).astype(np.uint8) & 1)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two sketches differ, the longer one folded to the length of the other."""
    short = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, short)) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _maps(keyed: DataFrame, width: int) -> DataFrame:
    """``node``, its parity map, its number ``size`` of shingles and its sketch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            maps = np.array([parity(h) for h in sets], np.int64).reshape(-1, len(_MAPS))
            more = [pa.array([len(h) for h in sets], pa.int32()), pa.array([sketch(h).tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, maps.T), *more], names=["node", *_MAPS, "size", "sketch"])

    return keyed.mapInArrow(trimmed(run), "node long, " + ", ".join(f"{m} long" for m in _MAPS) + ", size int, sketch binary").dropDuplicates(["node"])


def _possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches leave open that the texts are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for both, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                apart = differing(*(np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y)))
                near.append((both - apart) * sum(SIMILAR) >= both * 2 * SIMILAR[0])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda of, n, s: maps.select(F.col("node").alias(of), F.col("size").alias(n), F.col("sketch").alias(s))
    held = pairs.join(side("b", "m", "y").hint("merge"), "b").join(side("a", "n", "x").hint("merge"), "a")
    return held.select("a", "b", F.col("n").cast("long") + F.col("m"), "x", "y").mapInArrow(trimmed(compare), "a long, b long")


def _confirmed(keyed: DataFrame, maps: DataFrame, pairs: DataFrame, width: int, max_broadcast: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough, as a written table; ``pairs`` is discarded.

    Whole sets of shingles are sent for the pairs alone that sketches, some twentieth of the bytes, leave open.
    """
    tried, pairs = pairs, cut(_possible(pairs, maps))
    discard(tried)
    nodes = cut(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct())
    wanted = F.broadcast(nodes) if nodes.count() <= max_broadcast else nodes.hint("merge")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    rows.append((node, shingles(t, width).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both * SIMILAR[1] >= (len(x) + len(y) - both) * SIMILAR[0])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    held = cut(keyed.join(wanted, "node", "left_semi").mapInArrow(trimmed(sets), "node long, s binary").dropDuplicates(["node"]))
    one, two = held.select(F.col("node").alias("a"), F.col("s").alias("x")), held.select(F.col("node").alias("b"), F.col("s").alias("y"))
    similar = cut(pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(trimmed(compare), "a long, b long"))
    discard(pairs, nodes, held)
    return similar


def _alike(keyed: DataFrame, maps: DataFrame, width: int, max_broadcast: int) -> DataFrame:
    """Links (a, b) of texts whose SimHash fingerprints are equal or close, and that are similar enough."""
    fps = cut(fingerprints(keyed, "__t", ("node",), width).distinct())
    first = fps.groupBy("fp").agg(F.min("node").alias("a"))
    same = fps.join(first.hint("merge"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    name = lambda side: first.select(F.col("fp").alias(f"fp_{side}"), F.col("a").alias(side))
    # Each fingerprint is tried with the smallest one near it; what that leaves apart, the join by prefixes links.
    near = close_fingerprints(fps, MAX_BITS).groupBy(F.col("b").alias("fp_y")).agg(F.min("a").alias("fp_x")).join(name("x").hint("merge"), "fp_x").join(name("y").hint("merge"), "fp_y")
    pairs = same.unionAll(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return _confirmed(keyed, maps, cut(pairs), width, max_broadcast)


def _labels(found: DataFrame, hops: int = 4) -> DataFrame:
    """``node, component``: the smallest text within some links.  Texts with one label are of one group, which is
    enough to leave pairs out, and cheap; those of one group may have several."""
    both = cut(mirrored(found.select(F.col("a").alias("e1"), F.col("b").alias("e2"))).distinct())
    label = both.groupBy(F.col("e1").alias("node")).agg(F.min(F.least("e1", "e2")).alias("component"))
    for _ in range(hops - 1):
        passed = both.join(label.withColumnRenamed("node", "e2").hint("merge"), "e2").select(F.col("e1").alias("node"), "component")
        label = cut(passed.unionAll(label).groupBy("node").agg(F.min("component").alias("component")))
    return label


def groups(docs: DataFrame, text: str = "text", width: int = WIDTH, max_broadcast: int = 4_000_000, sample: int = SAMPLE,
           few_pairs: int = FEW_PAIRS, rounds: int = ROUNDS) -> DataFrame:
    """``(node, component)`` of texts, by hash, that are linked to another one; the smallest of the group.

    Links are between texts whose shingles have a Jaccard similarity of 4/5 or more; texts of a
    group reach each other by links.  Texts without words are alike.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(text_hash(text).alias("node"), F.col(text).alias("__t"))
    maps = cut(_maps(keyed, width))
    found = _alike(keyed, maps, width, max_broadcast)
    w = Window.partitionBy("key")
    met = _postings(keyed, width, _common(keyed, width, sample)).withColumns({"lo": F.min("node").over(w), "hi": F.max("node").over(w)}).where("lo < hi")
    met = cut(met.select("key", "node", "n", "at").distinct())
    most, tried, before = max(few_pairs, 4 * met.count()), None, float("inf")
    size = lambda a, b: F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]
    # If it is the first shingle that two texts share, no more than the rest of each can be common.
    reach = (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("ahead")) * sum(SIMILAR)) >= (F.col("n") + F.col("m")) * SIMILAR[0]
    # So many shingles at least are in one of two texts alone.
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"a_{m}"))) for m in _MAPS[1:]), F.bit_count(F.col(_MAPS[0]).bitwiseXOR(F.col(f"a_{_MAPS[0]}"))))
    near = (F.col("n") + F.col("m") - apart) * sum(SIMILAR) >= (F.col("n") + F.col("m")) * (2 * SIMILAR[0])
    for step in range(max(1, rounds) + 1):
        group = _labels(found)
        now = met.join(group.hint("merge"), "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("component"))
        now = now if tried is None else now.join(tried.hint("merge"), ["key", "node"], "left_anti")
        parts = now.groupBy("key", "component").agg(F.count("*").alias("c"), F.min(F.struct("at", "n", "node")).alias("p"))
        keys = parts.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("major"), F.min(F.struct("p", "component")).alias("typical"), F.count("*").alias("parts"))
        keys = cut(keys.where("parts > 1"))
        pairs = keys.agg(F.sum(F.col("all").cast("double") * (F.col("all") - F.col("major.c")))).first()[0] or 0
        if not pairs:
            return connected_components(found)
        # The first round always is one against typical texts, so that a group of copies is a star and not all its pairs.
        last = step > 0 and (step >= rounds or pairs <= most or 2 * pairs > before)
        before = pairs
        now = cut(now.join(keys.select("key", F.col("major.component").alias("major")), "key").join(maps.select("node", *_MAPS), "node"))
        if last:
            left = now.where("component <> major").select("key", F.col("node").alias("a"), F.col("n").alias("m"), F.col("at").alias("ahead"), F.col("component").alias("other"), *(F.col(m).alias(f"a_{m}") for m in _MAPS))
            # Both of a pair may be outside of the largest group: it is taken once.
            once = (F.col("component") == F.col("major")) | (F.col("a") < F.col("node"))
        else:
            left = keys.select("key", F.col("typical.p.node").alias("a"), F.col("typical.p.n").alias("m"), F.col("typical.p.at").alias("ahead"), F.col("typical.component").alias("other"))
            left = left.join(maps.select(F.col("node").alias("a"), *(F.col(m).alias(f"a_{m}") for m in _MAPS)), "a")
            once = F.lit(True)
        meet = left.join(now, "key").where(once & (F.col("other") != F.col("component")) & size("m", "n") & reach & near)
        meet = cut(meet.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
        discard(now)
        found = cut(found.unionAll(_confirmed(keyed, maps, meet, width, max_broadcast)))
        if last:
            return connected_components(found)
        done = keys.select("key", F.col("typical.p.node").alias("node"))
        tried = cut(done if tried is None else tried.unionAll(done))
    raise AssertionError("the last round returns")


def keep_one(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id, nulls last.

    Columns and their order stay.  Rows that repeat an id and its text count as one.
    """
    members = docs.select("doc_id", text_hash("text").alias("th")).join(groups(docs, width=width, **how).withColumnRenamed("node", "th"), "th", "left")
    return first_of(docs, members.select("doc_id", "th", F.coalesce("component", "th").alias("component")))
