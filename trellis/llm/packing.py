"""Token sequences packed by a grouping genetic algorithm on islands.

Documents are tokenized once, cut into pieces, and the narrow piece rows are dealt evenly into
blocks of bounded size.  Each block is packed on several islands at once, each with a population
of its own, begun in an order of its own; between epochs every island sends its best packing to the
next island of its block.  A block whose packing reaches the lower bound is finished and does no
more work.  The emptiest bin of each block is opened, and what they held is packed together again.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.rows import grown, kept, small_batches, trim, trimmed
from trellis.llm.text import whole
from trellis.plans.lineage import cut

MAX_TOKENS = 4096
BLOCK = 8192


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that may join the letter before them into one character (fixed values).
MARKS = "[\u0300-\u036f\u1ab0-\u20ff\u3099\u309a]"


def _letters(part: str) -> bool:
    """Whether a part is a run of letters as the vocabulary sees it: composed, then lower-cased.

    Some letters become a letter and a mark by that, which a stop would join.
    """
    return part.isalpha() and (part.isascii() or all(c.lower().isalpha() for c in unicodedata.normalize("NFC", part)))


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by a vocabulary file.

    The vocabulary's splitter never joins what a space or line feed parts, nor a run of letters
    with the stop or comma behind it, so texts are encoded part by part and parts are remembered.
    Words are numbered by Arrow and only different ones are looked up.  A text that holds a special
    token's opening is encoded whole.  Beyond ``room`` parts the half that came
    last is dropped: common parts come early.
    """

    def __init__(self, path: str, room: int = 650_000):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already use all cores
        self.tokenizer, self.room, self.known = Tokenizer.from_file(path), room, {"": b""}
        self.marks = {m: self._whole(m) for m in ".,"}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, fresh: list[str]) -> None:
        """Add parts to the memory, with one call for all that must be encoded."""
        known, marks = self.known, self.marks
        ended = [p for p in fresh if p[-1] in marks and _letters(p[:-1])]
        plain = set(fresh).difference(ended)
        plain.update(c for c in (p[:-1] for p in ended) if c not in known)
        plain = list(plain)
        for lo in range(0, len(plain), 4096):  # an encoding is large while it lasts
            some = plain[lo : lo + 4096]
            for part, code in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[part] = array("I", code.ids).tobytes()
        for part in ended:
            known[part] = known[part[:-1]] + marks[part[-1]]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and where each text's begin and end (one more than texts).

        The texts hold less than two billion ids together.
        """
        # A-Z are lower-cased first, as the vocabulary does itself; not where a mark may join the letter.
        folded = pc.if_else(pc.match_substring_regex(texts, MARKS), texts, pc.ascii_lower(texts))
        special = pc.match_substring(texts, "<|")
        folded = pc.if_else(special, "", pc.replace_substring(folded, "\n", " "))
        split = pc.split_pattern(folded, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > self.room:
            for part in list(self.known)[self.room // 2 :]:
                del self.known[part]
        codes = list(map(self.known.get, words))
        missing = [i for i, c in enumerate(codes) if c is None]
        if missing:
            self._learn([words[i] for i in missing])
            for i in missing:
                codes[i] = self.known[words[i]]
        every = np.frombuffer(b"".join(codes), "<u4")
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        at = coded.indices.to_numpy(zero_copy_only=False)
        length = sizes[at]
        stop = np.cumsum(length)
        place = np.repeat(((np.cumsum(sizes) - sizes)[at] - stop + length).astype(np.int32), length)
        place += np.arange(len(place), dtype=np.int32)
        ids = every[place]
        bounds = np.concatenate([[0], stop])[np.asarray(split.offsets)]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            own = np.frombuffer(self._whole(texts[i].as_py()), "<u4")
            a, b = int(bounds[i]), int(bounds[i + 1])
            ids = np.concatenate([ids[:a], own, ids[b:]])
            bounds[i + 1 :] += len(own) - (b - a)
        return ids, bounds


def _encoder(path: str) -> Encoder:
    """The encoder of this worker process, which keeps its memory between tasks."""
    return kept(("encoder", path), lambda: Encoder(path))


def _slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, or of one longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, most + (ends[first - 1] if first else 0), "right")))
        yield first, last
        first = last


def pieces(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = 1, text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and ``end_id``, cut at ``max_tokens``.

    A null or empty text is the end id alone.  Only documents over the limit are cut; all their
    pieces but the last are full.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", whole(text).alias("text"))
    schema = grown(rows.select("doc_id").schema, "piece int, start long, length long, ids_crc32 long")
    end, full = int(end_id).to_bytes(4, "little"), 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            at, out = [], []
            for first, last in _slices(batch.column(1)):
                trim()  # what coding a slice takes is many times the slice
                every, bounds = encode(batch.column(1)[first:last])
                held = every.tobytes()
                del every
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), first):
                    ids = held[4 * a : 4 * b] + end
                    for k, lo in enumerate(range(0, len(ids), full)):
                        part = ids[lo : lo + full]
                        at.append(i)
                        out.append((k, lo // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if out else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(trimmed(run), schema)


# One packing is an array that gives each item's bin.


def _best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, room: int, used: int, free: list[tuple[int, int]]) -> int:
    """Put the items in ``order`` where least room is left; ``free`` is sorted (room left, bin)."""
    for i in order.tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(free, (size, -1))
        if k < len(free):
            left, b = free.pop(k)
        else:
            left, b, used = room, used, used + 1
        bins[i] = b
        bisect.insort(free, (left - size, b))
    return used


def _fresh(sizes: np.ndarray, room: int, rng: np.random.Generator | None) -> np.ndarray:
    """Best fit in decreasing order, or in an order near it."""
    order = np.argsort(-(sizes if rng is None else sizes * rng.uniform(0.8, 1.2, len(sizes))), kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    _best_fit(sizes, order, bins, room, 0, [])
    return bins


def _fitness(sizes: np.ndarray, bins: np.ndarray, room: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of how full they are."""
    fill = np.bincount(bins, weights=sizes)
    fill = fill[fill > 0]
    return -len(fill), float(np.mean((fill / room) ** 2))


def _cross(sizes: np.ndarray, one: np.ndarray, two: np.ndarray, room: int, rng: np.random.Generator) -> np.ndarray:
    """Inject whole well-filled bins of ``two`` into ``one``.  Bins of ``one`` that hold any of their
    items go, and so do its emptiest; what they alone held is put back by best fit."""
    fill = np.bincount(two, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    picked = rng.choice(good, max(1, len(good) // 3), replace=False)
    injected = np.isin(two, picked)
    own = np.bincount(one, weights=sizes)
    broken = np.zeros(len(own), bool)
    broken[one[injected]] = True
    live = np.flatnonzero((own > 0) & ~broken)
    broken[live[np.argsort(own[live])[: max(1, len(live) // 50)]]] = True
    out = np.where(injected, len(own) + two, one)
    displaced = np.flatnonzero(~injected & broken[one])
    _, out_kept = np.unique(np.delete(out, displaced), return_inverse=True)
    bins = np.zeros(len(sizes), np.int64)
    stay = np.setdiff1d(np.arange(len(sizes)), displaced, assume_unique=True)
    bins[stay] = out_kept
    left = room - np.bincount(out_kept, weights=sizes[stay]).astype(np.int64) if len(stay) else np.zeros(0, np.int64)
    free = sorted((int(f), b) for b, f in enumerate(left))
    _best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], bins, room, len(left), free)
    return bins


def evolve(sizes: np.ndarray, room: int, seeds: list[np.ndarray], seed: int, population: int = 6, generations: int = 12, plain: bool = True) -> list[np.ndarray]:
    """A population after some generations, best first; it stops at the lower bound of bins.

    Without ``seeds`` it begins with best fit in decreasing order if ``plain``, else in an order of its own.
    """
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // room)
    people = list(seeds)
    if not people:
        people = [_fresh(sizes, room, None if plain else rng)]
    score = [_fitness(sizes, p, room) for p in people]
    while len(people) < population and -max(score)[0] > bound:
        people.append(_fresh(sizes, room, rng))
        score.append(_fitness(sizes, people[-1], room))
    for _ in range(generations):
        if -max(score)[0] <= bound:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        if score[a] < score[b]:
            a, b = b, a
        child = _cross(sizes, people[a], people[b], room, rng)
        own, worst = _fitness(sizes, child, room), min(range(len(people)), key=score.__getitem__)
        if own >= score[worst]:
            people[worst], score[worst] = child, own
    best = sorted(range(len(people)), key=score.__getitem__, reverse=True)
    return [people[i] for i in best]


_STATE = "block long, island int, sizes array<int>, packings array<array<int>>, bins int, bound int"


def _epoch(state: DataFrame, room: int, epoch: int, population: int, generations: int) -> DataFrame:
    """Evolve every island that is not at its bound; a row is one island of one block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for block, island, sizes, packings, bins, bound in frame.itertuples(index=False):
                sizes = np.asarray(sizes, np.int64)
                if bins is None or bins != bins or bins > bound or not len(packings):
                    people = evolve(sizes, room, [np.asarray(p, np.int64) for p in packings],
                                    hash((int(block), int(island), epoch)) & 0x7FFFFFFF, population, generations, island == 0)
                    packings = [p.astype(np.int32) for p in people]
                    bins = -_fitness(sizes, people[0], room)[0]
                out.append((block, island, sizes.astype(np.int32), packings, int(bins), -(-int(sizes.sum()) // room)))
            yield pd.DataFrame(out, columns=["block", "island", "sizes", "packings", "bins", "bound"])

    return state.mapInPandas(trimmed(run), _STATE)


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Each island's best packing also goes to the next island of its block."""
    sent = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("packings")[0].alias("guest"))
    met = state.join(sent, ["block", "island"])
    return met.select("block", "island", "sizes", F.concat(F.array("guest"), "packings").alias("packings"), "bins", "bound")


#: Islands that share a task; more blocks make more tasks.
ISLANDS_A_TASK = 4


def _level(items: DataFrame, blocks: int, room: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """``u, length, block, bin`` for ``items`` (u, length, block), each block packed by itself."""
    # At most a block's pieces in one group.
    listed = items.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("u", F.col("length").cast("int").alias("length")))).alias("items"))
    first = cut(listed.select("block", F.transform("items", lambda x: x["length"]).alias("sizes"), F.transform("items", lambda x: x["u"]).alias("us")))
    tasks = -(-blocks * islands // ISLANDS_A_TASK)
    state = first.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes").select(
        F.col("block").cast("long"), F.col("island").cast("int"), "sizes", F.expr("cast(array() as array<array<int>>)").alias("packings"),
        F.lit(None).cast("int").alias("bins"), F.lit(None).cast("int").alias("bound"))
    for epoch in range(epochs):
        state = (state if epoch == 0 else _migrate(state, islands)).repartition(tasks, "block", "island")
        state = cut(_epoch(state, room, epoch, population, generations))
    best = state.groupBy("block").agg(F.min_by(F.col("packings")[0], F.struct("bins", "island")).alias("bin"))
    placed = first.join(best, "block").select("block", F.explode(F.arrays_zip("us", "sizes", "bin")).alias("x"))
    return cut(placed.select(F.col("x.us").alias("u"), F.col("x.sizes").cast("long").alias("length"), "block", F.col("x.bin").alias("bin")))


def _sequences(items: DataFrame, n: int, most: int, level: int, room: int, block: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """``u, sequence_id`` for the ``n`` ``items`` (u, length), in ``most`` blocks or fewer.

    Every block leaves one bin that is not full.  Those bins are opened, and their items packed together
    once more in at most half as many blocks, until a single one holds them all.  A bin holds no more
    items than tokens, so a block never has more than twice the larger of ``block`` and ``room`` items.
    """
    blocks = max(1, min(round(n / block), most))
    # Equal numbers in every block: a row's place within its partition, started at random.
    dealt = items.select("u", "length", F.pmod(F.monotonically_increasing_id() % (1 << 33) + F.hash(F.spark_partition_id()), F.lit(blocks)).alias("block"))
    placed = _level(cut(dealt), blocks, room, islands, epochs, population, generations)
    # A bin number is below the number of a block's items, and levels are few.
    named = F.lit(level << 56) + F.col("block") * (1 << 24) + F.col("bin")
    if blocks == 1:
        return placed.select("u", named.alias("sequence_id"))
    fill = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill")).groupBy("block").agg(F.min(F.struct("fill", "bin")).alias("least"))
    open_ = cut(fill.select("block", F.col("least.bin").alias("bin")))
    spare = cut(placed.join(open_, ["block", "bin"], "left_semi").select("u", "length"))
    again = _sequences(spare, spare.count(), blocks // 2, level + 1, room, block, islands, epochs, population, generations)
    return placed.join(open_, ["block", "bin"], "left_anti").select("u", named.alias("sequence_id")).unionAll(again)


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS, block: int = BLOCK, islands: int = 2, epochs: int = 2,
         population: int = 6, generations: int = 12) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    No sequence exceeds ``max_tokens``.  Blocks hold about ``block`` pieces each, dealt without
    regard to any key, so no value can make one of them large.  Every row is a piece of its own,
    whatever its id: null and repeated ids keep all their rows.  An empty table gives no rows.
    """
    rows = cut(parts.withColumn("u", F.monotonically_increasing_id()))
    n = rows.count()
    placed = _sequences(rows.select("u", "length"), n, n, 0, max_tokens, block, islands, epochs, population, generations)
    joined = rows.join(placed, "u")
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "u").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*parts.columns, F.col("sequence_id"), F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))
