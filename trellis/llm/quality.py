"""Document quality by the perplexity of an n-gram model over bytes of UTF-8.

The model is interpolated modified Kneser-Ney over the last ``ORDER`` bytes.  Its counts
come from all trusted documents.  Tables of n-grams, contexts and lower orders are keyed by
integers, sharded by key, and joined to give each n-gram's probability.  Documents are scored in
the tasks that read them while the model is within a checked size.  A larger model stays sharded: the
different n-grams of each chunk of documents are joined with it by key, and each chunk gets its own answers back.  A document is kept if its perplexity lies between
quantiles of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.rows import forget_kept, grown, small_batches, trimmed
from trellis.llm.text import whole
from trellis.plans.lineage import cut, discard

ORDER = 6
BITS = 9  # of a byte in a key: 1 to 256, and 0 before a text begins
MAX_BROADCAST = 4_000_000  # n-grams and contexts of a model that travels to the tasks, and ids likewise
CHUNK = 8 << 20  # bytes of text whose n-grams are looked up together in a sharded model


def keys_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """N-gram keys of all bytes of the texts in a row, and each text's number of bytes.

    A text begins after ``order - 1`` zeros; a byte's code is one more than the byte.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + order - 1)
    line, own = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64), np.ones(int(ends[-1]) if len(ends) else 0, bool)
    own[((ends - lengths)[:, None] - 1 - np.arange(order - 1)).ravel()] = False
    line[own] = np.frombuffer(b"".join(texts), np.uint8)
    line[own] += 1
    keys = line.copy()
    for k in range(1, order):
        keys[k:] |= line[:-k] << (BITS * k)
    return keys[own], lengths


def key_runs(texts: pa.Array, order: int = ORDER, most: int = 1 << 19) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts' places, their numbers of bytes and their keys, about ``most`` bytes at a time.

    A longer text comes in several runs, each of which knows the bytes before it.
    """
    at, held, size = [], [], 0
    for i, value in enumerate(texts):
        text = value.as_buffer().to_pybytes()
        if len(text) > most:
            for lo in range(0, len(text), most):
                back = min(lo, order - 1)
                keys, _ = keys_of([text[lo - back : lo + most]], order)
                yield [i], np.array([len(keys) - back]), keys[back:]
            continue
        at.append(i), held.append(text)
        size += len(text)
        if size >= most:
            keys, lengths = keys_of(held, order)
            yield at, lengths, keys
            at, held, size = [], [], 0
    if held:
        keys, lengths = keys_of(held, order)
        yield at, lengths, keys


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(g, c)``: how often each n-gram stands in the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        held, counts, size = [], [], 0

        def drain() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate(held), return_inverse=True)
            return every, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for _, _, keys in key_runs(batch.column(0), order):
                g, c = np.unique(keys, return_counts=True)
                held.append(g), counts.append(c)
                size += len(g)
                if size > 1_500_000:
                    g, c = drain()
                    held, counts, size = [g], [c], len(g)
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])
                        held, counts, size = [], [], 0
        if held:
            g, c = drain()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])

    small_batches(docs.sparkSession)
    return docs.select(whole("text").alias("text")).mapInArrow(trimmed(run), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(table: DataFrame) -> list[float]:
    """The three discounts from the numbers of n-grams seen once to four times."""
    n = dict(table.where("c <= 4").groupBy("c").agg(F.count("*")).collect())
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in range(1, 5))
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


@dataclass
class Model:
    """``grams[k]`` (g, lp) and ``contexts[k]`` (h, ll), k from 1 to order: log probabilities of
    seen n-grams, and log weights of what a context leaves to the next lower order.  ``floor`` is
    the log probability of a byte when nothing is known."""

    order: int
    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: float
    written: list[DataFrame]

    def discard(self) -> None:
        """Delete its tables, once all that was scored with it is."""
        discard(*self.written)


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Fit the model to the texts of ``docs``, all of them."""
    tables = [cut(ngram_counts(docs, order))]
    for k in range(order - 1, 0, -1):  # how many different characters stand before each shorter n-gram
        tables.append(cut(tables[-1].groupBy(F.expr(f"g & {(1 << BITS * k) - 1}L").alias("g")).agg(F.count("*").alias("c"))))
    tables.reverse()
    known = tables[0].count()
    floor = -float(np.log(known + 1))
    lower, grams, contexts, written = None, [], [], []
    for k, table in enumerate(tables, 1):
        d1, d2, d3 = _discounts(table)
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        table = table.withColumn("h", F.expr(f"shiftright(g, {BITS})")).withColumn("off", off)
        per = cut(table.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("left")))
        joined = table.join(per, "h")
        if lower is None:
            below = F.lit(float(np.exp(floor)))
        else:
            joined = joined.withColumn("low", F.expr(f"g & {(1 << BITS * (k - 1)) - 1}L")).join(lower.select(F.col("g").alias("low"), F.exp("lp").alias("p")), "low")
            below = F.col("p")
        lower = cut(joined.select("g", F.log((F.col("c") - F.col("off")) / F.col("total") + F.col("left") * below).alias("lp")))
        grams.append(lower)
        contexts.append(per.select("h", F.log("left").alias("ll")))
        written += [lower, per]
    discard(*tables)
    return Model(order, grams, contexts, floor, written)


class Lookup:
    """A map from integers to numbers for whole arrays, as sorted keys: no more memory than the entries."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    @staticmethod
    def of(table: DataFrame) -> Lookup:
        """From the two columns of a table within the broadcast bound."""
        keys, values = (c.to_numpy() for c in table.toArrow().columns)
        order = np.argsort(keys)
        return Lookup(keys[order], values[order])

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where unknown), and which keys are known."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.values[at], 0.0), hit


class Scorer:
    """The model in arrays, for the tasks."""

    def __init__(self, order: int, floor: float, grams: list[Lookup], contexts: list[Lookup]):
        self.order, self.floor, self.grams, self.contexts = order, floor, grams, contexts

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        keys, places = np.unique(keys, return_inverse=True)  # each n-gram once, and in the order of the tables
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for k in range(self.order, 0, -1):
            now = keys[left] & ((1 << BITS * k) - 1)
            value, hit = self.grams[k - 1](now)
            out[left[hit]] += value[hit]
            left, now = left[~hit], now[~hit]
            if not len(left):
                return out[places]
            out[left] += self.contexts[k - 1](now >> BITS)[0]
        out[left] += self.floor
        return out[places]


def _fits(model: Model, max_broadcast: int) -> bool:
    return sum(t.count() for t in [*model.grams, *model.contexts]) <= max_broadcast


def score(rows: DataFrame, model: Model, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``kept, n, lp`` for ``rows`` (kept, text): a text's bytes and their log probability; ``kept`` may be anything."""
    rows = rows.select("kept", whole("text").alias("text"))
    schema = grown(rows.drop("text").schema, "n long, lp double")
    if not _fits(model, max_broadcast):
        return _score_by_join(rows, model)
    spark = rows.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(Scorer(model.order, model.floor, [Lookup.of(t) for t in model.grams], [Lookup.of(t) for t in model.contexts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            n, lp = _sums(batch.column(1), sent.value.order, sent.value.log_probs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(lp)], names=["kept", "n", "lp"])

    return rows.mapInArrow(trimmed(run), schema)


def _sums(texts: pa.Array, order: int, log_probs: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of bytes and log probability."""
    n, lp = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for at, lengths, keys in key_runs(texts, order):
        sums, ends = np.concatenate([[0.0], np.cumsum(log_probs(keys))]), np.cumsum(lengths)
        n[at] += lengths
        lp[at] += sums[ends] - sums[ends - lengths]
    return n, lp


def _score_by_join(rows: DataFrame, model: Model, chunk: int = CHUNK) -> DataFrame:
    """As ``score``, with the model left in its shards.

    Texts in the order they are read form chunks of about ``chunk`` bytes.  A chunk asks for each of its
    n-grams once; the answers meet its texts in one task, which holds those of one chunk at a time.
    """
    small_batches(rows.sparkSession)
    order, schema = model.order, rows.schema

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ends = size + np.cumsum(pc.binary_length(batch.column(1).cast(pa.large_binary())).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((np.int64(part) << 33) + at + ends // chunk)], names=["kept", "text", "chunk"])
            at, size = at + int(ends[-1]) // chunk, int(ends[-1]) % chunk

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(0, np.int64)
        give = lambda: pa.RecordBatch.from_arrays([pa.array(np.full(len(held), now, np.int64)), pa.array(held)], names=["chunk", "g"])
        for batch in batches:
            chunks = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo and chunks[lo] != now:
                    if len(held):
                        yield give()
                    now, held = int(chunks[lo]), np.zeros(0, np.int64)
                for _, _, keys in key_runs(batch.column(0).slice(lo, hi - lo), order):
                    held = np.union1d(held, keys)
        if len(held):
            yield give()

    rows = cut(rows.mapInArrow(trimmed(dealt), grown(schema, "chunk long")))
    grams = cut(rows.select("text", "chunk").mapInArrow(trimmed(asked), "chunk long, g long"))
    open_, done, rounds = grams.select("g").distinct().select("g", F.lit(0.0).alias("lp")), [], []
    for k in range(order, 0, -1):
        own = open_.withColumn("m", F.expr(f"g & {(1 << BITS * k) - 1}L"))
        both = cut(own.join(model.grams[k - 1].select(F.col("g").alias("m"), F.col("lp").alias("p")), "m", "left"))
        rounds.append(both)
        done.append(both.where("p is not null").select("g", F.expr("lp + p").alias("lp")))
        rest = both.where("p is null").select("g", "lp", F.expr(f"shiftright(m, {BITS})").alias("h"))
        open_ = rest.join(model.contexts[k - 1], "h", "left").select("g", F.expr("lp + coalesce(ll, 0D)").alias("lp"))
    every = open_.select("g", (F.col("lp") + model.floor).alias("lp"))
    for part in done:
        every = every.unionAll(part)
    known = cut(every)
    discard(*rounds)
    nothing = lambda name: F.lit(None).cast(schema[name].dataType).alias(name)
    answers = grams.join(known, "g").select("chunk", F.lit(0).alias("asks"), "g", "lp", nothing("kept"), nothing("text"))
    texts = rows.select("chunk", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("double").alias("lp"), "kept", "text")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            chunks, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(chunks)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo and chunks[lo] != now:
                    now, held, table = chunks[lo], [], None
                some = batch.slice(lo, hi - lo)
                if hi > lo and not asks[lo]:
                    held.append((some.column(2).to_numpy(), some.column(3).to_numpy()))
                elif hi > lo:
                    if table is None:
                        g, lp = map(np.concatenate, zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0))
                        sort = np.argsort(g)
                        held, table = [], Lookup(g[sort], lp[sort])
                    n, lp = _sums(some.column(5), order, lambda keys: table(keys)[0])
                    yield pa.RecordBatch.from_arrays([some.column(4), pa.array(n), pa.array(lp)], names=["kept", "n", "lp"])

    # A chunk's answers and texts have their bounds; a chunk whose answers came twice from parts of a file is asked once.
    both = answers.dropDuplicates(["chunk", "g"]).unionAll(texts).repartition("chunk").sortWithinPartitions("chunk", "asks")
    return both.mapInArrow(trimmed(answered), grown(rows.select("kept").schema, "n long, lp double"))


#: Bytes at its language's usual rate that are added to every document, so that a few
#: bytes cannot condemn a short one.
PRIOR = 100
#: The shares of trusted documents that lie below the limits: all trusted ones for the lower, those
#: that the model has not seen for the upper.
LOW, HIGH = 0.0002, 0.999
FOLDS, LEAST = 5, 30
ADDED = ("n_bytes", "perplexity", "perplexity_low", "perplexity_high", "good")


def _surprise(usual: Column) -> Column:
    """Mean negative log probability of a byte, drawn towards the usual for short texts."""
    return (-F.col("lp") + PRIOR * usual) / (F.col("n") + PRIOR)


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``perplexity``, its limits ``perplexity_low`` and ``perplexity_high``, and ``good``.

    Trusted documents are those with a label of quality 1.  Four fifths of them, by text hash so
    that copies stay together, train the model; the other fifth sets the upper limit, the 0.999 quantile
    of their language, and all set the lower one, the 0.0002 quantile.  With n documents a limit is
    moved away from the median by sqrt(30 / n) / 2 of its distance from it, which vanishes as n grows.  A language with
    fewer than 30 of them, and null, gets the limits of all.  Without trusted documents every
    document is good.  A null or empty text has the usual surprise of its language and is good.
    Repeated rows, ids and labels count as they stand; labels of unknown ids are ignored.  Texts of any
    length are read whole.  Columns of ``keep`` may have any names but those added.
    """
    return _judged(docs, labels, [c for c in keep if c not in ADDED], max_broadcast).select(
        "kept.own.*", F.col("n").alias("n_bytes"), F.exp("s").alias("perplexity"), F.exp("low").alias("perplexity_low"), F.exp("high").alias("perplexity_high"), "good")


def keep_good(docs: DataFrame, labels: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents that the classifier keeps; columns stay, whatever their names."""
    return _judged(docs, labels, docs.columns, max_broadcast).where("good").select("kept.own.*")


def _judged(docs: DataFrame, labels: DataFrame, keep: list[str], max_broadcast: int) -> DataFrame:
    """``kept`` (a struct with ``own``, the columns ``keep``), ``n, s, low, high, good`` of every row."""
    trusted = cut(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    ids = F.broadcast(trusted) if trusted.count() <= max_broadcast else trusted
    held_out = F.pmod(F.xxhash64(whole("text")), F.lit(FOLDS)) == 0
    tag = (F.coalesce("lang", F.lit("")).alias("lang"), held_out.alias("held_out"))
    model = train(docs.select("doc_id", "text").where(~held_out).join(ids, "doc_id", "left_semi"))
    known = score(docs.join(ids, "doc_id", "left_semi").select(F.struct(*tag).alias("kept"), "text"), model, max_broadcast)
    known = cut(known.where("n > 0").select("kept.lang", "kept.held_out", "n", "lp"))
    fresh = known.where("held_out").withColumn("rate", -F.col("lp") / F.col("n"))
    usual = _by_lang(fresh, "usual", F.percentile_approx("rate", 0.5, 10_000))
    calm = _with(known, usual, "usual").withColumn("s", _surprise(F.col("usual")))
    high = _by_lang(calm.where("held_out"), "high", _limit(HIGH))
    low = _by_lang(calm, "low", _limit(LOW))
    own = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("own")
    out = score(docs.select(F.struct(own, tag[0]).alias("kept"), "text"), model, max_broadcast).withColumn("lang", F.col("kept.lang"))
    model.discard()  # the tasks have it, or its answers are written
    for table, name in ((usual, "usual"), (low, "low"), (high, "high")):
        out = _with(out, table, name)
    out = out.withColumn("s", F.coalesce(_surprise(F.col("usual")), F.lit(0.0)))
    good = F.col("high").isNull() | (F.col("n") == 0) | F.col("s").between(F.col("low"), F.col("high"))
    return out.select("kept", "n", "s", "low", "high", good.alias("good"))


def _limit(share: float) -> Column:
    """The quantile of ``s`` in a group, moved away from the median by what few documents leave uncertain."""
    q = F.percentile_approx("s", [0.5, share], 10_000)
    return q[1] + 0.5 * F.sqrt(LEAST / F.count("*")) * (q[1] - q[0])


def _by_lang(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``lang, <name>`` of each language with enough rows, and of all rows under null."""
    both = lambda by: by.agg(value.alias(name), F.count("*").alias("of"))
    every = both(rows.groupBy("lang")).where(F.col("of") >= LEAST).unionByName(both(rows).select(F.lit(None).cast("string").alias("lang"), name, "of"))
    return cut(every.select("lang", name))


def _with(rows: DataFrame, by_lang: DataFrame, name: str) -> DataFrame:
    """``rows`` with the value of their language, or else of all; Spark sends the small table to the tasks."""
    own = by_lang.where("lang is not null").select(F.col("lang").alias("of_lang"), F.col(name).alias("own_value"))
    all_ = by_lang.where("lang is null").select(name).first()
    rest = F.lit(None if all_ is None else all_[0]).cast("double")
    joined = rows.join(own, F.col("lang") == F.col("of_lang"), "left")
    return joined.withColumn(name, F.coalesce("own_value", rest)).drop("of_lang", "own_value")
