"""How far the sources of a language differ in their words, from run-length encoded columns of counts.

Each source has one column: its count of every kept term of its language.  The vocabulary is put in an order in
which terms that occur equally often in the same sources stand together, so that columns become few runs.  For
each pair of sources the boundaries of both columns' runs are intersected, and the measure of a stretch is
multiplied by its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.text import whole
from trellis.plans.lineage import cut, discard

#: Parts of a whole that probabilities are counted in (fixed value).
SCALE = 1_000_000_000
#: Different terms that a task counts before it hands them on.
_HELD = 300_000
#: Terms of a block of the vocabulary, and sources whose columns are compared at once.
BLOCK, TILE = 4096, 64

#: Bytes of a text by what they are in a term: ASCII capitals become small, other ASCII than letters become spaces.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms, and of the documents that hold them, by language and source; sums of parts are handed on."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            terms = list(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(count.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = text.encode().translate(_TERM).split()
            count, docs = held.setdefault((lang, source), (Counter(), Counter()))
            count.update(terms)
            docs.update(set(terms))
        if sum(len(count) for count, _ in held.values()) > _HELD:
            yield from out()
            held = {}
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` by parts, to be summed; nulls are empty."""
    named = docs.select(whole("lang").alias("lang"), whole("source").alias("source"), whole("text").alias("text"))
    return named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exactly."""
    wide = "decimal(38,0)"
    # Integer division of decimals is exact, and its quotient at most SCALE.
    return 1 + F.call_function("div", ((n.cast("decimal(19,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")).cast(wide), (total + terms).cast(wide))


def measure(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exactly: p and q are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _blocks(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive terms of one language, at most ``most``, as run-length columns: ``lang, terms, columns``.

    A column is (source number, starts, counts) of a source that has any of the block's terms; each run
    ends where the next starts or the block ends.
    """
    kind = pa.list_(pa.struct([("source", pa.int32()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))
    lang, terms, columns = None, 0, {}

    def out() -> Iterator[pa.RecordBatch]:
        made = []
        for source, runs in columns.items():
            starts, counts, end = ([0], [0], 0) if runs[0][0] else ([], [], 0)
            for at, n in runs:
                if at > end and counts[-1]:  # terms without the source stand between
                    starts.append(end)
                    counts.append(0)
                if not counts or counts[-1] != n:
                    starts.append(at)
                    counts.append(n)
                end = at + 1
            if end < terms:
                starts.append(end)
                counts.append(0)
            made.append({"source": source, "starts": starts, "counts": counts})
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([terms], pa.int32()), pa.array([made], kind)], names=["lang", "terms", "columns"])

    for batch in rows:
        for own, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if terms and (own != lang or terms == most):
                yield from out()
                terms, columns = 0, {}
            lang = own
            for e in entries:
                columns.setdefault(e["source"], []).append((terms, e["n"]))
            terms += 1
    if terms:
        yield from out()


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The measure over a block's terms for every pair of its two tiles' sources, each way."""

    for batch in batches:
        out: dict[str, list] = {"lang": [], "a": [], "b": [], "value": []}
        for lang, terms, one, two, columns, sources in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = {c["source"]: (np.array(c["starts"], np.int64), c["counts"]) for c in columns}
            made = {}
            for s in sources:
                starts, counts = runs.get(s["source"], (np.zeros(1, np.int64), [0]))
                # Python's integers are exact whatever the counts; a run's share is at most SCALE + 1.
                made[s["source"]] = starts, np.array([1 + SCALE * (n + 1) // s["over"] for n in counts], np.int64)
            low = [s for s in made if s // TILE == one]
            high = [s for s in made if s // TILE == two]
            for a in low:
                starts_a, p = made[a]
                for b in high:
                    if one == two and a >= b:
                        continue
                    starts_b, q = made[b]
                    cuts = np.union1d(starts_a, starts_b)
                    length = np.diff(np.append(cuts, terms))
                    pa_, qb = (x[np.searchsorted(s, cuts, "right") - 1] for s, x in ((starts_a, p), (starts_b, q)))
                    square = (pa_ - qb) ** 2
                    for x, y, by in ((a, b, qb), (b, a, pa_)):
                        out["lang"].append(lang)
                        out["a"].append(x)
                        out["b"].append(y)
                        out["value"].append(int((square // by * length).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["a"], pa.int32()), pa.array(out["b"], pa.int32()), pa.array(out["value"], pa.int64())], names=list(out))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far sources differ from each other and from their language.

    Terms are runs of letters and of what is beyond ASCII, only A-Z lower-cased; a language keeps those of
    ``least_docs`` of its documents or more.  p is the share of a term in its source (``share``), add-one smoothed over the
    kept terms.  Part ``pair``: the sum of ``measure`` over all kept terms against each other source of the
    language, in all ranks (0 where no term is kept; none for the only source).  Part ``term``: the terms whose share in the source is beyond that in the
    language, with their measure, up to rank ``top``.  Ranks go by descending value, then by item.

    Null texts, languages and sources are empty ones, repeated rows are documents of their own, other columns play no part, and an empty table gives no rows.
    One row holds the sources of a language, and a result of all their pairs; the vocabulary is never held whole.
    """
    groups = docs.select(whole("lang").alias("lang"), whole("source").alias("source")).distinct()
    counts = cut(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    used = cut(counts.join(kept.select("lang", "term", "all"), ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    discard(counts)

    # Sources are numbered within their language; there are few against terms.
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole_of = used.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count("*").alias("terms"))
    named = groups.join(sums, ["lang", "source"], "left").join(whole_of, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    names = cut(named.select("lang", "source", number.alias("id"), F.coalesce("total", F.lit(0)).alias("total"), "lang_total", F.coalesce("terms", F.lit(0)).alias("terms")))

    # Terms of equal counts in the same sources stand together; equal ones are told apart by the term, so that none is hot.
    profile = used.join(names.select("lang", "source", "id"), ["lang", "source"]).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("source"), "n"))).alias("entries"))
    ordered = profile.repartitionByRange("lang", "entries", "term").sortWithinPartitions("lang", "entries", "term").select("lang", "entries")
    columns = cut(ordered.mapInArrow(lambda rows: _blocks(rows, block), "lang string, terms int, columns array<struct<source:int,starts:array<int>,counts:array<long>>>"))
    sources = names.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("source"), (F.col("total") + F.col("terms")).alias("over")))).alias("sources"))
    tiles = f"explode(flatten(transform(sequence(0, (size(sources) - 1) div {TILE}), i -> transform(sequence(i, (size(sources) - 1) div {TILE}), j -> struct(i as one, j as two)))))"
    dealt = columns.join(cut(sources), "lang").select("*", F.expr(tiles).alias("t"))
    near = f"filter({{}}, x -> x.source div {TILE} in (t.one, t.two))"
    dealt = dealt.select("lang", "terms", "t.one", "t.two", F.expr(near.format("columns")).alias("columns"), F.expr(near.format("sources")).alias("sources"))
    summed = dealt.mapInArrow(_pair_sums, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    one, two = (names.select("lang", F.col("source").alias(s), F.col("id").alias(k)) for s, k in (("source", "a"), ("item", "b")))
    pairs = one.join(two, "lang").where("a <> b").join(summed, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    shares = used.join(names, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), measure(F.col("p"), F.col("q")).alias("value"))
    # Spark keeps the first ranks of each task's rows before it deals them by source.
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
