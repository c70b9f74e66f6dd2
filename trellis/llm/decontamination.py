"""Benchmark passages in training texts: a broadcast hash set of test n-grams, built-in functions only.

A window is ``width`` consecutive words of a benchmark item; an item with fewer is one window.
Every window of L words holds a gram of g = ceil(L / 2) words that starts on any grid of stride
L - g + 1, so a document is first looked up at its grid positions alone, in the hash set of all
grams of the items.  Documents that meet it are scanned at every position in the hash set of
windows, and each hit is verified word for word by an equi-join, which also names the items.
The sets are hash tables of Spark's broadcast joins while they are within a checked size; the same
joins are shuffled beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.text import WORD, ascii_lower, free_name, held, text_hash, whole, words
from trellis.plans.lineage import cut

#: Hashes (8 bytes each) that are sent to every task at most.
MAX_BROADCAST = 4_000_000


def windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``(win, length, items)``: the different windows, their words, and the ids of their items."""
    item = benchmark.select("item_id", words(ascii_lower(whole("text"))).alias("w")).where(F.size("w") > 0)
    item = item.select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("n"))
    each = item.select("item_id", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("s"))
    return each.groupBy(F.array_join("s", " ").alias("win"), F.col("n").alias("length")).agg(F.collect_set("item_id").alias("items"))


def _shape(length: int) -> tuple[int, int]:
    gram = -(-length // 2)
    return gram, length - gram + 1


def _hashes(step: int, width: int, length: int, test: str = ">=") -> str:
    """SQL for (pos, len, h) of every ``step``-th run of ``width`` words of the array ``w``, for windows of ``length``."""
    return (f"case when size(w) {test} {length} then transform(sequence(1, size(w) - {width} + 1, {step}), "
            f"i -> struct(i as pos, {length} as len, xxhash64({length}, slice(w, i, {width})) as h)) end")


def _each(texts: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """``key, pos, len, h`` of the arrays that ``parts`` make of the words ``w``."""
    none = "cast(array() as array<struct<pos:int,len:int,h:bigint>>)"
    every = "concat(" + ", ".join(f"coalesce({p}, {none})" for p in parts) + f", {none})"
    return texts.select(key, F.explode(F.expr(every)).alias("x")).select(key, "x.pos", "x.len", "x.h")


def _sent(hashes: DataFrame, most: int) -> DataFrame:
    return F.broadcast(hashes) if hashes.count() <= most else hashes


def hits(docs: DataFrame, wins: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``th, pos, len, items``: where the windows ``wins`` occur in different texts of ``docs``, by text hash."""
    lengths = sorted(r[0] for r in wins.select("length").distinct().collect())  # 1 to the width
    text = docs.select(text_hash("text").alias("th"), whole("text").alias("t"))
    if not lengths:
        return text.select("th", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast(wins.schema["items"].dataType).alias("items")).where("false")
    split = lambda rows: held(rows, "w", words(ascii_lower(F.col("t")))).select("th", "w")
    own = wins.select(F.monotonically_increasing_id().alias("n"), "length", F.split("win", " ").alias("w"))
    grams = cut(_each(own, "n", [_hashes(1, _shape(n)[0], n, "=") for n in lengths]).select("h").distinct())
    full = cut(_each(own, "n", [_hashes(1, n, n, "=") for n in lengths]).select("h").distinct())
    grid = _each(split(text), "th", [_hashes(_shape(n)[1], _shape(n)[0], n) for n in lengths])
    hot = cut(grid.join(_sent(grams, max_broadcast), "h", "left_semi").select("th").distinct())
    every = _each(split(text.join(hot, "th", "left_semi")), "th", [_hashes(1, n, n) for n in lengths])
    places = cut(every.join(_sent(full, max_broadcast), "h", "left_semi").groupBy("th").agg(F.collect_set(F.struct("pos", "len")).alias("at")))
    # Copies of a text are read once here: their rows agree.
    tried = split(text.join(places, "th", "left_semi")).join(places, "th").select("th", F.explode(F.expr(
        "transform(at, a -> struct(a.pos as pos, a.len as len, array_join(slice(w, a.pos, a.len), ' ') as win))")).alias("x"))
    tried = tried.select("th", "x.pos", "x.len", "x.win").distinct()
    return tried.join(wins.select("win", "items"), "win").select("th", "pos", "len", "items")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document: ``doc_id, th, n_words, n_hit, n_items, items, spans``.

    ``th`` is a hash of the text.  ``spans`` are the occurrences (pos from 1, len) in words, sorted; a word inside any of them
    counts in ``n_hit``; ``items`` are the ids, as sorted strings, of the items that have any.
    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A null text has
    no words, a null id keeps its row, repeated rows are separate documents, an empty benchmark
    hits nothing.  Other columns of ``docs`` are not read.
    """
    met = hits(docs, cut(windows(benchmark, width)), max_broadcast)
    met = met.groupBy("th").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"),
                                F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("items").cast("array<string>"))))).alias("items"))
    fold = """aggregate(spans, struct(0 as upto, 0L as n), (s, x) -> struct(greatest(s.upto, x.pos + x.len - 1) as upto,
              s.n + greatest(0, x.pos + x.len - 1 - greatest(s.upto, x.pos - 1)) as n), s -> s.n)"""
    met = cut(met.select("th", "spans", "items", F.expr(fold).alias("n_hit")))
    rows = docs.select("doc_id", text_hash("text").alias("th"), F.size(words(whole("text"))).cast("long").alias("n_words"))
    none = lambda c: F.coalesce(c, F.array().cast(met.schema[c].dataType)).alias(c)
    return rows.join(met, "th", "left").select(
        "doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), none("items"), none("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.0, width: int = 10, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` without benchmark passages; columns stay, whatever their names.

    A document whose share of hit words exceeds ``drop_share`` goes; in others the hit words are
    cut from the text, each with the gap behind it.  With 0 every hit document goes.  Null texts, null
    ids and repeated rows stay, unless they are hit.
    """
    met = hits(docs, cut(windows(benchmark, width)), max_broadcast)
    th, at = free_name("hit_text", docs.columns), free_name("hit_places", docs.columns)
    met = cut(met.groupBy(F.col("th").alias(th)).agg(F.collect_set(F.struct("pos", "len")).alias(at)))
    if drop_share <= 0:
        return docs.join(met, text_hash("text") == F.col(th), "left_anti")
    joined = docs.join(met, text_hash("text") == F.col(th), "left")
    own, left, gaps = (free_name(n, joined.columns) for n in ("hit_words", "hit_left", "hit_gaps"))
    hit = F.col(at).isNotNull()

    def when(value: Column) -> Column:
        return F.when(hit, value)

    marked = held(joined, own, when(words(whole("text"))))
    covered = f"flatten(transform({at}, s -> sequence(s.pos, s.pos + s.len - 1)))"
    marked = held(marked, left, when(F.expr(f"array_except(sequence(1, size({own})), {covered})")))
    marked = held(marked, gaps, when(F.split(whole("text"), WORD)))
    kept = marked.where(~hit | (F.size(own) - F.size(left) <= drop_share * F.size(own)))
    text = F.expr(f"concat({gaps}[0], array_join(transform({left}, i -> concat({own}[i - 1], {gaps}[i])), ''))")
    return kept.select(*(F.when(hit, text).otherwise(F.col(c)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
