"""Periodic runs of words inside texts, by uniting classes of suffixes from long common prefixes to short.

The suffixes of a text's words are sorted, and neighbours in that order joined by edges as heavy as
their longest common prefix (LCP).  Edges are taken by descending LCP, as in Kruskal's algorithm: each
unites two classes of suffixes, whose ordered sets of positions are merged, the smaller into the larger.
Two positions i < j that become neighbours in a merged set at LCP l are one seed: the words from i on
repeat after d = j - i for d + l words, and since no member of the class lies between, d is the smallest
period.  A seed whose stretch cannot be extended to the left is a run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.text import whole

#: Places of an ordered set that stay in one list.
_PART = 1024
_SCHEMA = "doc_id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, text string"


class _Places:
    """An ordered set of positions, in lists of bounded length."""

    __slots__ = ("parts", "tops", "size")

    def __init__(self, first: int):
        self.parts, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part

    def add(self, x: int) -> None:
        at = bisect_left(self.tops, x)
        if at == len(self.tops):
            at -= 1
            self.tops[at] = x
        part = self.parts[at]
        insort(part, x)
        self.size += 1
        if len(part) > _PART:
            half = len(part) // 2
            self.parts[at : at + 1] = [part[:half], part[half:]]
            self.tops[at : at + 1] = [part[half - 1], part[-1]]

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The members before and after ``x``, which is one itself."""
        at = bisect_left(self.tops, x)
        part = self.parts[at]
        i = bisect_left(part, x)
        before = part[i - 1] if i else self.parts[at - 1][-1] if at else None
        after = part[i + 1] if i + 1 < len(part) else self.parts[at + 1][0] if at + 1 < len(self.parts) else None
        return before, after


def suffix_edges(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, lcp``: neighbours in the order of suffixes that share ``least`` words or more, by descending LCP.

    Suffixes are sorted by doubling; the ranks of each step then give LCPs by descent.
    """
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, step = [], 1
    while True:
        levels.append(np.append(rank, -1).astype(np.int32 if n < 2**31 else np.int64))
        if rank.max(initial=-1) == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        step *= 2
    order = np.argsort(rank)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # Equal ranks at a step are equal words in full: no two suffixes end within the same ones.
        same = levels[k][np.minimum(a + lcp, n)] == levels[k][np.minimum(b + lcp, n)]
        lcp[same] += 1 << k
    some = np.flatnonzero(lcp >= least)
    some = some[np.argsort(-lcp[some], kind="stable")]
    return a[some], b[some], lcp[some]


def word_runs(words: list, least_exponent: int = 4, least_length: int = 6) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``words`` that is ``least_exponent`` periods and ``least_length`` words long, sorted."""
    # A run repeats its first words after one period: the part that is repeated is this long at least.
    least = min(max((least_exponent - 1) * q, least_length - q) for q in range(1, max(least_length, 2)))
    n = len(words)
    if n < max(least_length, least_exponent):
        return []
    grams = n - least + 1
    if len(set(zip(*(words[k : k + grams] for k in range(least)), strict=True))) == grams:
        return []  # no stretch of that length is repeated
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    top: dict[int, int] = {}
    places: dict[int, _Places] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = top[up]
            x = up
        return x

    found = []
    for a, b, lcp in zip(*(x.tolist() for x in suffix_edges(codes, least)), strict=True):
        a, b = find(a), find(b)
        large, small = places.pop(a, None) or _Places(a), places.pop(b, None) or _Places(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        top[b] = a
        places[a] = large
        new = set(small)
        for x in new:
            large.add(x)
        for x in new:
            before, after = large.around(x)
            for i, j in ((before, x), (x, after)):
                if i is None or j is None or i in new and j in new:
                    continue
                d = j - i
                if lcp >= (least_exponent - 1) * d and lcp + d >= least_length and (i == 0 or words[i - 1] != words[j - 1]):
                    found.append((i, d + lcp, d))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact quotient of length and period; the first one, then the shortest period, of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:  # runs come by start, then period
            best = run
    return best


def find_runs(docs: DataFrame, least_exponent: int = 4, least_length: int = 6) -> DataFrame:
    """``doc_id, n_words, runs, best, text`` for every row of ``docs``.

    Words are what stands between ASCII white space.  A run is a stretch of words with smallest period q, at
    least ``least_exponent`` times q and ``least_length`` words long, that neither neighbour extends; runs come by start and
    period.  ``best`` is that of the greatest exponent (null without runs), and ``text`` the words outside
    the later periods of all runs, joined by single spaces.  A null or blank text has no words and the text ''.
    Repeated rows and null ids keep theirs; other columns play no part.  Texts are taken one by one in whole, so
    nothing is shuffled; work is n log n in a text's words, whatever they repeat.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            counts, runs, best, texts = [], [], [], []
            for text in batch.column(1):
                words = text.as_py().encode().split()
                own = word_runs(words, least_exponent, least_length)
                named = [dict(zip(("start", "length", "period"), r, strict=True)) for r in own]
                top = strongest(own)
                counts.append(len(words))
                runs.append(named)
                best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                texts.append(b" ".join(collapsed(words, own)))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "best", "text"])

    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(scan, _SCHEMA.format(kind))


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where about every tenth document's tail repeats with a period.

    With h the unsigned CRC-32 of the decimal id, g = h // 10 and n words: where h is a multiple of 10 and n > 0, each word from
    a = g mod n on becomes that of a + (i - a) mod p, p = 1 + (n - a) // (3 + g mod 8).  A document without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(whole("text"), r"[\x20\x09-\x0D]+"), "")
    made = docs.select("doc_id", "text", h.alias("h"), F.expr("null").cast("array<string>").alias("none")).withColumn("w", F.when(F.col("h") % 10 == 0, words).otherwise(F.col("none")))
    # One level a select: each value is then computed once a row.
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    made = made.select("doc_id", "text", "w", n.alias("n"), g.alias("g"))
    made = made.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    made = made.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    at: Column = F.expr("transform(w, (x, i) -> case when i < a then x else w[cast(a + (i - a) % p as int)] end)")
    return made.select("doc_id", F.when(F.col("n") > 0, F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))
