"""Repeated lines by overlapping three-line windows, built-in functions only.

Each window of three consecutive lines is hashed; the first occurrence of a window in the whole
table stays, and all lines that a later occurrence covers are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.text import free_name, row_key, text_hash, whole
from trellis.plans.lineage import cut

SPAN = 3


def _lines(text: str = "text") -> Column:
    return F.split(whole(text), "\n")


def _windows(docs: DataFrame) -> DataFrame:
    """``(h1, h2, at)``: a 128-bit hash of each window and where it stands.

    Lines are compared without the spaces around them; a window of blank lines is none.
    """
    rows = docs.select("doc_id", text_hash("text").alias("th"), F.transform(_lines(), lambda x: F.trim(x)).alias("ls")).where(F.size("ls") >= SPAN)
    each = rows.select("doc_id", "th", F.posexplode(F.expr(
        f"transform(sequence(1, size(ls) - {SPAN} + 1), i -> struct(xxhash64(slice(ls, i, {SPAN})) as h1, "
        f"xxhash64('window', slice(ls, i, {SPAN})) as h2, array_join(slice(ls, i, {SPAN}), '') = '' as blank))")).alias("pos", "w"))
    return each.where("not w.blank").select("w.h1", "w.h2", F.struct("doc_id", "th", "pos").alias("at"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, starts)``: for each document that holds a later occurrence of a window, the
    lines (from 0) at which one starts.  The order is by doc_id (nulls first), text hash and line.
    Rows that repeat an id and its text have one result, that of the first of them.
    """
    wins = _windows(docs)
    # Grouped with a partial minimum, so that a window that stands everywhere is one row a task.
    first = cut(wins.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = wins.join(first, ["h1", "h2"]).where(~F.col("at").eqNullSafe(F.col("first")))
    return later.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th")).agg(F.collect_set("at.pos").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines left in ``text``, ``n_lines`` and ``n_removed`` (longs).

    Lines end at a line feed.  A document of fewer than three lines holds no window and stays as
    it is; a null text has one empty line and stays null.  A document whose lines all go keeps
    its row, with an empty text.  Every row is a document: of rows that repeat an id (or null) and its text the
    second and later ones lose all their windows.  Other columns pass through whatever their names; ones of the added names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    taken = [*docs.columns, "n_lines", "n_removed"]
    key, other, starts, lines, nth, left = (taken.append(free_name(n, taken)) or taken[-1] for n in ("of", "of_gone", "starts", "lines", "nth", "left_lines"))
    # A struct, so that null ids are equal, and that join and numbering share one shuffle.
    gone = cut(covered_lines(docs)).select(F.struct("th", "doc_id").alias(other), F.col("starts").alias(starts))
    gone = gone.hint("merge")  # one plan at every size: what is gone grows with the documents
    rows = docs.withColumn(key, row_key())
    both = rows.join(gone, F.col(key) == F.col(other), "left").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    both = both.withColumn(lines, _lines())
    all_ = (f"filter(sequence(0, size({lines}) - {SPAN}), i -> array_join(transform(slice({lines}, i + 1, {SPAN}), x -> trim(x)), '') <> '')")
    both = both.withColumn(starts, F.expr(f"case when {nth} > 1 and size({lines}) >= {SPAN} then nullif({all_}, array()) else {starts} end"))
    reach = ", ".join(f"transform({starts}, s -> s + {k})" for k in range(SPAN))
    both = both.withColumn(left, F.expr(
        f"case when {starts} is not null then array_except(sequence(0, size({lines}) - 1), concat({reach})) end"))
    text = F.expr(f"array_join(transform({left}, i -> {lines}[i]), '\n')")
    return both.select(
        *(F.when(F.col(starts).isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in kept),
        F.size(lines).cast("long").alias("n_lines"), F.when(F.col(starts).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long").alias("n_removed"))
