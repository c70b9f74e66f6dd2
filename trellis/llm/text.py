"""Column expressions on texts, free of Python in tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pattern: what stands between words, ASCII other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed pattern: a word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; case as it is."""
    return F.array_remove(F.split(text, GAP), "")


def whole(text: Column | str) -> Column:
    """A text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_hash(text: Column | str) -> Column:
    return F.xxhash64(whole(text))


def row_key(text: Column | str = "text", doc_id: str = "doc_id") -> Column:
    """A struct of text hash and id, in which null ids are equal.

    Its fields may be null, as those of a table that is read are; otherwise a join would cast the key, and
    what follows could not use the join's shuffle.
    """
    return F.struct(F.nullif(text_hash(text), F.lit(None)).alias("th"), F.col(doc_id).alias("doc_id"))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row.

    A plain alias may be copied into the filters and lambdas that read it, and then be computed for
    every element; a generator's output may not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that none of the columns ``taken`` has in any case of letters."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
