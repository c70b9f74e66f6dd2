"""Secrets in texts, by an incremental ledger of blobs, built-in functions only.

A text is a blob named by its SHA-256.  The ledger holds, for each blob and rule version that were
scanned, what was found.  Only blobs that the ledger lacks are scanned, once however many paths
hold them, and findings are joined back to every path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.text import whole
from trellis.plans.lineage import cut

VERSION = 1


@dataclass(frozen=True)
class Kind:
    """A kind of secret: expression, prefilter, how long a group must be, and what the whole match must look like.

    No expression may repeat a group (the JVM takes a call for each repetition) or begin again inside what it has passed
    over in vain: a kind whose parts could be long runs matches the whole run, and ``check`` judges it once.
    """

    name: str
    regex: str
    keywords: tuple[str, ...]
    group: int = 0
    least: int = 1
    base: bool = False
    check: str = ""


#: The kinds that are always reported, in the order of ties.
BASE = [
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 8, True),
    Kind("access", "AKIA[A-Z0-9]+", ("akia",), 0, 16, True),
    Kind("hex", "[0-9a-f]{32,}", (), 0, 32, True),
]

#: Kinds of this module's own.
MORE = [
    Kind("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
    Kind("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Kind("cloud_key", "AIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Kind("payment_key", "[sr]k_live_[0-9A-Za-z]{16,}", ("k_live_",)),
    Kind("web_token", r"[A-Za-z0-9_.-]{29,}", ("eyj",), check=r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.?$"),
]


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def _gate(low: Column, text: Column, kinds: list[Kind]) -> Column:
    """Whether a text may hold any kind; cheap tests come first."""
    out = F.exists(F.array(low), lambda x: _any(x, [w for kind in kinds for w in kind.keywords]))
    for kind in kinds:
        if not kind.keywords:
            out = out | text.rlike(kind.regex)
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: Kind, nth: int) -> str:
    """SQL for the spans of one kind in ``text``: leftmost, not overlapping, code points from 0.

    Matches are added up in blocks of about the square root of their number: an array that grows by one is copied each time.
    """
    regex = _quoted(kind.regex)
    gate = " or ".join(f"contains(low, '{w}')" for w in kind.keywords) or "true"
    span = "struct<start:int,nth:int,stop:int,len:int>"
    held = f"if(x.m[i] rlike {_quoted(kind.check)}, length(x.g[i]), 0)" if kind.check else "length(x.g[i])"
    return f"""case when {gate} then transform(array(named_struct('s', split(text, {regex}, -1),
        'm', regexp_extract_all(text, {regex}, 0), 'g', regexp_extract_all(text, {regex}, {kind.group}))), x -> case when size(x.m) = 0 then null else filter(flatten(
      aggregate(sequence(0, cast(sqrt(size(x.m) - 1) as int)), named_struct('upto', 0, 'out', cast(array() as array<array<{span}>>)),
        (a, b) -> aggregate(filter(sequence(b * cast(ceil(sqrt(size(x.m))) as int), (b + 1) * cast(ceil(sqrt(size(x.m))) as int) - 1), i -> i < size(x.m)),
          named_struct('upto', a.upto, 'out', cast(array() as array<{span}>)),
          (c, i) -> named_struct('upto', c.upto + length(x.s[i]) + length(x.m[i]),
            'out', concat(c.out, array(named_struct('start', c.upto + length(x.s[i]), 'nth', {nth}, 'stop', c.upto + length(x.s[i]) + length(x.m[i]), 'len', {held})))),
          c -> named_struct('upto', c.upto, 'out', concat(a.out, array(c.out)))),
        a -> a.out)), y -> y.len >= {kind.least}) end)[0] end"""


def scan_blobs(blobs: DataFrame, kinds: list[Kind]) -> DataFrame:
    """``blob, spans``; a span is (start, nth, kind, stop), nth the kind's number, sorted by start and nth."""
    none = "cast(array() as array<struct<start:int,nth:int,stop:int,len:int>>)"
    low = blobs.withColumn("low", F.lower("text"))
    every = "concat(" + ", ".join(f"coalesce({_spans(k, i)}, {none})" for i, k in enumerate(kinds)) + f", {none})"
    names = "array(" + ", ".join(f"'{k.name}'" for k in kinds) + ")"
    return low.select("blob", F.expr(f"transform(array_sort({every}), y -> named_struct('start', y.start, 'nth', y.nth, 'kind', {names}[y.nth], 'stop', y.stop))").alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, kinds: list[Kind] | None = None, version: int = VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings per document, and the rows that the ledger gains.

    ``ledger`` holds ``blob`` (binary), ``version`` and ``spans``; blobs in it at this version are
    not scanned again.  The first result has ``doc_id, blob, spans`` for every row (repeated rows
    and null ids keep theirs; a null text is the empty blob).  A blob that the ledger holds more than
    once at a version counts once, by any of its rows.  The second has the ledger's
    columns, one row for each blob that was new, with no spans where nothing was found.
    """
    kinds = BASE + MORE if kinds is None else kinds
    blob = F.unhex(F.sha2(whole("text").cast("binary"), 256))
    paths = docs.select("doc_id", blob.alias("blob"))
    fresh = docs.select(blob.alias("blob"), whole("text").alias("text"))
    fresh = fresh.where(_gate(F.lower("text"), F.col("text"), kinds))
    seen = None if ledger is None else ledger.where(F.col("version") == version).dropDuplicates(["blob"])
    if seen is not None:
        fresh = fresh.join(seen.select("blob"), "blob", "left_anti")
    found = cut(scan_blobs(fresh.dropDuplicates(["blob"]), kinds).where(F.size("spans") > 0))
    known = found if seen is None else found.unionByName(seen.select("blob", "spans").where(F.size("spans") > 0))
    # Findings come from a written table, so both sides are shuffled afresh and adaptive execution
    # can split a blob that many paths hold.
    findings = paths.join(known, "blob", "left")
    gained = paths.select("blob").distinct()
    if seen is not None:
        gained = gained.join(seen.select("blob"), "blob", "left_anti")
    gained = gained.join(found, "blob", "left").select("blob", F.lit(version).alias("version"), F.coalesce("spans", F.filter("spans", lambda x: F.lit(False))).alias("spans"))
    return findings, gained
