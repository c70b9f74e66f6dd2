"""URL rules by host-suffix and path-prefix expressions matched on hash prefixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.text import free_name
from trellis.plans.lineage import cut

#: Rules that are sent to every task at most; a larger table is joined by shuffling.
MAX_BROADCAST = 1_000_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str  # empty, or begins with /


def rules_frame(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(rule: Column) -> Column:
    return F.sha2(rule.cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``verdict, host, path``.  A rule fits its host and all subdomains of it, and
    paths that start with its own.  The longest rule wins (by host and path together, then by
    host), and block wins a tie.  Each different URL is expanded once into its host's suffixes
    times its path's prefixes, of the lengths that rules have; an expression meets the rules on
    the first four bytes of its SHA-256, and the full digest confirms.  A URL without a rule gets
    ``default``; a null or malformed one has no host and path.  A rule without host or verdict fits
    nothing, one without path has an empty one.  Repeated rows stay; columns of the added names are replaced.
    """
    table = cut(rules.where("host is not null and verdict is not null").select(
        "verdict", F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), F.length("host").alias("host_len"),
        F.length(F.coalesce("path", F.lit(""))).alias("path_len"),
        F.concat_ws("\n", "host", F.coalesce("path", F.lit(""))).alias("expression"))
        .withColumn("digest", _digest(F.col("expression"))).withColumn("prefix", F.substring("digest", 1, 8)).drop("expression").distinct())
    u_, best_ = free_name("of_url", pages.columns), free_name("best_rule", pages.columns)
    lengths = sorted(r[0] for r in table.select("path_len").distinct().collect())  # numbers up to the longest rule's path
    host, path = split_url(F.col("u"))
    urls = pages.select(F.col(url).alias("u")).where(F.col(url).isNotNull()).distinct().select("u", host.alias("h"), path.alias("p")).where("h <> ''")
    tails = F.expr("transform(sequence(0, size(split(h, '[.]')) - 1), i -> array_join(slice(split(h, '[.]'), i + 1, size(split(h, '[.]'))), '.'))")
    wide = urls.select("u", "p", F.explode(tails).alias("t"))
    listed = ", ".join(map(str, lengths)) or "-1"
    wide = wide.select("u", F.explode(F.expr(f"transform(filter(array({listed}), n -> n between 0 and length(p)), n -> concat(t, '\n', left(p, n)))")).alias("x"))
    wide = wide.select("u", _digest(F.col("x")).alias("d")).withColumn("prefix", F.substring("d", 1, 8))
    near = wide.join(F.broadcast(table) if table.count() <= MAX_BROADCAST else table, "prefix").where("d = digest")
    best = cut(near.groupBy("u").agg(F.max(F.struct(
        F.length("rule").alias("n"), F.col("host_len").alias("hn"), (F.col("verdict") == "block").alias("blocks"), F.col("rule"), F.col("verdict"))).alias(best_)).withColumnRenamed("u", u_)).hint("merge")  # verdicts grow with the pages
    host, path = split_url(F.col(url))
    # Null urls meet nothing, and are dealt anew so that they do not fill one task.
    at = free_name("of_page", [*pages.columns, u_])
    dealt = pages.withColumn(at, F.coalesce(F.col(url), F.concat(F.lit("no url "), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))))
    return dealt.join(best, (F.col(at) == F.col(u_)) & F.col(url).isNotNull(), "left").select(
        *(F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")), host.alias("host"), path.alias("path"), F.col(f"{best_}.rule").alias("rule"),
        F.coalesce(f"{best_}.verdict", F.lit(default)).alias("verdict"))
