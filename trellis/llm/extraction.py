"""Main texts of web pages, by paths that the pages of a host agree on.

Each page's containers are scored, and its best one votes for its path of tags and classes, in which numbers are
generalised.  Votes are counted by host in Spark; each page is then read again with its host's winning paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm import markup
from trellis.llm.text import ascii_lower, free_name, whole
from trellis.plans.lineage import cut

#: A path wins if it has this part of its host's votes; so at most ten do.
SHARE = 0.1


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, small; empty where there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, score`` of the best container of every page that has one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                page = markup.read(html.as_py())
                at, score = markup.best(page)
                if at:
                    hosts.append(host.as_py())
                    paths.append(markup.path(page, at))
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    return pages.select(host_of(F.col("url")).alias("host"), whole("html").alias("html")).mapInArrow(scan, "host string, path string, score double")


def winners(pages: DataFrame, least: float = SHARE) -> DataFrame:
    """``host, paths``: the paths that have ``least`` of the host's votes or more, most votes first, then by name."""
    counted = cut(votes(pages).groupBy("host", "path").agg(F.count("*").alias("votes")))
    total = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    won = counted.join(total, "host").where(F.col("votes") >= F.lit(least) * F.col("all"))
    listed = won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("won"))
    return listed.select("host", F.col("won.path").alias("paths"))


def extract(pages: DataFrame, least: float = SHARE) -> DataFrame:
    """All columns of ``pages`` (page_id, url, html and any others, but for html) and ``text``, the main text of each page.

    A page gives the blocks under the first of its host's winning paths that it has and that holds any text; without one, those under its own best
    container.  Menus, headers of sites, footers, sidebars, notices, adverts, forms, scripts, styles, comments by readers and hidden
    parts are left out wherever they stand.  White space inside a block becomes one space, blocks are joined by an empty line.
    A page without any text has the text ''.  Null html is empty; pages without a host vote as one host; repeated rows and null ids keep
    theirs.  A column that is named ``text`` already is replaced.

    Winning paths, at most ten a host, are few against pages: Spark broadcasts them where their written size is below its
    threshold, and otherwise deals pages by host, large hosts split.
    """
    paths = cut(winners(pages, least))
    host, found, html = (free_name(n, pages.columns) for n in ("host", "paths", "whole"))
    keep = [c for c in pages.columns if c.lower() not in ("html", "text")]
    named = pages.select(*(F.col(f"`{c}`") for c in keep), host_of(F.col("url")).alias(host), whole("html").alias(html))
    dealt = named.join(paths.select(F.col("host").alias(host), F.col("paths").alias(found)), host, "left")

    @F.pandas_udf("string")
    def main_text(html, paths):
        return html.combine(paths, _main_text)

    return dealt.select(*(F.col(f"`{c}`") for c in keep), main_text(html, found).alias("text"))


def _main_text(html: str, paths) -> str:
    page = markup.read(html)
    if paths is not None:
        for roots in markup.matching(page, list(paths)):
            text = markup.text_of(page, roots) if roots else ""
            if text:
                return text
    return markup.text_of(page, [markup.best(page)[0]])
