"""The registered queries of this subpackage, and their DuckDB equivalents where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import decontamination, divergence, extraction, licenses, linededup, neighbours, packing, periods, quality, secrets, sharding, simhash, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.byte_shards(_table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard"), "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = simhash.with_smallest_id(simhash.near_duplicates(_table(spark, sf_dir, "documents")))
    return members.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.detect(_table(spark, sf_dir, "documents")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(_table(spark, sf_dir, "documents"))
    base = [k.name for k in secrets.BASE]
    listed = "transform({}, x -> concat(x.kind, ':', x.start, ':', x.stop))"
    count = "coalesce(size(filter(spans, x -> x.kind = '{}')), 0)"
    return found.select(
        "doc_id", *(F.expr(count.format(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(F.coalesce(F.expr(f"array_join({listed.format(f'filter(spans, x -> x.nth < {len(base)})')}, ',')"), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(F.expr(f"array_join({listed.format('spans')}, ',')"), F.lit("")).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_bytes", "perplexity", "perplexity_low", "perplexity_high", F.col("good").alias("keep"))


#: The rules of the registered query (fixed values).
URL_RULES = [
    urlfilter.UrlRule("block", "com", "/en/"),
    urlfilter.UrlRule("allow", "example.com", "/en/7"),
    urlfilter.UrlRule("allow", "net", "/de/"),
    urlfilter.UrlRule("block", "example.net", "/de/8"),
    urlfilter.UrlRule("block", "org", "/es/"),
]


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rules_frame(spark, URL_RULES))
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.find_runs(periods.with_planted_tails(_table(spark, sf_dir, "documents")))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.extract(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_linededup": op7_linededup,
    "op8_quality": op8_quality,
    "op9_urlfilter": op9_urlfilter,
    "op10_neighbours": op10_neighbours,
    "op11_periods": op11_periods,
    "op12_divergence": op12_divergence,
    "op13_extraction": op13_extraction,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_oracle() -> str:
    rules = ", ".join(
        f"({i}, {_sql(r.label)}, {_sql(r.regex)}, [{', '.join(map(_sql, r.keywords))}], {r.priority}, {r.confidence}::double, {str(r.base).lower()})"
        for i, r in enumerate(licenses.default_rules()))
    return f"""
WITH rules(nth, label, re, keys, priority, conf, base) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
norm AS (SELECT r, w, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM d WHERE len(w) > 0),
cut AS (SELECT r, rules.* EXCLUDE (keys), string_split_regex(norm, re) AS s, regexp_extract_all(norm, re) AS m FROM norm, rules
        WHERE len(list_filter(keys, lambda k: NOT list_has_any(w, string_split(k, '|')))) = 0 AND regexp_matches(norm, re)),
n AS (SELECT *, list_transform(s, lambda x: len(regexp_replace(x, '[^ ]', '', 'g')) // 2) AS sn,
             list_transform(m, lambda x: len(regexp_replace(x, '[^ ]', '', 'g')) // 2) AS mn, unnest(range(1, len(m) + 1)) AS i FROM cut),
hit AS (SELECT r, nth, label, priority, conf, base,
               (list_sum(sn[1:i]) + coalesce(list_sum(mn[1:i - 1]), 0))::bigint AS a, mn[i] AS len FROM n),
kept AS (SELECT * FROM hit h WHERE base OR NOT EXISTS (SELECT 1 FROM hit e WHERE e.r = h.r AND e.a <= h.a AND e.a + e.len >= h.a + h.len
         AND (e.priority > h.priority OR e.priority = h.priority AND (e.len > h.len OR e.len = h.len AND e.nth < h.nth)))),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        max(conf) AS score FROM kept GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::double AS score
FROM d LEFT JOIN per USING (r)"""


def _secret_oracle() -> str:
    kinds = secrets.BASE + secrets.MORE
    parts = " UNION ALL ".join(
        f"SELECT r, {i} AS nth, {_sql(k.name)} AS kind, {k.least} AS least, {_sql(k.check or '')} AS looks, string_split_regex(t, {_sql(k.regex)}) AS s, "
        f"regexp_extract_all(t, {_sql(k.regex)}) AS m, regexp_extract_all(t, {_sql(k.regex)}, {k.group}) AS g FROM d" for i, k in enumerate(kinds))
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {_sql(k.name)}), 0)::bigint AS n_{k.name}" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({parts}),
one AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut WHERE len(m) > 0),
span AS (SELECT r, nth, kind, (list_sum(list_transform(s[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::bigint AS a,
                len(m[i]) AS n FROM one WHERE len(g[i]) >= least AND regexp_matches(m[i], looks)),
per AS (SELECT r, {counts},
               string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, nth) FILTER (nth < {len(secrets.BASE)}) AS base,
               string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, nth) AS spans FROM span GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k.name}, 0) AS n_{k.name}' for k in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)"""


def _url_oracle() -> str:
    rules = ", ".join(f"({_sql(r.verdict)}, {_sql(r.host)}, {_sql(r.path)})" for r in URL_RULES)
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT r, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY len(rhost || rpath) DESC, len(rhost) DESC, verdict DESC) AS nth
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE nth = 1) USING (r)"""


ORACLES: dict[str, str] = {
    "op1_licenses": _license_oracle(),
    "op2_secrets": _secret_oracle(),
    "op9_urlfilter": _url_oracle(),
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::hugeint AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::hugeint AS v, sum(n)::hugeint AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::hugeint AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT lang, source, sum(n)::hugeint AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(m.n, 0) + v.v) AS p, 1 + 1000000000 * (k.n + 1) // (v.n + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN m USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::bigint AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM r) WHERE part = 'pair' OR rank <= 200""",
    "op3_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
lens AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lens)),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT r, p.n, i, item_id FROM places p JOIN wins USING (win, n)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, item_id::varchar AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op7_linededup": """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, trim(ls[i]) || chr(10) || trim(ls[i + 1]) || chr(10) || trim(ls[i + 2]) AS win
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM w
          WHERE replace(win, chr(10), '') <> '') WHERE nth > 1),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM later) GROUP BY doc_id)
SELECT doc_id, len(ls)::bigint AS n_lines, coalesce(len(ks), 0)::bigint AS n_removed,
       CASE WHEN ks IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda k: NOT list_contains(ks, k)), lambda k: ls[k]), chr(10)), '') END AS text
FROM d LEFT JOIN gone USING (doc_id)""",
}
