"""Periodic runs, the audit of sources and the extraction of pages, against brute force and at the edges."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from trellis.llm import divergence, extraction, markup, periods
from trellis.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, texts):
    made = spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts)], SCHEMA)
    for c in ("n", "w", "runs", "best", "h", "a", "p", "term", "rank", "id"):
        made = made.withColumn(c, F.lit("clash"))
    return made


# Periodic runs


def slow_runs(w, exponent=4, length=6):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            whole = j + q - i
            if whole >= max(length, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, i + whole - p)) for p in range(1, q)):
                out.append((i, whole, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("exponent", "length"), [(4, 6), (2, 2), (3, 5)])
def test_runs_are_those_of_brute_force(exponent, length):
    rng = random.Random(exponent)
    for _ in range(1500):
        n, k = rng.randrange(60), rng.choice([1, 2, 2, 3, 5])
        w = [str(rng.randrange(k)) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert periods.word_runs(w, exponent, length) == slow_runs(w, exponent, length), w


def test_runs_of_long_repetitive_texts():
    assert periods.word_runs(["a"] * 100_000) == [(0, 100_000, 1)]
    assert periods.word_runs([str(i % 997) for i in range(50_000)]) == [(0, 50_000, 997)]
    one, two = "0", "01"
    while len(two) < 20_000:
        one, two = two, two + one
    assert periods.word_runs(list(two)) == []  # Fibonacci words hold no fourth powers


def op11_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_rows(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "a " * 50, "a b c\x0b" * 9, "x y z " * 6, "É " * 6, "a " * 5]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 120))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 9), (None, None), (4, "a " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periods"](spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter((i, *op11_row(i, t)) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_runs_of_no_rows_and_of_clashing_columns(spark):
    assert periods.find_runs(frame(spark, ["x"]).limit(0)).collect() == []
    (row,) = periods.find_runs(periods.with_planted_tails(frame(spark, ["a b " * 5]))).collect()
    assert row.n_words == 10 and row.text


# The audit of sources


def audited(spark, tmp_path, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(want.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLES['op12_divergence']})").fetchall())
    got = sorted(tuple(r) for r in divergence.audit(spark.read.parquet(f"{tmp_path}/documents.parquet"), **more).select("lang", "source", "part", "item", "value", "rank").collect())
    return got, want


@pytest.mark.parametrize("block", [3, 4096])
def test_audit_is_that_of_sql(spark, tmp_path, block):
    rng = random.Random(8)
    vocabulary = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "é", "漢字", "ß🙂"]
    rows = []
    for i in range(200):
        words = [rng.choice(vocabulary[: rng.choice([20, 304])]) for _ in range(rng.randrange(60))]
        rows.append((i, rng.choice([" ", "\n", "1", "--"]).join(words).title() if i % 7 else None, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "É"])))
    rows += [(900, "Hot hot HOT\x00hot", "en", "a")] * 5 + [(901, "once", "xx", "p"), (902, None, "xx", "q"), (903, "only source", "yy", "p")]
    got, want = audited(spark, tmp_path, rows, block=block)
    assert got == want and any(r[2] == "pair" and r[0] == "xx" and r[4] == 0 for r in got)


def test_audit_of_more_sources_than_a_tile(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(9)), "en", f"s{i % 70}") for i in range(300)]
    got, want = audited(spark, tmp_path, rows)
    assert got == want and len(got) > 70 * 69


def test_audit_of_no_rows_and_of_clashing_columns(spark):
    assert divergence.audit(frame(spark, ["x"]).limit(0)).collect() == []
    assert {r.part for r in divergence.audit(frame(spark, ["x y"] * 8)).collect()} == {"pair"}


def test_runs_of_columns_cover_the_block():
    import pyarrow as pa

    entries = pa.array([[{"source": 0, "n": 2}], [{"source": 0, "n": 2}], [{"source": 1, "n": 1}], [{"source": 0, "n": 5}, {"source": 1, "n": 1}]])
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), entries], names=["lang", "entries"])
    (block,) = divergence._blocks(iter([batch]), 9)
    columns = {c["source"]: (c["starts"], c["counts"]) for c in block.column(2).to_pylist()[0]}
    assert columns == {0: ([0, 2, 3], [2, 0, 5]), 1: ([0, 2], [0, 1])} and block.column(1).to_pylist() == [4]


# The extraction of pages

SIDES = "<nav><ul><li><a href='/a'>Menu</a></ul></nav>{}<aside>Side words that are many and many more.</aside><footer>&copy; foot</footer>"


def text_of(page):
    read = markup.read(page)
    return markup.text_of(read, [markup.best(read)[0]])


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<p>a < b &lt;i&gt; &am &#65;&#x42;</p>", "a < b <i> &am AB"),
    ("<p>x<b>y</b>\n <i> z</i><br>w</p>", "xy z w"), ("<script>var a = '<p>no</p>';</script><p>yes</p><style>p{}</style><!-- <p>no</p> -->", "yes"),
    ("<script>never ends <p>no</p>", ""), ("<p>kept</p><a href='never ends>lost", "kept"), ("<p title='a>b'>c</p>", "c"), ("<ul><li>one<li>two</ul>", "one\n\ntwo"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("</div></p>x</b>", "x"), ("<P CLASS=A>Up</P>", "Up"), ("<div hidden>no</div><div style='display: none'>no</div><p>yes", "yes"),
    ("<title>no</title><body><p>yes", "yes"), ("<article><header><h1>T</h1></header><p>x</p></article><header>Site</header>", "T\n\nx"),
])
def test_pages_as_they_are_read(page, text):
    assert text_of(page) == text


def test_what_is_left_out():
    inside = "<h1>Title</h1><p>First words of it.</p><div class='share-buttons'>Share</div><form>Mail <input></form><div class='ad'>Buy</div><div role='alert'>Notice</div><p>Last words.</p><section id='comments'><p>" + "Reader says. " * 40 + "</p></section>"
    assert text_of(SIDES.format(f"<div class='post-7'>{inside}</div>")) == "Title\n\nFirst words of it.\n\nLast words."
    assert text_of(SIDES.format(f"<article>{inside}</article>")) == "Title\n\nFirst words of it.\n\nLast words."


def test_broken_pages_take_linear_time():
    for piece in ("<a ", '<a "', "<a x='", "<!--", "<div>", "<script>", "<", "</", "&", "<p>", "<li>", "<tr><td>a", "<p><b>"):
        markup.read(piece * 40_000)
    markup.read("<div>" * 20_000 + "<td><b>" * 20_000 + "</div>" * 40_000)
    markup.read("<b>" * 20_000 + "<p>x</p>" * 20_000)


def test_hosts_agree_on_paths(spark):
    """A page whose readers wrote more than its author goes by the path of its host's other pages."""
    page = "<body><div class='alpha'><p>{}</p></div><div class='beta'><p>{}</p></div></body>"
    rows = [(i, f"http://Host.example/{i}", page.format("Article words. " * 20, "Short.")) for i in range(9)]
    rows += [(9, "http://host.example/9?x", page.format("Brief.", "Others said much. " * 30)), (10, "http://else.example/", page.format("Brief.", "Others said much. " * 30))]
    rows += [(11, None, None), (12, "no host", "<p>x"), (13, "http://host.example", "<body><div class=c3><p>Another shape of page.</p></div>"), (9, "http://host.example/9?x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("paths", F.lit(1)).withColumn("TEXT", F.lit("clash"))
    got = {(r.page_id, r.text) for r in extraction.extract(pages).collect()}
    assert {(9, "Brief."), (10, ("Others said much. " * 30).strip()), (11, ""), (12, "x"), (13, "Another shape of page."), (9, "")} <= got and len(got) == 15
    assert extraction.extract(pages).columns == ["page_id", "url", "host", "paths", "text"]
    assert extraction.extract(pages.limit(0)).collect() == []


def test_generalised_paths():
    read = markup.read("<body class='single post-17'><div id=x class='b a12'><p>text</p></div>")
    assert markup.path(read, markup.best(read)[0]) == "body.post-#.single div.a#.b"


def test_op13_on_given_pages(spark):
    """Articles of the given pages, taken from between their tags."""
    folder = "/root/testdata/sf0.01"
    want = {}
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{folder}/pages.parquet'").fetchall():
        article = page[page.index("<article>") + 9 : page.rindex("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want[page_id] = "\n\n".join(filter(None, blocks))
    got = QUERIES["op13_extraction"](spark, folder).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
