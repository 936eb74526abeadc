import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from folioforge.functions import html
from folioforge.operators.fetch import filter_usable_articles
from folioforge.schemas import FETCH_RESPONSE, HTML_PAGE
from folioforge.sources import read_html_pages, read_image_bodies, read_image_responses, read_reader_responses

URL = "https://example.com/dir/article?x=1"


def responses(spark, *rows):
    """rows: (status, error kind, body); a body that is not text is written as JSON"""
    data = [(i, URL, s, e, b if b is None or isinstance(b, str) else json.dumps(b)) for i, (s, e, b) in enumerate(rows)]
    return read_reader_responses(spark.createDataFrame(data, FETCH_RESPONSE))


def body(content="# Hi\n\nText", metadata=None, **data):
    return {"code": 200, "status": 20000, "data": {"content": content, "url": URL, "metadata": metadata or {}, "usage": {"tokens": 4}, **data}}


def test_fetch_classes(spark):
    table = responses(
        spark,
        (200, None, body()),
        (500, None, {"error": "internal"}),
        (429, None, {"error": "rate limited"}),
        (None, "connection", None),
        (200, "timeout", body()),
        (200, None, body("   \n\n  ")),
        (200, None, body("")),
        (200, None, {"code": 200}),
        (200, None, "<html>not json</html>"),
        (200, None, ""),
        (200, None, None),
        (200, None, '{"data": {"content": "cut off'),
        (400, None, None),
        (302, None, body()),
        (200, None, body(" ")),
    )
    classes = [r.fetch_class for r in table.orderBy("article_id").collect()]
    assert classes == [
        "ok", "http_error", "rate_limit", "unreachable", "unreachable", "empty_content", "empty_content", "empty_content",
        "decode_error", "decode_error", "decode_error", "decode_error", "http_error", "ok", "empty_content",
    ]
    assert [r.article_id for r in filter_usable_articles(table).orderBy("article_id").collect()] == [0, 13]


def test_metadata_choice(spark):
    table = responses(
        spark,
        (200, None, body(title="T", description="D", publishedTime="soon", metadata={"author": " Jane ", "date": "x"})),
        (200, None, body(title="", description="", publishedTime="", metadata={"author": ["A", "B"], "og:author": "O", "DC.date": "2003"})),
        (200, None, body(title="  ", description=" ", metadata={"author": "  ", "article:author": 5, "citation_author": "C"})),
        (200, None, body(metadata={"article:published_time": " 2026-01-15 ", "date": "y", "nested": {"a": [1]}})),
        (200, None, body(metadata=None)),
    ).orderBy("article_id")
    assert [(r.title, r.author, r.date, r.description) for r in table.collect()] == [
        ("T", "Jane", "soon", "D"),
        (None, "O", "2003", None),
        ("  ", "C", None, " "),
        (None, None, "2026-01-15", None),
        (None, None, None, None),
    ]


def page(spark, text, url=URL):
    return read_html_pages(spark.createDataFrame([(1, url, text)], HTML_PAGE)).first()


def test_page_constructs(spark):
    row = page(
        spark,
        """<!DOCTYPE html><html><head><title> A &amp; B </title>
        <meta name="author" content=" Jane "><meta content="2026-01-15" property="article:published_time">
        <meta name="description" content="">  <meta property="og:description" content="It&#39;s">
        <script>var t = "<article>no</article>";</script><style>p{}</style></head>
        <body><nav><a href="/x">menu</a></nav><!-- <article>no</article> -->
        <article><h1>Head</h1><h3 class="s">Sub</h3><div class="ad">Buy</div>
        <p>One <b>bold</b> <em>it</em> <code>x</code>&nbsp;&mdash; 3 &lt; 4 &amp;lt; &#8217;&#x2019;&#0;
        line</p><ul><li>a</li><li>b</li></ul>
        <p><a href="rel.html">rel</a> <a href="#top">top</a>
        <a href="https://z/full"><img class="c" src='../img/t.png' alt="Thumb"></a>
        <img alt="Root" width=3 src="/r.png"><img data-src="no" src="//cdn.example/c.png"></p>
        <p><b>open<br><p>next</p><footer>foot</footer></article><footer>end</footer></body></html>""",
    )
    assert (row.title, row.author, row.date, row.description) == ("A & B", "Jane", "2026-01-15", "It's")
    assert row.fetch_class == "ok"
    assert row.markdown == (
        "# Head\n\n### Sub\n\nOne **bold** *it* `x` — 3 < 4 &lt; ’’&#0; line\n\n- a\n- b\n\n"
        "[rel](https://example.com/dir/rel.html) [top](https://example.com/dir/article?x=1#top) "
        "[![Thumb](https://example.com/img/t.png)](https://z/full) "
        "![Root](https://example.com/r.png)![](https://cdn.example/c.png)\n\nopen\n\nnext"
    )


def test_pages_without_an_article_element(spark):
    assert page(spark, "<html><body><main><p>main</p></main><p>rest</p></body></html>").markdown == "main"
    assert page(spark, "<body class=x><p>only body</p></body>").markdown == "only body"
    assert page(spark, "just text").markdown == "just text"
    empty = page(spark, "<html><body><script>x</script> </body></html>")
    assert (empty.title, empty.fetch_class) == (None, "empty_content")
    assert page(spark, None).fetch_class == "empty_content"


def test_html_is_parsed_once_below_a_filter(spark):
    read = read_html_pages(spark.createDataFrame([(1, URL, "<p>x</p>")], HTML_PAGE))
    whole, filtered = (t._jdf.queryExecution().optimizedPlan().toString() for t in (read, filter_usable_articles(read)))
    assert filtered.count("noscript") == whole.count("noscript") > 0


def test_attempt_log_columns_are_completed(spark):
    log = spark.createDataFrame([(1, "u", 1, 200, "Image/PNG; q=1", b"body")], "article_id bigint, url string, attempt long, http_status int, content_type string, body binary")
    read = read_image_responses(log)
    assert read.columns == ["article_id", "url", "attempt", "http_status", "error_kind", "content_type", "size_bytes", "mime"]
    assert read.first().mime == "image/png"


def test_image_bodies(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(b"\x89PNG")
    (tmp_path / "b.txt").write_text("no")
    rows = read_image_bodies(spark, str(tmp_path), "*.png").collect()
    assert [(r.size_bytes, bytes(r.content)) for r in rows] == [(4, b"\x89PNG")]


@pytest.mark.parametrize(
    ("source", "markdown"),
    [
        ("<article><p>one</p></article><article><p>two</p></article>", "one\n\ntwo"),
        ("<article>a<article>b</article>c</article>", "a\n\nb\n\nc"),
        ("<ARTICLE><p>x</p></ARTICLE>", "x"),
        ("<p>caf&eacute; &Uuml;ber &hearts; &nosuch; &amp;lt;</p>", "café Über ♥ &nosuch; &lt;"),
        ("""<p><img alt="it's me" src="/a.png"></p>""", "![it's me](https://example.com/a.png)"),
        ("""<p><a href="/what's-new">n</a></p>""", "[n](https://example.com/what's-new)"),
        ("<p><img src=/u.png></p>", "![](https://example.com/u.png)"),
        ("<p>a<img src=''>b<img alt=x>c</p>", "abc"),
        ("<p><img src='/a_(b).png' alt='p'></p>", "![p](https://example.com/a_%28b%29.png)"),
        ("<table><tr><td>A</td><td>B</td></tr></table>", "A B"),
        ("<dl><dt>k</dt><dd>v</dd></dl>", "k\nv"),
        ("<pre>one\n  two\n\n\nthree</pre>", "one\n  two\n\n\nthree"),
        ("<div class='ad banner'>buy</div><div class=\"has ads\">me</div><div class='adult'>stays</div>", "stays"),
        ("<p>a</p><div class=ad>buy<div>now<div class=ads>x</div>y</div>C tail</div><div>b</div><p>c</p>", "a\n\nb\n\nc"),
        ("<div class=ad>open<div>a</div><div class=ad>buy</div>b</div></div><p>c</p>", "c"),
        ("<div class=ad>open<div>a</div><p>b</p>", "open\n\na\n\nb"),
        ("</div><DIV class=ad>x<div-x></DIV >a<div class=ad>y</div>b", "a b"),
        ("<ul><li>a<ul><li>b</li><li>c<ol><li>d</ol></li></ul></li><li>e</ul><p>f</p>", "- a\n  - b\n  - c\n    - d\n- e\n\nf"),
        ("<ul><li>a</li></ul><li>b<OL class=x><LI>c</OL>", "- a\n\n- b\n\n- c"),
        ("<pre style='" + "x:y;" * 200 + "' class=a>a\n  b</pre><p>c\n  d</p><PRE>e\n f</PRE><pre>g", "a\n  b\n\nc d\n\ne\n f\n\ng"),
        ("<p>a</p><!-- x <!-- y --><p>b</p><script>s</script><p>c</p><script>never closed", "a\n\nb\n\nc\n\nnever closed"),
        ("<p>a</p><nav>x<nav>y</nav><p>b</p><nav>open", "a\n\nb\n\nopen"),
        ("<a>no target</a> <a name=x href=/y title='a > b'>t</a>", "no target [t](https://example.com/y)"),
    ],
)
def test_nothing_is_lost_or_merged(spark, source, markdown):
    assert page(spark, source).markdown == markdown


def test_head_of_any_case(spark):
    row = page(spark, """<HTML><HEAD><TITLE>It's</TITLE><META NAME=author CONTENT="It's me"></HEAD><BODY><p>x</p><title>no</title></BODY>""")
    assert (row.title, row.author, row.markdown) == ("It's", "It's me", "x\n\nno")


@pytest.mark.parametrize("unit", ["<!--", "<nav ", "<nav>", "<article>", "<img ", "<a href=x>", "<title>", "<meta ", "<pre>", "<div class='ad'>", "<script>", "<b>", '<img "', "&amp", "<"])
def test_long_pages_of_unclosed_tags(spark, unit):
    began = time.time()
    row = page(spark, unit * (1_000_000 // len(unit)))
    assert row is not None
    assert time.time() - began < 20


@pytest.mark.parametrize("unit", ["<div class='ad'></div>", "<div class=ad><div>", "<ul><li>", "<ul><li></ul>", "<pre a='b'>\n</pre>"])
def test_long_pages_of_nested_tags(spark, unit):
    """A fold over tags costs more than a pass of a pattern, so a quarter of a megabyte."""
    assert page(spark, unit) is not None
    began = time.time()
    row = page(spark, unit * (250_000 // len(unit)))
    assert row is not None
    assert time.time() - began < 20


def test_states_of_a_fold_across_blocks(spark):
    for size in (0, 1, html.BLOCK - 1, html.BLOCK, html.BLOCK + 1, 3 * html.BLOCK):
        numbers = f"slice(sequence(1, {size + 1}), 1, {size})"
        found = spark.range(1).select(F.expr(html.running(numbers, "now + item")).alias("s")).first().s
        assert found == list(itertools.accumulate(range(1, size + 1)))


def test_divisions_nested_a_thousand_deep(spark):
    inner = "<div class=ad>x" + "<div>y" * 1000 + "</div>z" * 1000 + "</div>"
    assert page(spark, f"<p>a</p>{inner}<p>b</p>{inner}").markdown == "a\n\nb"
