"""Page extraction, sitemaps and interface answers."""

import json

import pytest
from pyspark.sql import functions as F

from pairmill.functions import html as hx
from pairmill.functions.html import Element, Meta, PageIndex, Texts, page_fields
from pairmill.operators import pages as pg
from pairmill.sources import web

PAGE = """<html><head><meta property="og:title" content=" A &amp; B &#1179;&#x41; &copy; "><META NAME=author content='Z "q"'>
<meta property="article:published_time" content="2024-01-02"><meta content="News" property="article:section"></head>
<body><div class="x">no</div><h1> <b>He</b> <i>llo</i> </h1><div class="big article-content"> one <p>two &lt;b&gt; 3 < 4
<div class="t25">skip <div>deep</div> still</div> after<script>var a="</div>";</script>tail<!-- c -->end<div>in</div><br>x
<img alt="a>b">&nbsp;</div> out</div></body></html>"""


def news(spark, html, **options):
    df = spark.createDataFrame([("https://n.example/article/1", html)], "url string, html string")
    return pg.extract_news(df, "n.example", "kk", **{"min_words": 1, **options}).collect()


def test_extract_news(spark):
    (row,) = news(spark, PAGE)
    assert row.title == "Hello" and row.date == "2024-01-02" and row.author == 'Z "q"' and row.category == "News"
    assert row.body == "one\ntwo <b> 3 < 4\nafter\ntail\nend\nin\nx"
    assert row.word_count == 11 and row.char_count == len(row.body)
    assert (row.source, row.language) == ("n.example", "kk")


def test_title_falls_back(spark):
    assert news(spark, PAGE.replace("<h1>", "<h2>"))[0].title == "A & B қA ©"
    assert news(spark, '<h1> </h1><p class="article-content">a') == []


def test_date_element_first(spark):
    page = PAGE.replace("<body>", '<body><span class="news-date"> 5 May </span>')
    assert news(spark, page)[0].date == "5 May"


@pytest.mark.parametrize("n, kept", [(149, 0), (150, 1)])
def test_minimum_words(spark, n, kept):
    page = f"<h1>t</h1><div class='article-content'>{'w ' * n}</div>"
    assert len(news(spark, page, min_words=150)) == kept


def test_url_part(spark):
    df = spark.createDataFrame([("https://n.example/tag/1", PAGE, "https://n.example/article/9")], "url string, html string, final string")
    assert pg.extract_news(df, "n", "kk", min_words=1).count() == 0
    assert pg.extract_news(df, "n", "kk", min_words=1, final_url="final").count() == 1


def test_extract_body(spark):
    html = ['<div class="content_main_text">a <b>b</b><p>c</div>d', '<p class="content_main_text">x</p>', None, '<div class="content_main_text"></div>']
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, html string")
    assert [r.text for r in pg.extract_body(df).orderBy("i").collect()] == ["a b c", None, None, ""]


def test_unclosed_container_reaches_the_end():
    assert PageIndex("<div class='c'>a<div>b</div>c").texts(Element(cls="c")) == ["a", "b", "c"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class=c>a<p class=n>b<div>x</div>y</p>z</div>q", ["a", "z"]),
        ("<div class=c>a<p class=n>b<div>x</div>y</div>q", ["a"]),  # what is left out ends with the container
        ("<div class=c>a<div class=n>b</div>c", ["a", "c"]),  # the one end tag is that of the inner element
        ("<div class=c>a<div class='n m'>b<div class=n>x</div>y</div>c</div>", ["a", "c"]),
        ("</div><div class='x c'>a<br class=n>b< c<img class='n'>d</div>", ["a", "b< c", "d"]),
        ("<DIV CLASS=c>a<B>b</b>&amp;amp;<!-- </div> --><script>'</div>'</script>c</DIV >d", ["a", "b", "&amp;", "c"]),
        ("<p><div class=c>x</p><p class=n>y</p>z</div>", ["x", "z"]),
        ("<div class='cc c-c'>no</div>", None),
        ("<div class=c>a", ["a"]),
        ("<div class=c><span title='>'>a</span><x", ["a", "<x"]),
        ("", None),
    ],
)
def test_intervals(page, want):
    assert PageIndex(page).texts(Element(cls="c"), (Element(cls="n"),)) == want


def test_index_is_read_once(spark):
    """Every field of a page from one call, in Arrow batches; NULL pages are empty ones."""
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "i int, h string")
    fields = page_fields(
        F.col("h"), a=[Texts(Element(tag="h1"))], b=[Meta("name", "author")], c=[Texts(Element(tag="h9")), Meta("property", "og:title")]
    )
    rows = [tuple(r.f) for r in df.select("i", fields.alias("f")).orderBy("i").collect()]
    assert rows == [("Hello", 'Z "q"', "A & B қA ©"), (None, "", ""), (None, "", "")]
    plan = df.select(fields.alias("f")).select("f.*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    wide = df.withColumnRenamed("h", "html").repartition(2)
    for read in (pg.extract_body(wide).filter("text <> ''"), pg.extract_news(wide.withColumn("url", F.lit("/article/")), "s", "l")):
        assert read._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_entities_once(spark):
    df = spark.createDataFrame([("&amp;lt; &lt; &#39; &#x1F600; &eacute; &nope; & &amp",)], "t string")
    assert df.select(hx.decode_entities(F.col("t"))).first()[0] == "&lt; < ' 😀 é &nope; & &amp"


def test_sitemaps(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(
        f"<url><loc> https://n.example{p} </loc></url>" for p in ("/article/1", "/tag/2")
    ) + "</urlset>"
    docs = spark.createDataFrame([(1, xml), (2, xml), (3, None), (4, xml)], "seq int, xml string")
    assert [tuple(r) for r in web.sitemap_urls(docs).orderBy("seq").collect()] == [
        (1, "https://n.example/article/1"), (2, "https://n.example/article/1")
    ]
    assert web.sitemap_urls(docs.filter("seq < 3")).count() == 2


def test_broken_sitemaps(spark):
    xml = (
        "<urlset><url><loc>https://n.example/article/1?a=1&b=2</loc></ur><!-- <loc>/article/no</loc> -->"
        "<url><loc><![CDATA[ https://n.example/article/2?a&amp;b ]]></loc><image:loc>/article/no</image:loc>"
        "<url><loc>\nhttps://n.example/article/3?a&amp;b&#x0000041;</loc>"
    )
    got = web.sitemap_urls(spark.createDataFrame([(1, xml), (2, ""), (3, "<loc>/article/4")], "seq int, xml string"))
    assert [r.url.removeprefix("https://n.example/article/") for r in got.collect()] == ["1?a=1&b=2", "2?a&amp;b", "3?a&bA"]


def test_page_answers(spark):
    pages = {"1": {"missing": "", "title": "gone"}, "2": {"extract": "x" * 99}, "3": {"extract": "y" * 100}}
    df = spark.createDataFrame([(json.dumps({"query": {"pages": pages}}),), ("{}",), ("broken",)], "response string")
    assert [tuple(r) for r in web.explode_pages(df).collect()] == [(3, "", "", "y" * 100)]


def test_statuses(spark):
    df = spark.createDataFrame([(c,) for c in (200, 301, 403, 404, 410, 429, 500, None)], "status int")
    assert [r.route for r in pg.classify_status(df).collect()] == ["ok", "ok", "drop", "drop", "drop", "retry", "retry", "retry"]


def test_crawl_round(spark):
    from pairmill.plans.crawl import crawl_queue, crawl_round

    page = "<h1>t</h1><div class='article-content'>" + "w " * 150 + "</div>"
    base = "https://n.example/article/"
    urls = spark.createDataFrame([(f"{base}{i}",) for i in (1, 1, 2, 3, 4)] + [("https://n.example/tag",)], "url string")
    done = spark.createDataFrame([(f"{base}4",)], "url string")
    queue = crawl_queue(urls, done)
    assert sorted(r.url[-1] for r in queue.collect()) == ["1", "2", "3"]
    fetched = spark.createDataFrame(
        [(f"{base}1", 200, page), (f"{base}2", 404, None), (f"{base}3", 429, None), (f"{base}4", 200, page)],
        "url string, status int, html string",
    )
    result = crawl_round(queue, fetched, done, "n.example", "kk")
    assert [r.url[-1] for r in result.articles.collect()] == ["1"]
    assert sorted(r.url[-1] for r in result.done.collect()) == ["1", "2", "4"]
    assert [r.url[-1] for r in result.retry.collect()] == ["3"]
    assert [r.url[-1] for r in crawl_queue(urls, result.done).collect()] == ["3"]
