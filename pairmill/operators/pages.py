"""Articles from fetched pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.functions.html import Element, Meta, Texts, page_fields
from pairmill.operators.columns import compute_once

# --- Fixed values -----------------------------------------------------------------------------
NEWS_CONTAINER = Element(cls="article-content")
NEWS_NOISE = (
    Element(tag="script"),
    Element(tag="style"),
    Element(cls="article-share"),
    Element(cls="related-articles"),
    Element(cls="t25"),
)
NEWS_DATE = Element(cls="news-date")
BODY_CONTAINER = Element(tag="div", cls="content_main_text")
GONE_STATUSES = (403, 404, 410)
RATE_LIMIT_STATUS = 429
# ----------------------------------------------------------------------------------------------


def url_filter(df: DataFrame, url: str = "url", part: str = "/article/") -> DataFrame:
    """Keep rows whose address contains ``part``."""
    return df.filter(F.contains(url, F.lit(part)))


def extract_news(
    pages: DataFrame,
    source: str,
    language: str,
    url: str = "url",
    html: str = "html",
    final_url: str | None = None,
    url_part: str | None = "/article/",
    container: Element = NEWS_CONTAINER,
    noise: Sequence[Element] = NEWS_NOISE,
    date: Element = NEWS_DATE,
    min_words: int = 150,
) -> DataFrame:
    """News articles from pages; map-only.

    The title is the first h1, else the og:title meta, else the page is dropped. The date is the date element, else
    the published-time meta. The body joins the texts of the container by newlines, without noise elements.
    Bodies of fewer than ``min_words`` words are dropped, as are pages whose final address lacks ``url_part``.
    """
    if url_part is not None:
        pages = url_filter(pages, final_url or url, url_part)
    fields = page_fields(
        F.col(html),
        title=[Texts(Element(tag="h1")), Meta("property", "og:title")],
        body=[Texts(container, "\n", tuple(noise))],
        date=[Texts(date), Meta("property", "article:published_time")],
        author=[Meta("name", "author")],
        category=[Meta("property", "article:section")],
    )
    articles = pages.select(F.col(url).alias("url"), fields.alias("__pm_page")).select("url", "__pm_page.*")
    articles = compute_once(articles, word_count=tx.word_count("body"))
    return articles.filter((F.col("title") != "") & (F.col("word_count") >= min_words)).select(
        "url",
        "title",
        "date",
        "author",
        "category",
        "body",
        "word_count",
        F.length("body").alias("char_count"),
        F.lit(source).alias("source"),
        F.lit(language).alias("language"),
    )


def extract_body(
    pages: DataFrame, html: str = "html", name: str = "text", container: Element = BODY_CONTAINER
) -> DataFrame:
    """Add the text of one container, its pieces joined by a space; NULL when the page has no such container."""
    return pages.withColumn(name, page_fields(F.col(html), body=[Texts(container, " ")])["body"])


def text_stats(df: DataFrame, col: str = "text") -> DataFrame:
    """Add word_count and char_count."""
    return df.withColumns({"word_count": tx.word_count(col), "char_count": F.length(col)})


def classify_status(df: DataFrame, status: str = "status", name: str = "route") -> DataFrame:
    """Route fetched pages: 'ok', 'drop' for pages that are gone or refused, 'retry' for rate limits and every
    other failure, among them a missing status."""
    s = F.col(status)
    route = (
        F.when(s.isin(*GONE_STATUSES), "drop")
        .when(s == RATE_LIMIT_STATUS, "retry")
        .when((s >= 200) & (s < 400), "ok")
        .otherwise("retry")
    )
    return df.withColumn(name, route)
