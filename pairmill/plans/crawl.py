"""One round of a crawl over tables: addresses to fetch, fetched pages, articles, progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.operators import pages as pg
from pairmill.operators.columns import grow_done, remaining


@dataclass(frozen=True)
class Round:
    """Results of a round; all lazy."""

    articles: DataFrame
    done: DataFrame
    retry: DataFrame


def crawl_queue(urls: DataFrame, done: DataFrame, part: str | None = "/article/") -> DataFrame:
    """Addresses still to fetch, each once."""
    urls = urls.select("url") if part is None else pg.url_filter(urls.select("url"), "url", part)
    return remaining(urls.distinct(), done, "url")


def crawl_round(queue: DataFrame, fetched: DataFrame, done: DataFrame, source: str, language: str, **options) -> Round:
    """Turn fetched pages (url, status, html) of the queue into articles.

    Pages answered well or gone for good count as done; rate limits and other failures stay in ``retry``, so the next
    round's queue holds them again. ``options`` go to the page extraction.
    """
    pages = pg.classify_status(fetched.join(queue.select("url"), "url", "left_semi"))
    articles = pg.extract_news(pages.filter("route = 'ok'"), source, language, **options)
    finished = pages.filter("route <> 'retry'")
    return Round(articles, grow_done(done, finished, "url"), pages.filter("route = 'retry'").select("url"))
