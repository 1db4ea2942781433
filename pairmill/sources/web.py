"""Sitemaps and page-interface answers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.functions.html import decode_entities
from pairmill.functions.text import strip
from pairmill.sources import schemas


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, content); for sitemaps and stored answers, which are small each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def sitemap_urls(docs: DataFrame, part: str = "/article/", order: str = "seq", xml: str = "xml") -> DataFrame:
    """Addresses in the ``loc`` elements of sitemap documents, kept when they contain ``part``; duplicates stay.

    Documents are numbered by ``order``; one whose content is NULL could not be fetched and ends the archive, so the
    documents after the first such one are ignored. Elements are found by their tags, so a document that is not
    well-formed, say by a bare ``&``, gives its addresses all the same.
    """
    end = docs.filter(F.col(xml).isNull()).agg(F.min(order))
    usable = docs.filter(F.coalesce(F.col(order) < end.scalar(), F.lit(True)))
    content = F.regexp_replace(F.col(xml), "(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(content, F.lit(r"(?s)<loc(?:\s[^>]*)?>(.*?)</loc\s*>"), F.lit(1))
    locs = usable.filter(F.col(xml).isNotNull()).select(order, F.explode(found).alias("loc"))
    locs = locs.withColumn("loc", strip("loc"))
    literal = F.regexp_extract("loc", r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
    url = F.when(F.col("loc").startswith("<![CDATA["), literal).otherwise(decode_entities(F.col("loc")))
    return locs.select(order, strip(url).alias("url")).filter(F.contains("url", F.lit(part)))


def list_pages(listing: DataFrame, min_size: int = 500) -> DataFrame:
    """Article pages of a listing table: main namespace, no redirects, at least ``min_size`` bytes."""
    return listing.filter((F.col("ns") == 0) & ~F.col("redirect") & (F.col("size") >= min_size)).select("pageid", "title")


def explode_pages(answers: DataFrame, json: str = "response", min_chars: int = 100) -> DataFrame:
    """Articles (id, title, url, text) in JSON answers that hold a map of pages by id.

    Pages marked missing and texts shorter than ``min_chars`` are skipped; an absent title or address becomes ''.
    """
    parsed = answers.select(F.from_json(F.col(json), schemas.PAGE_ANSWER).alias("a"))
    pages = parsed.select(F.explode("a.query.pages").alias("key", "page"))
    kept = pages.filter(F.col("page.missing").isNull() & (F.length("page.extract") >= min_chars))
    return kept.select(
        F.col("key").cast("long").alias("id"),
        F.coalesce("page.title", F.lit("")).alias("title"),
        F.coalesce("page.fullurl", F.lit("")).alias("url"),
        F.col("page.extract").alias("text"),
    )
