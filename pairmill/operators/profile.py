"""Corpus profiles: counts, means, length statistics, categories, alignment scores.

Medians are exact. They keep one counter per distinct value, and lengths and three-digit scores have few
distinct values however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions import text as tx


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def counts_by(df: DataFrame, col: str) -> DataFrame:
    """Value counts without NULL, most frequent first."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def means_by(df: DataFrame, key: str, digits: dict[str, int]) -> DataFrame:
    """Per key the mean of each column, rounded to the digits given for it."""
    means = (F.round(F.avg(c), d).alias(f"mean_{c}") for c, d in digits.items())
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*means)


def _truncated(c) -> F.Column:
    return c.cast("long")


def length_profile(df: DataFrame, by: Sequence[str] = ("lang",), text: str = "text", title: str | None = "title") -> DataFrame:
    """Per group: row count; min, max, mean, median and sample standard deviation of characters and of
    words; min, max and mean of title characters. Mean, median and deviation are cut to whole numbers."""
    lengths = [F.length(text).alias("char"), tx.word_count(text).alias("word")]
    if title is not None:
        lengths.append(F.length(title).alias("title"))
    measured = df.select(*by, *lengths)
    aggs = [F.count("*").alias("n")]
    for c in ("char", "word"):
        aggs += [
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            _truncated(F.avg(c)).alias(f"{c}_mean"),
            _truncated(F.median(c)).alias(f"{c}_median"),
            _truncated(F.stddev_samp(c)).alias(f"{c}_std"),
        ]
    if title is not None:
        aggs += [
            F.min("title").alias("title_min"),
            F.max("title").alias("title_max"),
            _truncated(F.avg("title")).alias("title_mean"),
        ]
    return measured.groupBy(*by).agg(*aggs)


def length_buckets(df: DataFrame, by: Sequence[str] = ("lang",), text: str = "text") -> DataFrame:
    """Texts per length class: below 500, 500 to 1,999, 2,000 to 4,999, and 5,000 or more characters."""
    chars = F.col("chars")
    return (
        df.select(*by, F.length(text).alias("chars"))
        .groupBy(*by)
        .agg(
            F.count_if(chars < 500).alias("short"),
            F.count_if((chars >= 500) & (chars < 2000)).alias("medium"),
            F.count_if((chars >= 2000) & (chars < 5000)).alias("long"),
            F.count_if(chars >= 5000).alias("very_long"),
        )
    )


def alignment_profile(pairs: DataFrame, cuts: Sequence[float] = (0.95, 0.90, 0.85)) -> DataFrame:
    """Pair count, mean and median score (three digits), and pairs at or above each cut."""
    at_least = (F.count_if(F.col("score") >= c).alias(f"ge_{round(c * 100)}") for c in cuts)
    return pairs.agg(
        F.count("*").alias("n_pairs"),
        F.round(F.avg("score"), 3).alias("mean_score"),
        F.round(F.median("score"), 3).alias("median_score"),
        *at_least,
    )


def top_categories(df: DataFrame, by: str = "lang", category: str = "category", k: int = 10) -> DataFrame | None:
    """The ``k`` most frequent categories per group, ties by name; None when there is no such column."""
    if category not in df.columns:
        return None
    counts = df.filter(F.col(category).isNotNull()).groupBy(by, category).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), category)
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
