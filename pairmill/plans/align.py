"""Parallel corpus from two monolingual ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.operators.align import align_best, attach_matches
from pairmill.operators.infer import encode, hashed_grams


def align_corpora(
    left: DataFrame,
    right: DataFrame,
    encoder: Callable[..., Callable[[list[str]], list]] = hashed_grams,
    id_col: str = "id",
    threshold: float = 0.85,
    **options,
) -> DataFrame:
    """(title_kk, title_ru, text_kk, text_ru, score): titles are encoded, matched, and the texts joined back.

    Each title is encoded and matched once, however many rows have it; NULL counts as empty. Without an ``encoder`` titles
    are compared by their character grams."""

    def titled(df: DataFrame) -> DataFrame:
        title = F.coalesce("title", F.lit(""))
        return df.select(F.col(id_col).alias("id"), title.alias("title"), F.unhex(F.md5(title.cast("binary"))).alias("key"))

    def vectors(df: DataFrame, name: str) -> DataFrame:
        return encode(df, "title", "embedding", encoder).select(F.col(name).alias("id"), "embedding")

    ones = titled(left).groupBy("key").agg(F.first("title").alias("title"))
    # Of equal titles the right row with the lowest id matches.
    others = titled(right).groupBy("key").agg(F.first("title").alias("title"), F.min("id").alias("id"))
    found = align_best(vectors(ones, "key"), vectors(others, "id"), threshold=threshold, **options)
    rows = titled(left).select(F.col("id").alias("left_id"), "key")
    matches = rows.join(found.withColumnRenamed("left_id", "key"), "key").select("left_id", "right_id", "score")
    return attach_matches(matches, left, right, id_col).drop("left_id", "right_id")
