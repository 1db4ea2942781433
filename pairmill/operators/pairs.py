"""(text, summary) pairs: derivation, quality filter, deduplication and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.operators.columns import compute_once
from pairmill.session import stage

# Rows to drop that are broadcast, eight bytes each; more of them are joined by shuffle.
MOST_BROADCAST_ROWS = 1 << 20


def derive_pairs(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    markup_sources: Sequence[str] = tx.MARKUP_SOURCES,
    n_sentences: int = 3,
    min_words: int = 5,
) -> DataFrame:
    """Add text_clean, summary, text_words, summary_words and compression. Map-only."""
    df = compute_once(df, text_clean=tx.clean_text(text, source, markup_sources))
    df = compute_once(df, summary=tx.extract_lead("text_clean", n_sentences, min_words))
    # Cleaned text and leads hold single inner spaces only.
    df = df.withColumns(
        {"text_words": tx.spaced_word_count("text_clean"), "summary_words": tx.spaced_word_count("summary")}
    )
    return df.withColumn("compression", F.col("text_words") / F.greatest(F.col("summary_words"), F.lit(1)))


def quality_condition(
    min_text: int = 200,
    min_summary: int = 20,
    min_compression: float = 3.0,
    exempt_sources: Sequence[str] = (),
) -> Column:
    """Long enough text and summary, enough compression, neither empty. Rows of ``exempt_sources`` only
    need to be non-empty; by default no source is exempt."""
    long_enough = (
        (F.col("text_words") >= min_text)
        & (F.col("summary_words") >= min_summary)
        & (F.col("compression") >= min_compression)
    )
    if exempt_sources:
        long_enough = long_enough | F.coalesce(F.col("source").isin(*exempt_sources), F.lit(False))
    return long_enough & (F.col("summary") != "") & (F.col("text_clean") != "")


def quality_filter(df: DataFrame, **thresholds) -> DataFrame:
    return df.filter(quality_condition(**thresholds))


def min_words(df: DataFrame, col: str, n: int = 150) -> DataFrame:
    """Reject short articles."""
    return compute_once(df, _words=tx.word_count(col)).filter(F.col("_words") >= n).drop("_words")


def valid_pairs(df: DataFrame, cand: str = "cand", ref: str = "ref") -> DataFrame:
    """Pairs where both sides are non-empty (NULL counts as empty)."""
    return df.filter((F.col(cand) != "") & (F.col(ref) != ""))


def drop_duplicates(df: DataFrame, col: str = "text_clean", order: str = "doc_id") -> DataFrame:
    """Keep the first row in input order per distinct value of ``col``.

    Groups by a 256-bit digest instead of the text, so a plan that needs only narrow columns shuffles no
    text. The row-number limit runs in every map task before the shuffle (WindowGroupLimit): a group of
    copies of any size leaves each task as one row.
    """
    first = Window.partitionBy("_digest").orderBy(order)
    return (
        df.withColumn("_digest", F.sha2(F.col(col), 256))
        .withColumn("_nth", F.row_number().over(first))
        .filter("_nth = 1")
        .drop("_digest", "_nth")
    )


def first_copies(df: DataFrame, col: str = "text_clean", order: str = "doc_id") -> DataFrame:
    """The rows that :func:`drop_duplicates` keeps, for wide rows that are needed whole. Runs jobs when called.

    The table is written once with a row number and the digest of ``col``. The first row of each digest is found on these
    narrow columns, where copies collapse before the shuffle, and the rows to drop are taken out of the written table by
    their numbers: texts are never sorted, and not shuffled either while the dropped rows are few enough to broadcast.
    A NULL text is a value like any other, a NULL in ``order`` comes first, and of rows equal in both one stays.
    """
    rows = df.withColumns({"__pm_row": F.monotonically_increasing_id(), "__pm_digest": F.sha2(F.col(col), 256)})
    rows, _ = stage(rows, "copies")
    first = rows.groupBy("__pm_digest").agg(F.min(F.struct(order, "__pm_row")).alias("first"))
    lost, _ = stage(rows.select("__pm_row").join(first.select("first.__pm_row"), "__pm_row", "left_anti"), "lost")
    few = lost.count() <= MOST_BROADCAST_ROWS
    lost = F.broadcast(lost) if few else lost.hint("shuffle_hash")
    return rows.join(lost, "__pm_row", "left_anti").drop("__pm_row", "__pm_digest")


def quality_report(df: DataFrame, col: str = "text_clean", order: str = "doc_id", **thresholds) -> DataFrame:
    """Rows before and after filter and deduplication, dropped rows, dropped percent (one digit).

    One scan: rows are first reduced to one line per (digest, kept), where copies collapse before the
    shuffle, so neither hot texts nor text columns travel.
    """
    kept = F.coalesce(quality_condition(**thresholds), F.lit(False))
    per_text = (
        df.select(kept.alias("kept"), F.when(kept, F.sha2(F.col(col), 256)).alias("digest"))
        .groupBy("kept", "digest")
        .agg(F.count("*").alias("n"))
    )
    totals = per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count_if("kept").alias("after")
    )
    return attrition(totals)


def attrition_report(df: DataFrame, kept: Column) -> DataFrame:
    """The same report for a plain flag."""
    return attrition(df.agg(F.count("*").alias("before"), F.count_if(kept).alias("after")))


def attrition(totals: DataFrame) -> DataFrame:
    dropped = F.col("before") - F.col("after")
    return totals.withColumns(
        {"dropped": dropped, "dropped_pct": F.round(F.try_divide(dropped * 100.0, F.col("before")), 1)}
    )
