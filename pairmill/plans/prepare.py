"""Corpus preparation: articles to filtered, deduplicated pairs, a frozen test set and nested train samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.operators import pairs as pr
from pairmill.operators import sampling as sp
from pairmill.operators.columns import select_existing
from pairmill.sources.files import write_csv

PAIR_COLUMNS = ("text_clean", "summary", "source", "title", "text_words", "summary_words")


def clean_pairs(articles: DataFrame, id_col: str = "doc_id", **thresholds) -> DataFrame:
    """Derived pairs that pass the quality filter, one per distinct text. One exchange."""
    derived = pr.derive_pairs(articles)
    return pr.drop_duplicates(pr.quality_filter(derived, **thresholds), "text_clean", id_col)


def source_report(pairs: DataFrame) -> DataFrame:
    """Per source: pairs, mean text length in words (whole), mean compression (one digit)."""
    return pairs.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.count("*").alias("n"),
        F.round(F.avg("text_words"), 0).alias("mean_text_words"),
        F.round(F.avg("compression"), 1).alias("mean_compression"),
    )


def prepare_corpus(
    articles: DataFrame,
    out_dir: str,
    id_col: str = "doc_id",
    test_size: int = 2000,
    sizes: Sequence[int] = (5_000, 20_000, 50_000, 100_000),
    seed: int = 42,
    **thresholds,
) -> dict[str, DataFrame]:
    """Write pairs, test set, train samples and full train set under ``out_dir``; return the two reports.

    The pairs are written as Parquet, and split, samples and reports read that table: the text chain runs a
    single time. Split and samples compare rows with cuts, so each output is one pass over the written table.
    """
    spark = articles.sparkSession
    passed = pr.quality_filter(pr.derive_pairs(articles), **thresholds)
    pr.first_copies(passed, "text_clean", id_col).write.mode("overwrite").parquet(f"{out_dir}/pairs")
    pairs = spark.read.parquet(f"{out_dir}/pairs")

    split = sp.stratified_split(pairs, "source", id_col, test_size, seed)
    wanted = [id_col, *(c for c in PAIR_COLUMNS if c in pairs.columns)]
    split = select_existing(split, [*wanted, "is_test"]).withColumnRenamed("text_clean", "text")
    write_csv(split.filter("is_test").drop("is_test", id_col), f"{out_dir}/test")

    train = split.filter(~F.col("is_test")).drop("is_test")
    samples = sp.nested_samples(train, id_col, sizes, seed)
    total = pairs.count() - test_size
    for n in sorted(sizes):
        if n <= total:
            write_csv(sp.sample_of(samples, n).drop(id_col), f"{out_dir}/train_{n}")
    write_csv(train.drop(id_col), f"{out_dir}/train_full")
    before = articles.agg(F.count("*")).scalar()
    totals = pairs.agg(F.count("*").alias("after")).select(before.alias("before"), "after")
    return {"attrition": pr.attrition(totals), "by_source": source_report(pairs)}
