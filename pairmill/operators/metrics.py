"""Scores of a long table (system, pair_id, cand, ref) and their means per system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions import overlap as ov
from pairmill.functions import text as tx
from pairmill.operators.columns import compute_once
from pairmill.operators.pairs import valid_pairs

METRICS = ("rouge1", "rouge2", "rougeL", "bleu", "chrf")


def pair_scores(
    df: DataFrame,
    metrics: Sequence[str] = METRICS,
    keys: Sequence[str] = ("system", "pair_id"),
    tokenizer: str = "ascii",
) -> DataFrame:
    """One row per valid pair with the chosen metrics. Map-only.

    ``tokenizer`` concerns ROUGE: 'ascii' gives figures comparable with published ones but sees only digits and Latin
    letters, 'unicode' sees words of any script.
    """
    rouge = [n for n in ov.ROUGE_ORDERS if f"rouge{n}" in metrics]
    cut, matched = {}, {}
    if rouge or "rougeL" in metrics:
        cut["_rouge"] = lambda side: tx.rouge_tokens(side, tokenizer)
    if "bleu" in metrics:
        cut["_bleu"] = tx.bleu_tokens
    if "chrf" in metrics:
        cut["_chrf"] = tx.squeezed
    if rouge:
        matched["_rouge"] = ov.word_overlaps("_rouge_cand", "_rouge_ref", rouge)
    if "rougeL" in metrics:
        matched["_lcs"] = ov.lcs("_rouge_cand", "_rouge_ref")
    if "bleu" in metrics:
        matched["_bleu"] = ov.word_overlaps("_bleu_cand", "_bleu_ref", ov.BLEU_ORDERS)
    if "chrf" in metrics:
        matched["_chrf"] = ov.char_overlaps("_chrf_cand", "_chrf_ref")

    # Texts and tokens are pinned, so that no text is cut twice; a reference equal to its candidate takes the tokens of that.
    scored = valid_pairs(df.select(F.inline(F.array(F.struct(*keys, "cand", "ref")))))
    scored = compute_once(scored, **{f"{name}_cand": tokens("cand") for name, tokens in cut.items()})
    same = F.col("cand") == F.col("ref")
    of_ref = {f"{name}_ref": F.when(same, F.col(f"{name}_cand")).otherwise(tokens("ref")) for name, tokens in cut.items()}
    scored = compute_once(scored, **of_ref).drop("cand", "ref")
    # All in one projection, so that a batch crosses to Python once.
    scored = scored.withColumns(matched)

    def of(metric: str, orders: Sequence[int]) -> list[Column]:
        return [F.col(f"_{metric}")[i] for i in range(len(orders))]

    scores = {f"rouge{n}": ov.rouge_n(one) for n, one in zip(rouge, of("rouge", rouge))}
    scores["rougeL"] = ov.f_measure(F.col("_lcs"), F.size("_rouge_cand"), F.size("_rouge_ref"))
    scores["bleu"] = ov.bleu(of("bleu", ov.BLEU_ORDERS))
    scores["chrf"] = ov.chrf(of("chrf", ov.CHRF_ORDERS))
    return scored.select(*keys, *(scores[m].alias(m) for m in metrics))


# Digits of the means in the leaderboard.
DIGITS = {"rouge1": 3, "rouge2": 3, "rougeL": 3, "bleu": 1, "chrf": 1, "bertscore": 3}


def leaderboard(scored: DataFrame, by: str = "system") -> DataFrame:
    """Per-system means of the metrics at hand, and the number of pairs they cover.

    Pairs with an empty side never reach this table, so ``n_pairs`` tells how many a system lost.
    """
    means = (F.round(F.avg(m), d).alias(m) for m, d in DIGITS.items() if m in scored.columns)
    return scored.groupBy(by).agg(*means, F.count("*").alias("n_pairs"))
