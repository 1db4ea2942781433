"""System evaluation: several summarizers against lead references, all metrics, one leaderboard."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.operators import bertscore as bs
from pairmill.operators import metrics as me
from pairmill.operators.columns import compute_once, drop_null, stack_systems
from pairmill.operators.infer import generate
from pairmill.operators.summarize import tfidf_summary

Factory = Callable[..., Callable[[str], str]]


def system_outputs(
    pairs: DataFrame, id_col: str, text_in: str, text_out: str, systems: dict[str, tuple[str, Factory | None, dict]]
) -> DataFrame:
    """The long table (system, pair_id, cand, ref).

    Each system is (input, factory, options): ``input`` names what is fed to the callable: 'identity' (the reference
    itself, the leading sentences of the target-side text), 'lead' or 'tfidf' of the input-side text. Without a factory the input is the candidate.
    """
    pairs = drop_null(pairs, [text_in, text_out])
    # Inputs, candidates and references are all made inside the row of the pair; nothing is joined or exchanged. The
    # reference is pinned, so that no text is cut twice for it.
    pairs = pairs.select(F.col(id_col).alias("pair_id"), F.col(text_in).alias("text"), F.col(text_out).alias("__pm_out"))
    pairs = compute_once(pairs, ref=tx.get_lead("__pm_out")).drop("__pm_out")
    lead = F.col("ref") if text_in == text_out else tx.get_lead("text")

    def fed(df: DataFrame, kind: str, name: str) -> DataFrame:
        if kind == "identity":
            return df.withColumn(name, F.col("ref"))
        if kind == "lead":
            return df.withColumn(name, lead)
        if kind == "tfidf":
            return tfidf_summary(df, "text", name=name)
        raise ValueError(f"unknown system input {kind!r}")

    # Systems without a factory share one pass over the pairs.
    plain = {name: kind for name, (kind, factory, _) in systems.items() if factory is None}
    parts = []
    if plain:
        wide = pairs
        for kind in dict.fromkeys(plain.values()):
            wide = fed(wide, kind, f"__pm_{kind}")
        made = (F.struct(F.lit(name).alias("system"), F.col(f"__pm_{kind}").alias("cand")) for name, kind in plain.items())
        parts.append(wide.select("pair_id", "ref", F.inline(F.array(*made))))
    outputs = {
        name: generate(fed(pairs, kind, "fed"), "fed", "cand", factory, options=options)
        for name, (kind, factory, options) in systems.items()
        if factory is not None
    }
    if outputs or not plain:
        parts.append(stack_systems(**outputs))
    return reduce(DataFrame.union, (part.select("system", "pair_id", "cand", "ref") for part in parts))


def evaluate(
    outputs: DataFrame, tokens: DataFrame | None = None, tokenizer: str = "ascii"
) -> DataFrame:
    """The leaderboard of a long table of outputs. With token vectors (system, pair_id, side, pos, vec) the table also
    has the mean F1 of embedding-based matching over the same valid pairs."""
    scored = me.pair_scores(outputs, tokenizer=tokenizer)
    if tokens is not None:
        matched = bs.bertscore_match(tokens, ("system", "pair_id"))
        scored = scored.join(
            matched.select("system", "pair_id", F.col("f1").alias("bertscore")), ["system", "pair_id"], "left"
        )
    return me.leaderboard(scored)
