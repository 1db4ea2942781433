"""Greedy token matching on contextual vectors (BERTScore without idf weights or rescaling)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions.vectors import unit_rows

# Token positions per block. A (pair, side) of any length is a set of blocks of at most this many tokens.
BLOCK = 512
# Blocks of one side of a pair that meet the other side in one task; longer sides are dealt over several.
STRIP = 8


def bertscore_match(
    tokens: DataFrame, keys: Sequence[str] = ("pair_id",), side: str = "side", pos: str = "pos", vec: str = "vec"
) -> DataFrame:
    """Precision, recall and F1 per pair from token vectors.

    ``tokens`` has one row per token: keys, ``side`` ('cand' or 'ref'), the token's position, unique within
    its side, and its vector. Precision is the mean over candidate tokens of the best cosine with any reference
    token; recall the same the other way round. Pairs lacking a side are left out.

    Tokens are packed into blocks by position, candidate blocks meet reference blocks of the same pair by equi-join, and
    each meeting returns only the best cosine per token. So a task holds two blocks however long a text is, and no token
    pair becomes a row. A pair of more than ``STRIP`` blocks a side is a grid of cells, each a join key of its own, so that
    its meetings are spread over tasks; a block is sent once per strip of the other side.
    """
    cand, ref = strips(tokens, keys, side, pos, vec)
    met = cand.join(ref, [*keys, "_cand_strip", "_ref_strip"]).select(
        *keys,
        F.col("_cand.pos").alias("cand_pos"),
        F.col("_cand.vec").alias("cand_vec"),
        F.col("_ref.pos").alias("ref_pos"),
        F.col("_ref.vec").alias("ref_vec"),
    )
    names = list(keys)
    schema = T.StructType(
        [met.schema[k] for k in names]
        + [
            T.StructField("side", T.StringType()),
            T.StructField("pos", T.ArrayType(T.LongType())),
            T.StructField("best", T.ArrayType(T.DoubleType())),
        ]
    )

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                cosines = unit_rows(row["cand_vec"]) @ unit_rows(row["ref_vec"]).T
                pair = [row[k] for k in names]
                rows.append([*pair, "cand", row["cand_pos"], cosines.max(axis=1)])
                rows.append([*pair, "ref", row["ref_pos"], cosines.max(axis=0)])
            yield pd.DataFrame(rows, columns=[*names, "side", "pos", "best"])

    found = met.mapInPandas(match, schema).select(*names, "side", F.inline(F.arrays_zip("pos", "best")))
    best = found.groupBy(*names, "side", "pos").agg(F.max("best").alias("best"))
    means = best.groupBy(*names).agg(
        F.avg(F.when(F.col("side") == "cand", F.col("best"))).alias("precision"),
        F.avg(F.when(F.col("side") == "ref", F.col("best"))).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return means.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def strips(
    tokens: DataFrame, keys: Sequence[str], side: str = "side", pos: str = "pos", vec: str = "vec"
) -> tuple[DataFrame, DataFrame]:
    """Candidate and reference blocks with the cells of their pair in which they stand."""
    blocks = tokens.groupBy(*keys, F.col(side).alias("_side"), F.floor(F.col(pos) / BLOCK).alias("_block")).agg(
        F.collect_list(F.struct(F.col(pos).cast("long").alias("pos"), F.col(vec).alias("vec"))).alias("_tokens")
    )

    def needed(name: str) -> Column:
        return F.ceil(F.count_if(F.col(side) == name) / (BLOCK * STRIP))

    sizes = tokens.groupBy(*keys).agg(needed("cand").alias("_of_cand"), needed("ref").alias("_of_ref"))
    # Only long pairs are looked up, one narrow line each, so that Spark broadcasts them while they are few.
    dealt = blocks.join(sizes.filter("_of_cand > 1 or _of_ref > 1"), list(keys), "left")
    dealt = dealt.withColumns({of: F.greatest(F.coalesce(F.col(of), F.lit(1)), F.lit(1)) for of in ("_of_cand", "_of_ref")})

    def own(of: str) -> Column:
        return F.pmod(F.xxhash64("_block"), F.col(of))

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    cand = dealt.filter("_side = 'cand'").select(
        *keys, own("_of_cand").alias("_cand_strip"), every("_of_ref").alias("_ref_strip"), F.col("_tokens").alias("_cand")
    )
    ref = dealt.filter("_side = 'ref'").select(
        *keys, every("_of_cand").alias("_cand_strip"), own("_of_ref").alias("_ref_strip"), F.col("_tokens").alias("_ref")
    )
    return cand, ref


def bertscore_means(scored: DataFrame) -> DataFrame:
    """Means of precision, recall and F1 over all pairs."""
    return scored.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
