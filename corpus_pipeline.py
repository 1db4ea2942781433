"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before has kept, and returns a DataFrame that
is written as Parquet and read again for the next. All but the last return the columns they were given.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import pairmill  # noqa: E402
from pairmill.llm.mixing import AtMost, Measured, mix, text_form, word_weight  # noqa: E402
from pairmill.llm.order_minhash import drop_near_copies  # noqa: E402
from pairmill.llm.piece_ids import encode_documents  # noqa: E402
from pairmill.llm.secrets import find_secrets, redact  # noqa: E402
from pairmill.llm.weak_quality import judge  # noqa: E402
from pairmill.session import scratch  # noqa: E402

cloudpickle.register_pickle_by_value(pairmill)

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
# No source above this share of words; languages and forms keep the shares that the documents have.
MIX_TARGETS = {"source": AtMost(0.3), "lang": Measured(), "__pm_form": Measured()}


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision takes to be good. NULL and empty texts go, repeated rows share their verdict, texts of
    any length are read whole, and columns of any name keep their values. An empty table gives an empty one."""
    # The row travels as one value, so that no column of it meets a feature of the same name.
    packed = docs.select(F.struct(*_columns(docs)).alias("__pm_row"), "text")
    return judge(packed, carry=["__pm_row"]).filter("kept").select("__pm_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: the one with the smallest id. A row is judged by its own text, also where
    its id stands beside others; of rows that repeat id and text one stays. Rows whose text is NULL, empty or without words
    stay. Columns of any name keep their values. An empty table gives an empty one."""
    return drop_near_copies(docs).select(*_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a placeholder; ``n_chars`` follows the new text. Every row stays, repeated ones and such without a
    text too; columns of any name keep their values. An empty table gives an empty one."""
    found = find_secrets(docs, name="__pm_spans")
    clean = F.when(F.size("__pm_spans") > 0, redact(F.col("text"), F.col("__pm_spans"))).otherwise(F.col("text"))
    found = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        changed = F.when(F.size("__pm_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", changed)
    return found.select(*_columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which no source is above its share of words, and languages and forms keep theirs. Rows that repeat an id
    share their fate; a NULL source or language is a category like any other. Columns of any name keep their values. An
    empty table gives an empty one."""
    mixed = mix(docs.withColumn("__pm_form", text_form()), MIX_TARGETS, word_weight(), name="__pm_probability")
    return mixed.select(*_columns(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to. NULL texts count as empty and have the ids of begin
    and end; rows that repeat stay. Other columns are left out. An empty table gives an empty one."""
    coded = encode_documents(docs, PIECE_MODEL, keep=("doc_id", "source", "lang"))
    return coded.select(
        "doc_id",
        "source",
        "lang",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_copies),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("SentencePiece encoding", token_ids),
]

# Estimated rule accuracies, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
