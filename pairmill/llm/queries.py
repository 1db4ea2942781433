"""Queries of this folder over the given tables. Each is a thin layer over its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm.common import table, text_or_empty
from pairmill.llm.exact_dedup import exact_copies
from pairmill.llm.hard_negatives import mine_hard_negatives
from pairmill.llm.hash_tree import assign_shards, even_tree, with_slots
from pairmill.llm.id_files import read_token_ids, write_token_ids
from pairmill.llm.lattice import near_vectors
from pairmill.llm.ns_clusters import cluster_vectors, with_inertia
from pairmill.llm.mixing import Measured, Tempered, repeat, text_form, word_weight
from pairmill.llm.order_minhash import near_classes
from pairmill.llm.piece_ids import encode_documents
from pairmill.llm.secrets import BASE_RULES, find_secrets, span_list
from pairmill.llm.token_counts import count_tokens
from pairmill.llm.url_rules import filter_urls
from pairmill.llm.weak_quality import judge
from pairmill.session import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
# Tokens above which a document is too long for one context.
TOKEN_LIMIT = 4096


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_id_files(spark, sf):
    """Token ids written as binary files and read back."""
    path = scratch(spark, "token-ids")
    write_token_ids(table(spark, sf, "documents"), path, WORD_MODEL)
    found = read_token_ids(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_piece_ids(spark, sf):
    """Ids and decoded text of every document."""
    found = encode_documents(table(spark, sf, "documents"), PIECE_MODEL)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_token_counts(spark, sf):
    """Bytes and tokens of every document."""
    found = count_tokens(table(spark, sf, "documents"), PIECE_MODEL)
    return found.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


@query
def op1_secret_scan(spark, sf):
    """Spans of secrets in every document."""
    found = find_secrets(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(BASE_RULES))
    orders = F.transform("spans", lambda s: s["order"])
    counts = {
        f"n_{rule.kind}": (F.size(orders) - F.size(F.array_remove(orders, i))).cast("long")
        for i, rule in enumerate(BASE_RULES)
    }
    return found.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


# Large sources are lowered and small ones lifted, none above this share of words; languages and forms keep the shares that
# the table has.
MIX_TARGETS = {"source": Tempered(0.7, most=0.3), "lang": Measured(), "topic": Measured()}


@query
def op3_source_mix(spark, sf):
    """How often a mixture takes each document so that sources have tempered shares of words, and languages and forms keep
    theirs. Every document is taken once at least."""
    docs = table(spark, sf, "documents").withColumn("topic", text_form())
    return repeat(docs, MIX_TARGETS, word_weight()).select("doc_id", "source", "lang", "topic", "n_copies", "expected_copies")


SHARDS = 24


@query
def op6_hash_tree(spark, sf):
    """Shard and slot of every document, and the shard with one more of them."""
    docs = table(spark, sf, "documents")
    sized = docs.withColumns(
        {
            "size": F.octet_length(text_or_empty()).cast("long") + 8,
            "text_crc32": F.crc32(text_or_empty().cast("binary")),
            "law": F.lit("key"),
        }
    )
    placed = assign_shards(assign_shards(sized, even_tree(SHARDS)), even_tree(SHARDS + 1), "grown_shard")
    narrow = placed.select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
    return with_slots(narrow, ["doc_id", "text_crc32", "size"])


@query
def op8_weak_quality(spark, sf):
    """Base features and verdict of every document."""
    return judge(table(spark, sf, "documents"), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 6).alias("p_good"),
    )


@query
def op9_url_rules(spark, sf):
    """Verdict on the address of every page. A page is bad if its document is labelled as poor or toxic."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    labelled = pages.join(labels, "page_id")
    return filter_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


@query
def op2_lattice_dedup(spark, sf):
    """Links and component of every vector."""
    return near_vectors(table(spark, sf, "embeddings"))


@query
def op4_order_minhash(spark, sf):
    """Class of every document, by similarity of texts."""
    found = near_classes(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "kept")


@query
def op11_exact_dedup(spark, sf):
    """Group of every document among equal texts, and whether it is the one that stays."""
    found = exact_copies(table(spark, sf, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query
def op12_ns_clusters(spark, sf):
    """Cluster of every vector after three rounds, with distances and inertia."""
    found, centroids, _ = cluster_vectors(table(spark, sf, "embeddings"))
    named = with_inertia(found, centroids).withColumnRenamed("id", "vec_id")
    return named.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def op13_hard_negatives(spark, sf):
    """Hard negatives of every fiftieth vector; labels of every seventh are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    anchor = F.col("vec_id") % 50 == 0
    return mine_hard_negatives(table(spark, sf, "embeddings"), label=moved, anchor=anchor).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
