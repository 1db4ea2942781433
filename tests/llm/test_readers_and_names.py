"""Documents fetched by select, words against the library, and input columns whose names clash with helpers."""

import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairmill.llm.hash_tree import assign_shards, even_tree, with_slots
from pairmill.llm.id_files import PLAIN_END, WordIds, read_documents, read_token_ids, write_token_ids
from pairmill.llm.queries import WORD_MODEL
from pairmill.llm.url_rules import filter_urls


def test_words_of_any_characters():
    """Random chains of characters around the limits of the pattern, with contractions, added tokens and white space."""
    tokenizer = Tokenizer.from_file(WORD_MODEL)
    rng = random.Random(5)
    odd = ["'s", "'LL", "<|endoftext|>", "<|", "\n", "  ", "e\u0301", "\u0130", "\u03a3", "\u2028", "\u4e2d", "\U0001f600"]
    characters = [*map(chr, range(0x20, PLAIN_END + 8)), *odd * 9]
    words = WordIds(tokenizer, 2, cache_size=100)
    for _ in range(3000):
        text = "".join(rng.choices(characters, k=rng.randint(0, 25)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), "<u2").tolist() == want, text


def test_documents_by_select(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.range(400).select(
        F.when(F.col("id") % 40 == 7, F.lit(5)).when(F.col("id") != 11, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 9 != 0, F.repeat(F.concat(F.lit("word "), F.col("id")), (F.col("id") % 30).cast("int"))).alias("text"),
    )
    write_token_ids(docs, path, WORD_MODEL, segment_ids=300)
    assert spark.read.parquet(path).count() > 20
    wanted = spark.createDataFrame([(i, "x") for i in (0, 5, 5, 99, 398, 399, None, 10**9)], "doc_id long, text string")
    got = read_documents(spark, path, wanted)
    want = read_token_ids(spark, path).filter("doc_id in (0, 5, 99, 398, 399)")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 15
    assert read_documents(spark, path, wanted.limit(0)).count() == 0


def test_clashing_names_keep_their_values(spark):
    names = ["_region", "_rack", "_row", "_tie", "_before", "_n", "_base"]
    rows = spark.range(60).select("id", F.lit("http://a.example.org/es/x").alias("url"), *(F.concat(F.lit(n), "id").alias(n) for n in names))
    leaves = even_tree(24)
    placed = with_slots(assign_shards(rows, leaves, id_col="id", text="url"), ["id"])
    labelled = rows.select("url", F.lit(False).alias("bad"))
    judged = filter_urls(rows, labelled)
    for result in (placed, judged):
        kept = result.select("id", *names).collect()
        assert len(kept) == 60 and all(r[n] == f"{n}{r.id}" for r in kept for n in names)
