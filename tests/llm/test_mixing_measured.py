"""Mixtures whose targets follow the table, and rare cells."""

import pytest
from pyspark.sql import functions as F

from pairmill.llm import mixing
from pairmill.llm.mixing import AtMost, Measured, Tempered
from pairmill.llm.queries import QUERIES


def table(spark, hot, n=20_000):
    """A source with ``hot`` of the documents among 20 others, and one document of an own language without a source."""
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("a b").alias("text"),
        F.when(F.col("id") == 0, None).when(F.col("id") < hot * n, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20))
        .alias("source"),
        F.when(F.col("id") == 0, None).when(F.col("id") % 5 < 3, "en").otherwise("de").alias("lang"),
    )


def test_rare_cell_does_not_set_the_scale(spark):
    """The lone document of no language has a target far above its weight."""
    targets = {"source": {"hot": 0.2, "*": 0.8}, "lang": {"en": 0.6, "de": 0.4, "*": 0.001}}
    rows = mixing.mix(table(spark, 0.4), targets, mixing.word_weight()).collect()
    assert len(rows) > 14_000 and {r.probability for r in rows if r.lang is None} == {1.0}
    assert sum(r.source == "hot" for r in rows) / len(rows) == pytest.approx(0.2, abs=0.02)
    assert sum(r.lang == "en" for r in rows) / len(rows) == pytest.approx(0.6, abs=0.02)


def test_targets_follow_the_table(spark):
    targets = {"source": AtMost(0.3), "lang": Measured()}
    assert mixing.mix(table(spark, 0.05), targets, mixing.word_weight()).count() == 20_000
    rows = mixing.mix(table(spark, 0.5), targets, mixing.word_weight()).collect()
    assert len(rows) == pytest.approx(10_000 / 0.7, rel=0.02)
    assert sum(r.source == "hot" for r in rows) / len(rows) == pytest.approx(0.3, abs=0.02)
    assert sum(r.lang == "en" for r in rows) / len(rows) == pytest.approx(0.6, abs=0.02)
    assert all(r.probability == pytest.approx(1, abs=0.01) for r in rows if r.source != "hot")


def test_lowered_shares():
    assert AtMost(0.3).shares([("a", 50.0), ("b", 10.0)], 100.0) == {"a": 0.3, "*": 0.7}
    # Lowering the first lifts the second above the bound.
    found = AtMost(0.3).shares([("a", 50.0), ("b", 25.0), ("c", 5.0)], 100.0)
    assert found == pytest.approx({"a": 0.3, "b": 0.3, "*": 0.4})
    assert AtMost(0.3).shares([("a", 20.0)], 100.0) == {"*": 1.0}
    # Two sources cannot both stay below 0.3: they get the same share.
    found = mixing.cell_probabilities({("a",): 90.0, ("b",): 10.0}, {"s": AtMost(0.3).shares([("a", 90.0), ("b", 10.0)], 100.0)})
    assert found == pytest.approx({("a",): 1 / 9, ("b",): 1.0})
    assert Measured(0.1).shares([("en", 95.0), ("de", 5.0)], 100.0) == pytest.approx({"en": 0.95, "*": 0.05})


def test_query_keeps_tables_without_a_hot_source(spark, sf):
    assert QUERIES["op3_source_mix"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_tempered_shares():
    found = Tempered(0.5).shares([("a", 64.0), ("b", 36.0)], 100.0)
    assert found == pytest.approx({"a": 0.8 / 1.4, "b": 0.6 / 1.4, "*": 0.0})
    # Lowered to the bound; the others keep their proportions.
    found = Tempered(0.5, most=0.5).shares([("a", 64.0), ("b", 18.0), ("c", 18.0)], 100.0)
    assert found == pytest.approx({"a": 0.8 / (0.8 + 2 * 0.18**0.5), "b": 0.18**0.5 / (0.8 + 2 * 0.18**0.5), "c": 0.18**0.5 / (0.8 + 2 * 0.18**0.5), "*": 0.0})
    found = Tempered(1.0, most=0.5).shares([("a", 64.0), ("b", 24.0), ("c", 12.0)], 100.0)
    assert found == pytest.approx({"a": 0.5, "b": 1 / 3, "c": 1 / 6, "*": 0.0})


def test_copies_follow_the_targets(spark):
    """Every document stays; words times copies have the shares asked for."""
    targets = {"source": Tempered(0.7, most=0.3), "lang": Measured()}
    df = table(spark, 0.5)
    rows = mixing.repeat(df, targets, mixing.word_weight()).collect()
    assert len(rows) == 20_000 and min(r.n_copies for r in rows) == 1
    assert all(r.n_copies in (int(r.expected_copies), int(r.expected_copies) + 1) for r in rows)
    taken = sum(r.n_copies for r in rows)
    share = 0.5**0.7 / (0.5**0.7 + 20 * 0.025**0.7)
    assert sum(r.n_copies for r in rows if r.source == "hot") / taken == pytest.approx(share, abs=0.02)
    assert sum(r.n_copies for r in rows if r.lang == "en") / taken == pytest.approx(0.6, abs=0.02)
    assert mixing.repeat(df.limit(0), targets, mixing.word_weight()).count() == 0


def test_query_mixes_tables_without_a_hot_source(spark, sf):
    """Each stage of op3 shows in its result: shares are tempered, raked and drawn."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", mixing.word_weight().alias("words"))
    rows = QUERIES["op3_source_mix"](spark, sf).join(docs, "doc_id").collect()
    have, got = {}, {}
    for r in rows:
        have[r.source] = have.get(r.source, 0) + r.words
        got[r.source] = got.get(r.source, 0) + r.words * r.expected_copies
    whole = sum(have.values())
    want = {s: (w / whole) ** 0.7 for s, w in have.items()}
    assert max(have.values()) / min(have.values()) > 1.2 and len({r.n_copies for r in rows}) > 1
    for s in have:
        assert got[s] / sum(got.values()) == pytest.approx(want[s] / sum(want.values()), rel=0.02)
    by_topic = {t: sum(r.words * r.expected_copies for r in rows if r.topic == t) / sum(got.values()) for t in {r.topic for r in rows}}
    for t, share in by_topic.items():
        assert share == pytest.approx(sum(r.words for r in rows if r.topic == t) / whole, abs=0.02)
