"""Splits, samples, row numbers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairmill.operators import columns as co
from pairmill.operators import ordering as od
from pairmill.operators import sampling as sp


def docs(spark, n, source=None):
    return spark.range(n).select(F.col("id").alias("doc_id"), (source if source is not None else F.lit("a")).alias("source"))


def by_ranges(*cuts):
    c = F.lit("z")
    for upper, name in reversed(cuts):
        c = F.when(F.col("id") < upper, name).otherwise(c)
    return c


def test_stratified_quotas(spark):
    df = docs(spark, 100, by_ranges((50, "a"), (80, "b"), (100, "c")))
    split = sp.stratified_split(df, test_size=10)
    assert Counter(r.source for r in split.filter("is_test").collect()) == {"a": 5, "b": 3, "c": 2}
    assert split.count() == 100


def test_largest_remainder(spark):
    # Train shares 5.6, 5.6, 2.8 of 14: two of the three get one more; ties by name.
    df = docs(spark, 20, by_ranges((8, "a"), (16, "b"), (20, "c")))
    got = Counter(r.source for r in sp.stratified_split(df, test_size=6).filter("is_test").collect())
    assert got == {"a": 2, "b": 3, "c": 1}


def test_split_errors(spark):
    with pytest.raises(ValueError):
        sp.stratified_split(docs(spark, 10, by_ranges((1, "a"), (10, "b"))), test_size=4)
    with pytest.raises(ValueError):
        sp.stratified_split(docs(spark, 10, by_ranges((5, "a"), (10, "b"))), test_size=1)


def test_split_is_reproducible_and_seeded(spark):
    df = docs(spark, 300, by_ranges((200, "a"), (300, "b")))

    def ids(frame, seed):
        return {r.doc_id for r in sp.stratified_split(frame, test_size=30, seed=seed).filter("is_test").collect()}

    assert ids(df, 1) == ids(df.repartition(5), 1) != ids(df, 2)


def test_nested_samples(spark):
    marked = sp.nested_samples(docs(spark, 100), sizes=(50, 10, 500))
    samples = {n: {r.doc_id for r in sp.sample_of(marked, n).collect()} for n in (10, 50)}
    assert len(samples[10]) == 10 and len(samples[50]) == 50 and samples[10] < samples[50]
    assert marked.filter("smallest_sample = 500").count() == 0 and marked.count() == 100


def test_random_split_sizes(spark):
    got = Counter(r.split for r in sp.random_split(docs(spark, 3465)).collect())
    assert got == {"train": 2772, "val": 346, "test": 347}


def test_cuts_beyond_the_broadcast_bound(spark, monkeypatch):
    df = docs(spark, 100, by_ranges((50, "a"), (80, "b"), (100, "c")))
    want = {r.doc_id for r in sp.stratified_split(df, test_size=10).filter("is_test").collect()}
    monkeypatch.setattr(sp, "MAX_BROADCAST_CUTS", 1)
    assert {r.doc_id for r in sp.stratified_split(df, test_size=10).filter("is_test").collect()} == want


def test_row_numbers_and_batches(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("id")).repartition(13)
    rows = od.global_row_number(df, ["id"]).collect()
    assert sorted((r.id, r.row_number) for r in rows) == [(7 * i, i + 1) for i in range(1000)]
    batches = Counter(r.batch for r in od.with_batch(df, 300, ["id"]).collect())
    assert batches == {0: 300, 1: 300, 2: 300, 3: 100}


def test_crawl_tally(spark):
    rows = od.crawl_tally(spark.range(100), F.col("id") % 3 == 0, ["id"]).orderBy("batch").collect()
    assert [tuple(r) for r in rows] == [(0, 14, 26, 14), (1, 13, 27, 27), (2, 7, 13, 34)]


def test_cap(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r.id for r in co.cap(df, 10, "id").collect()) == list(range(10))
    assert co.cap(df, 1000, "id").count() == 100


@pytest.mark.parametrize("unsure", ["string(NULL)", "''", "CASE WHEN doc_id > 120 THEN string(doc_id) END"])
def test_exact_sizes_for_any_ids(spark, unsure):
    df = docs(spark, 200, by_ranges((100, "a"), (200, "b"))).withColumn("url", F.expr(unsure))
    split = sp.stratified_split(df, id_col="url", test_size=20)
    assert split.columns == [*df.columns, "is_test"]
    assert Counter(r.source for r in split.filter("is_test").collect()) == {"a": 10, "b": 10}
    parts = sp.random_split(df, "url").collect()
    assert Counter(r.split for r in parts) == {"train": 160, "val": 20, "test": 20}
    assert len({r.doc_id for r in parts}) == 200
    samples = sp.nested_samples(df, "url", [50, 120, 500])
    assert [sp.sample_of(samples, n).count() for n in (50, 120)] == [50, 120]


def test_rows_without_class_stay_in_train(spark):
    df = docs(spark, 60, F.when(F.col("id") % 3 != 0, "a"))
    split = sp.stratified_split(df, test_size=10).collect()
    assert sum(r.is_test for r in split) == 10 and len(split) == 60
    assert not any(r.is_test for r in split if r.source is None)


def test_file_order_counts_parts_by_number(spark, tmp_path):
    for i, part in enumerate(("part-00002", "part-20000", "part-100000", "qart-1")):
        (tmp_path / f"{part}-c000.json").write_text(f'{{"v": {i}}}\n')
    lines = od.file_order(spark.read.schema("v int").json(str(tmp_path)))
    assert [r.v for r in lines.orderBy("file_order").collect()] == [0, 1, 2, 3]


def test_draw_without_ids_is_the_same_for_any_split(spark):
    """Rows without an id, or with repeated ones, are named by content: the drawn rows do not follow the partitions."""
    rows = [(None if i % 3 else i % 40, f"t{i % 90}", "ab"[i % 2], None) for i in range(300)] + [(7, "hot", "a", None)] * 150
    schema = "doc_id long, text string, source string, n int"
    whole = spark.createDataFrame(rows, schema)

    def drawn(df):
        split = sp.stratified_split(df, test_size=90).filter("is_test").drop("is_test").collect()
        nested = sp.nested_samples(df, sizes=(20, 60)).filter("smallest_sample = 20").collect()
        part = sp.random_split(df).filter("split = 'val'").collect()
        return [Counter(map(tuple, x)) for x in (split, [r[:4] for r in nested], [r[:4] for r in part])]

    first = drawn(whole.repartition(2))
    assert [sum(x.values()) for x in first] == [90, 20, 45]
    assert drawn(whole.repartition(5).orderBy("text")) == first


def test_columns_named_like_helpers_stay(spark):
    df = docs(spark, 40).withColumns({"_class": F.lit("x"), "_cut_test": F.lit("y"), "_cut_20": F.lit("z")})
    for made in (sp.stratified_split(df, test_size=4), sp.nested_samples(df, sizes=(20,)), sp.random_split(df)):
        assert {(r["_class"], r["_cut_test"], r["_cut_20"]) for r in made.collect()} == {("x", "y", "z")}
