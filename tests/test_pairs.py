"""Filter, deduplication and profiles on small inputs."""

import pytest
from pyspark.sql import functions as F

from pairmill.operators import columns as co
from pairmill.operators import pairs as pr
from pairmill.operators import profile as pf
from pairmill.plans import publish as pb
from pairmill.plans.prepare import clean_pairs, prepare_corpus


def test_first_copy_is_kept_in_a_hot_group(spark):
    # Most rows are copies of one text, spread over all partitions.
    df = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("copy").alias("text_clean")
    ).repartition(11)
    kept = {r.doc_id for r in pr.drop_duplicates(df).collect()}
    assert kept == {i for i in range(2000) if i % 3 == 0} | {1}
    plan = pr.drop_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    # The group limit runs before the shuffle as well.
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Partial")


def test_text_chain_runs_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    plan = clean_pairs(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("&[a-z]+;") == 1


def test_quality_thresholds(spark):
    rows = [
        (200, 20, 10.0, "s", "t"), (199, 20, 9.9, "s", "t"), (200, 19, 10.0, "s", "t"), (200, 70, 2.9, "s", "t"),
        (0, 0, 0.0, "", ""),
    ]
    df = spark.createDataFrame(rows, "text_words int, summary_words int, compression double, summary string, text_clean string")
    df = df.withColumn("source", F.lit("wiki"))
    assert pr.quality_filter(df).count() == 1
    assert pr.quality_filter(df, exempt_sources=("wiki",)).count() == 4


def test_empty_text_has_compression_zero(spark):
    row = pr.derive_pairs(spark.createDataFrame([(None, "x")], "text string, source string")).first()
    assert (row.text_clean, row.summary, row.text_words, row.summary_words, row.compression) == ("", "", 0, 0, 0.0)


def test_attrition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    row = pr.quality_report(pr.derive_pairs(docs)).first()
    assert row.before == docs.count() and row.after == clean_pairs(docs).count()
    assert pr.quality_report(pr.derive_pairs(docs.filter("false"))).first().dropped_pct is None


def test_predicates(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "id int, t string")
    assert [r.id for r in co.drop_empty(df, ["t"]).collect()] == [2, 3]
    assert [r.id for r in co.drop_null(df, ["t"]).collect()] == [1, 3]
    assert pf.top_categories(df) is None


def test_prepare_corpus(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("lang").alias("source"))
    reports = prepare_corpus(docs, str(tmp_path / "out"), test_size=20, sizes=(10, 30, 10**6))
    total = reports["attrition"].first().after

    def rows(name):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out" / name))

    assert rows("test").count() == 20 and rows("train_full").count() == total - 20
    assert rows("train_10").count() == 10 and rows("train_30").count() == 30
    assert not (tmp_path / "out" / "train_1000000").exists()
    assert rows("test").columns == ["text", "summary", "source", "text_words", "summary_words"]
    assert reports["by_source"].agg(F.sum("n")).first()[0] == total


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_first_copies(spark, monkeypatch, few):
    """A hot text, NULL and empty texts, NULL and repeated ids, rows that repeat as a whole, a column of a clashing name."""
    monkeypatch.setattr(pr, "MOST_BROADCAST_ROWS", few)
    rows = [(i, "copy" if i % 3 else f"text {i}", i) for i in range(300)]
    rows += [(None, "copy", -1), (7, None, -2), (5, None, -3), (9, "", -4), (400, "twice", -5), (400, "twice", -5), (3, "other", -6)]
    df = spark.createDataFrame(rows, "doc_id long, text_clean string, first int").repartition(7)
    kept = pr.first_copies(df)
    assert kept.columns == df.columns
    want = [(i, f"text {i}", i) for i in range(0, 300, 3)]
    want += [(None, "copy", -1), (5, None, -3), (9, "", -4), (400, "twice", -5), (3, "other", -6)]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    assert sorted(map(str, pr.drop_duplicates(df).collect())) == sorted(map(str, kept.collect()))
    assert pr.first_copies(df.limit(0)).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and ("Exchange hash" in plan) == (few == 0)


def test_versions_become_visible_together(spark, tmp_path):
    """A run that fails leaves the version before it; the next one takes its place whole."""
    out = str(tmp_path / "corpus")
    assert pb.current(spark, out) is None

    def job(n, fail=False):
        def write(folder):
            spark.range(n).write.parquet(f"{folder}/a")
            if fail:
                raise RuntimeError("lost")
            spark.range(n * 2).write.parquet(f"{folder}/b")

        return write

    first = pb.publish(spark, out, job(3))
    assert pb.current(spark, out) == first
    with pytest.raises(RuntimeError):
        pb.publish(spark, out, job(5, fail=True))
    assert pb.current(spark, out) == first
    second = pb.publish(spark, out, job(5))
    assert pb.current(spark, out) == second != first
    assert spark.read.parquet(f"{second}/b").count() == 10 and spark.read.parquet(f"{first}/a").count() == 3
    assert sorted(r.version for r in pb.versions(spark, out).collect()) == [1, 2]
