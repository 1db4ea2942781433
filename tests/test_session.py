"""What written intermediate results leave on disk."""

import time

import pytest
from pyspark.sql import functions as F

from pairmill.llm.order_minhash import near_classes
from pairmill.session import SHUFFLES_GO, freeze


def shuffle_files(spark) -> set[str]:
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def left_by(spark, work) -> int:
    """Shuffle files that ``work`` leaves; those that go are given some seconds, as Spark deletes them in the background."""
    before = shuffle_files(spark)
    held = work()
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert held is not None
    return len(left)


def counted(spark):
    return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))


def test_freeze_leaves_no_shuffle_files(spark):
    assert left_by(spark, lambda: freeze(counted(spark))) == 0


@pytest.mark.parametrize("given", [None, "false", "true"])
def test_freeze_keeps_the_setting_and_the_rows(spark, given):
    if given is not None:
        spark.conf.set(SHUFFLES_GO, given)
    before = spark.conf.get(SHUFFLES_GO, None)
    try:
        df = counted(spark)
        want = sorted(map(tuple, df.collect()))
        # A plan that ran before is frozen twice, and runs again: its rows stay the same.
        first, again = freeze(df), freeze(df)
        assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) == want
        assert sorted(map(tuple, df.collect())) == want
        with pytest.raises(Exception, match="stop here"):
            freeze(spark.range(1).select(F.raise_error(F.lit("stop here"))))
        assert spark.conf.get(SHUFFLES_GO, None) == before
    finally:
        spark.conf.unset(SHUFFLES_GO)


def test_freeze_keeps_columns_of_one_name(spark):
    df = spark.createDataFrame([(1, 2, None)], "x int, x int, `a.b` string")
    assert freeze(df).columns == ["x", "x", "a.b"] and list(freeze(df).first()) == [1, 2, None]


def test_rounds_of_near_copies_leave_few_shuffle_files(spark):
    """Only sums that are read at once leave some; rounds over edges and texts leave none."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} x{i % 40} y{i % 7}") for i in range(120)] + [(200 + i, f"other{i} text{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []

    def work():
        made.append(near_classes(df))
        return made

    # 92 when shuffle files stayed until the driver collected its garbage.
    assert left_by(spark, work) <= 30
    kept = [r.id for r in made[0].filter("kept").collect()]
    assert sorted(kept) == [0, *range(200, 220)]
