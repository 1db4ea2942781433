"""Reproducible splits and samples.

Rows are ordered by md5(seed, id). Every split or sample is "the first k rows of that order", so all that
is needed is the key of the k-th row: a *cut*. Cuts are found on narrow (class, key, id) rows with counts per
leading key digits; afterwards the wide rows are only compared with their cut. No wide row is shuffled or
sorted, and a class holding any share of the table is spread over all its key buckets.

An id that is NULL or stands in several rows cannot tell rows apart. If ``id_col`` holds such ids, rows are named by the
digest of their content and their number among equal rows, and the named table is written to the checkpoint folder: sizes
stay exact, and the drawn rows are the same however the input is split. The functions run small jobs when called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions.text import seeded_key
from pairmill.session import freeze

# At most this many cuts are broadcast; above it the cuts are joined by shuffle.
MAX_BROADCAST_CUTS = 50_000
# Leading hex digits of the key that name a bucket: 16 ** 3 buckets per class.
BUCKET_DIGITS = 3
ROW = "__pm_row"


def _identified(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The table and the column that names its rows: ``id_col``, or a name made of the row's content where ids are NULL or
    repeated."""
    per_id = df.groupBy(id_col).agg(F.count("*").alias("n"))
    if per_id.filter((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty():
        return df, id_col
    return freeze(_named_by_content(df)), ROW


def _named_by_content(df: DataFrame) -> DataFrame:
    """Add the digest of the row's content and its number among equal rows: the same names however the table is split.

    Equal rows are numbered inside their input split, and each split's numbers follow those of the splits before it, so
    that a row which fills a large part of the table is not numbered in one task.
    """
    content = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    rows = freeze(df.withColumns({"__pm_digest": F.sha2(content, 256), "__pm_split": F.spark_partition_id()}))
    same = ["__pm_digest", "__pm_split"]
    before = Window.partitionBy("__pm_digest").orderBy("__pm_split")
    counts = rows.groupBy(*same).agg(F.count("*").alias("__pm_n"))
    offsets = counts.withColumn("__pm_before", F.sum("__pm_n").over(before) - F.col("__pm_n")).drop("__pm_n")
    numbered = rows.withColumn("__pm_nth", F.row_number().over(Window.partitionBy(*same).orderBy("__pm_digest")))
    named = numbered.join(offsets, same)
    name = F.concat_ws(":", "__pm_digest", (F.col("__pm_before") + F.col("__pm_nth")).cast("string"))
    return named.withColumn(ROW, name).select(*(F.col(f"`{c}`") for c in df.columns), ROW)


def _keyed(df: DataFrame, id_col: str, by: str | None, seed: int) -> DataFrame:
    group = F.col(by) if by is not None else F.lit("")
    keyed = df.select(group.alias("_class"), F.col(id_col).alias("_id"), seeded_key(id_col, seed).alias("_key"))
    return keyed.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))


def _bucket_counts(keyed: DataFrame) -> DataFrame:
    """Rows per (class, bucket) with the number of rows before and up to the bucket. Small; written once."""
    running = Window.partitionBy("_class").orderBy("_bucket")
    counts = keyed.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(running))
    return freeze(upto.withColumn("_before", F.col("_upto") - F.col("_n")))


def _cuts(keyed: DataFrame, buckets: DataFrame, targets: DataFrame) -> DataFrame:
    """For targets (class, label, rank) the key and id of the row with that rank in its class."""
    hit = targets.join(buckets, "_class").filter((F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_upto")))
    hit = hit.select("_class", "_bucket", "label", (F.col("rank") - F.col("_before")).alias("_want"))
    # One line per class and bucket that holds a cut; with it in every task, only rows of these buckets are moved.
    wanted = hit.groupBy("_class", "_bucket").agg(F.collect_list(F.struct("label", "_want")).alias("_wants"))
    wanted = _broadcast_if_small(freeze(wanted))
    order = Window.partitionBy("_class", "_bucket").orderBy("_key", "_id")
    ranked = keyed.join(wanted, ["_class", "_bucket"]).withColumn("_nth", F.row_number().over(order))
    picked = ranked.select("_class", "_key", "_id", "_nth", F.inline("_wants")).filter("_nth = _want")
    return freeze(picked.select("_class", "label", F.col("_key").alias("cut_key"), F.col("_id").alias("cut_id")))


def _broadcast_if_small(lines: DataFrame) -> DataFrame:
    few = lines.limit(MAX_BROADCAST_CUTS + 1).count() <= MAX_BROADCAST_CUTS
    return F.broadcast(lines) if few else lines


def _with_cuts(df: DataFrame, cuts: DataFrame, by: str | None, labels: Sequence[str]) -> DataFrame:
    """One row of cuts per class, one column per label, joined to the rows of the class."""
    per_class = cuts.groupBy("_class").agg(
        *(
            F.max(F.when(F.col("label") == v, F.struct("cut_key", "cut_id"))).alias(f"__pm_cut_{v}")
            for v in labels
        )
    )
    per_class = _broadcast_if_small(per_class.withColumnRenamed("_class", "__pm_class"))
    group = F.col(by) if by is not None else F.lit("")
    return df.withColumn("__pm_class", group).join(per_class, "__pm_class", "left").drop("__pm_class")


def _within(id_col: str, seed: int, label: str) -> Column:
    """True for rows at or before the cut."""
    key, cut = seeded_key(id_col, seed), F.col(f"__pm_cut_{label}")
    before = (key < cut["cut_key"]) | ((key == cut["cut_key"]) & (F.col(id_col) <= cut["cut_id"]))
    return F.coalesce(before, F.lit(False))


def stratified_quotas(class_counts: DataFrame, test_size: int) -> DataFrame:
    """Test rows per class for (class, n) counts.

    The train part is apportioned by largest remainder (ties by class name), the test part is the rest.
    Raises when a class has fewer than two rows or a part is smaller than the number of classes.
    """
    stats = class_counts.agg(
        F.count("*").alias("classes"), F.min("n").alias("least"), F.sum("n").alias("total")
    ).first()
    train_size = (stats["total"] or 0) - test_size
    if stats["least"] is None or stats["least"] < 2:
        raise ValueError("every class needs at least two rows")
    if min(test_size, train_size) < stats["classes"]:
        raise ValueError("test and train part must each hold at least one row per class")
    # Whole-number arithmetic: the share of a class is n * train_size / total.
    exact = F.col("n").cast("decimal(19,0)") * F.lit(train_size).cast("decimal(19,0)")
    total = F.lit(stats["total"]).cast("decimal(19,0)")
    shares = class_counts.select(
        "_class",
        "n",
        F.floor((exact - exact % total) / total).cast("long").alias("base"),
        (exact % total).alias("rest"),
    )
    # One row per class, at most test_size of them.
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "_class")
    short = F.lit(train_size) - F.sum("base").over(Window.partitionBy(F.lit(0)))
    extra = F.when(F.row_number().over(by_rest) <= short, 1).otherwise(0)
    return shares.select("_class", (F.col("n") - F.col("base") - extra).alias("quota"))


def stratified_split(
    df: DataFrame, by: str = "source", id_col: str = "doc_id", test_size: int = 2000, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: an exact-size test part, proportional per class of ``by``.

    Rows whose class is NULL take no part in the draw and stay in the train part.
    """
    df, id_col = _identified(df, id_col)
    keyed = _keyed(df, id_col, by, seed).filter(F.col("_class").isNotNull())
    buckets = _bucket_counts(keyed)
    quotas = stratified_quotas(buckets.groupBy("_class").agg(F.sum("_n").alias("n")), test_size)
    targets = quotas.select("_class", F.lit("test").alias("label"), F.col("quota").alias("rank"))
    cuts = _cuts(keyed, buckets, targets.filter("rank > 0"))
    marked = _with_cuts(df, cuts, by, ["test"]).withColumn("is_test", _within(id_col, seed, "test"))
    return marked.drop("__pm_cut_test", ROW)


def nested_samples(
    df: DataFrame, id_col: str = "doc_id", sizes: Sequence[int] = (5_000, 20_000, 50_000, 100_000), seed: int = 42
) -> DataFrame:
    """Add ``smallest_sample``: the smallest of ``sizes`` whose sample holds the row, NULL when only the
    full table does. Samples are prefixes of one order, hence nested; sizes beyond the table are skipped.
    """
    df, id_col = _identified(df, id_col)
    keyed = _keyed(df, id_col, None, seed)
    buckets = _bucket_counts(keyed)
    sizes = sorted(sizes)
    targets = df.sparkSession.createDataFrame([("", str(n), n) for n in sizes], "_class string, label string, rank long")
    cuts = _cuts(keyed, buckets, targets)
    labels = [str(n) for n in sizes]
    marked = _with_cuts(df, cuts, None, labels)
    smallest = F.coalesce(*(F.when(_within(id_col, seed, v), F.lit(int(v))) for v in labels))
    return marked.withColumn("smallest_sample", smallest).drop(*(f"__pm_cut_{v}" for v in labels), ROW)


def sample_of(samples: DataFrame, n: int) -> DataFrame:
    """The sample of size ``n`` from the result of :func:`nested_samples`."""
    return samples.filter(F.col("smallest_sample") <= n).drop("smallest_sample")


def random_split(
    df: DataFrame,
    id_col: str = "doc_id",
    weights: Sequence[float] = (0.8, 0.1, 0.1),
    names: Sequence[str] = ("train", "val", "test"),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: consecutive parts of one random order, cut at floor(cumulative weight * n)."""
    df, id_col = _identified(df, id_col)
    keyed = _keyed(df, id_col, None, seed)
    buckets = _bucket_counts(keyed)
    total = buckets.agg(F.sum("_n")).first()[0] or 0
    ends, share = [], 0.0
    for name, weight in zip(names[:-1], weights[:-1]):
        share += weight
        ends.append(("", name, int(share * total + 1e-9)))
    targets = df.sparkSession.createDataFrame(ends, "_class string, label string, rank long")
    cuts = _cuts(keyed, buckets, targets.filter("rank > 0"))
    labels = list(names[:-1])
    marked = _with_cuts(df, cuts, None, labels)
    part = F.coalesce(*(F.when(_within(id_col, seed, v), F.lit(v)) for v in labels), F.lit(names[-1]))
    return marked.withColumn("split", part).drop(*(f"__pm_cut_{v}" for v in labels), ROW)
