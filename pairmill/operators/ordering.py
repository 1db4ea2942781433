"""Input order, dense row numbers and fixed-size batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.session import freeze

# Row positions inside a partition take the low bits of monotonically_increasing_id().
POSITION_BITS = 33


def file_order(df: DataFrame) -> DataFrame:
    """Add ``file_order``, a sortable key of the input position of rows read from files.

    Order is file name, then position of the split in the file, then position of the row in the split, so it
    does not depend on how Spark packs splits into tasks. The first number in a name counts as a number: part 100000
    comes after part 20000. Call it directly on the reader's result.
    """
    path = F.col("_metadata.file_path")
    position = F.monotonically_increasing_id()
    key = F.struct(
        F.regexp_extract(path, r"^(.*/[^/0-9]*)", 1).alias("before_number"),
        F.regexp_extract(path, r"^.*/[^/0-9]*([0-9]{1,38})", 1).try_cast("decimal(38,0)").alias("number"),
        path.alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        position.alias("position"),
    )
    return df.withColumn("file_order", key)


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_number") -> DataFrame:
    """Dense 1-based row numbers over the whole table without a single-task window.

    Rows are range-partitioned and sorted, written once (so both readings below see the same partitions),
    numbered inside their partition, and shifted by the row count of the partitions before. Only the
    per-partition counts meet in one task. Pass narrow rows and join wide columns back by key.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = freeze(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", POSITION_BITS)
    position = F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One offset row per partition of the range exchange, so broadcasting is bounded by the partition count.
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + position + 1).drop("_at", "_part", "_offset")


def with_batch(df: DataFrame, n: int, order: Sequence[str | Column], name: str = "batch") -> DataFrame:
    """Number consecutive groups of ``n`` rows, starting at 0."""
    numbered = global_row_number(df, order, "_row")
    return numbered.withColumn(name, F.expr(f"(_row - 1) div {int(n)}")).drop("_row")


def batch_requests(df: DataFrame, id_col: str, n: int = 50) -> DataFrame:
    """One request string per batch of ``n`` ids: the ids in order, joined by a bar."""
    batched = with_batch(df.select(id_col), n, [id_col])
    ids = F.transform(F.array_sort(F.collect_list(id_col)), lambda i: i.cast("string"))
    return batched.groupBy("batch").agg(F.array_join(ids, "|").alias("request"), F.count("*").alias("n_ids"))


def crawl_tally(df: DataFrame, accepted: Column, order: Sequence[str], n: int = 40) -> DataFrame:
    """Accepted and skipped rows per batch of ``n``, and the accepted total so far.

    The running total is taken over batches with the same range-and-shift scheme as row numbers, so it stays
    distributed for any number of batches.
    """
    batched = with_batch(df.select(*order, accepted.alias("_ok")), n, list(order))
    per_batch = batched.groupBy("batch").agg(
        F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("skipped")
    )
    return running_total(per_batch, "batch", "accepted", "accepted_total")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` in ``order`` without a single-task window."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order)
    placed = freeze(placed.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", POSITION_BITS))
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("_at")
    total = F.col("_offset") + F.sum(value).over(inside)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, total).drop("_at", "_part", "_offset")
