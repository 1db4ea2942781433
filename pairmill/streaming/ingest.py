"""Resumable ingestion of article files.

The checkpoint plays the part of a progress file: it records which input files are finished. An interrupted run
continues with the next unfinished batch, a failed one is repeated, and no article is written twice: sinks are idempotent
by the number of the batch, and finished keys are a table, not state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from pairmill.session import freeze


def read_article_stream(
    spark: SparkSession,
    in_dir: str,
    schema: str | StructType,
    fmt: str = "json",
    files_per_batch: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """A stream of rows from files that appear in ``in_dir``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(in_dir)


@dataclass(frozen=True)
class KeyedSink:
    """Writes of every micro-batch the rows whose key was not written before, and the keys themselves.

    ``<done_dir>/batch=<n>/bucket=<b>`` holds the keys finished in batch ``n``, dealt by a hash of the key. A batch reads
    only the buckets that its own keys fall into, and only those of earlier batches; so a batch that is repeated after a
    failure finds the same keys fresh and overwrites its own folders with the same rows. Every ``compact_every`` batches
    the folders are merged into ``upto=<n>``, so that their number stays bounded. No key is held in memory or in state.
    """

    out_dir: str
    done_dir: str
    key: str
    transform: Callable[[DataFrame], DataFrame]
    order: Sequence[str] = ()
    finished: Column | None = None
    fmt: str = "json"
    buckets: int = 64
    compact_every: int = 32

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(self.key).isNotNull())
        if self.finished is not None:
            rows = rows.filter(self.finished)
        # One row per key. The row-number limit also runs before the exchange, so a hot key leaves each task as one row.
        content = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in batch.columns))), 256)
        first = Window.partitionBy(self.key).orderBy(*self.order, content)
        rows = rows.withColumn("__pm_nth", F.row_number().over(first)).filter("__pm_nth = 1").drop("__pm_nth")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = freeze(rows.withColumn("__pm_bucket", bucket))

        if number and number % self.compact_every == 0:
            self._compact(spark, number, rows.schema[self.key])
        touched = [r[0] for r in rows.select("__pm_bucket").distinct().collect()]  # at most as many as there are buckets
        named = rows.select(F.col(self.key).alias("key"), F.col("__pm_bucket").alias("bucket"))
        done = self._done(spark, number, rows.schema[self.key])
        if done is not None:
            named = named.join(done.filter(F.col("bucket").isin(touched)), ["bucket", "key"], "left_anti")
        own = f"{self.done_dir}/batch={number}"
        named.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(own)

        keys = self._read(spark, [own], rows.schema[self.key]).select(F.col("key").alias("__pm_key"))
        fresh = rows.join(keys, F.col(self.key) == F.col("__pm_key"), "left_semi").drop("__pm_bucket")
        self.transform(fresh).write.mode("overwrite").format(self.fmt).save(f"{self.out_dir}/batch={number}")

    def _read(self, spark: SparkSession, paths: Sequence[str], key: StructField) -> DataFrame:
        schema = StructType([StructField("key", key.dataType), StructField("bucket", IntegerType())])
        # Folders of different names, so each is a table of its own.
        return reduce(DataFrame.union, (spark.read.schema(schema).parquet(p) for p in paths))

    def _folders(self, spark: SparkSession, before: int) -> tuple[list[str], list[str]]:
        """Folders that hold the keys of all batches before a number, and older ones whose keys have been merged."""
        place = spark._jvm.org.apache.hadoop.fs.Path(self.done_dir)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        numbers = {kind: sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=")) for kind in ("batch", "upto")}
        path = spark._jvm.org.apache.hadoop.fs.Path
        merged = [n for n in numbers["upto"] if n <= before and files.exists(path(f"{self.done_dir}/upto={n}/_SUCCESS"))]
        start = merged[-1] if merged else 0
        used = [f"{self.done_dir}/upto={n}" for n in merged[-1:]]
        used += [f"{self.done_dir}/batch={n}" for n in numbers["batch"] if start <= n < before]
        past = [f"{self.done_dir}/upto={n}" for n in numbers["upto"] if n < start]
        return used, past + [f"{self.done_dir}/batch={n}" for n in numbers["batch"] if n < start]

    def _done(self, spark: SparkSession, before: int, key: StructField) -> DataFrame | None:
        used, _ = self._folders(spark, before)
        return self._read(spark, used, key) if used else None

    def _compact(self, spark: SparkSession, number: int, key: StructField) -> None:
        """All keys of earlier batches in one folder. Folders merged before are deleted: the batches they serve are over."""
        merged = f"{self.done_dir}/upto={number}"
        used, _ = self._folders(spark, number)
        if used and used != [merged]:
            done = self._read(spark, used, key).repartition("bucket")
            done.write.mode("overwrite").partitionBy("bucket").parquet(merged)
        for old in self._folders(spark, number)[1]:
            place = spark._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ingest_stream(
    articles: DataFrame,
    out_dir: str,
    checkpoint: str,
    key: str = "url",
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    fmt: str = "json",
    done_dir: str | None = None,
    **options,
) -> StreamingQuery:
    """Process everything available, then stop. Starting it again with the same folders continues.

    Each key is processed once, in this run or an earlier one: the first batch that has it wins, and inside a batch the first
    row by the columns ``order`` (in their absence, and among equals, by the row's content, so a repeated batch chooses alike).
    Rows without a key, and rows that are not ``finished`` (a condition; a page to be fetched again), are passed over and do
    not count as done. ``transform`` prepares the chosen rows (page extraction, cleaning, word limit); a key whose row it
    drops is done all the same. Rows come to stand in ``<out_dir>/batch=<n>``, finished keys in ``done_dir`` (by default
    ``<out_dir>-done``). ``options`` go to :class:`KeyedSink`.
    """
    sink = KeyedSink(out_dir, done_dir or f"{out_dir.rstrip('/')}-done", key, transform, fmt=fmt, **options)
    return (
        articles.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def snapshot_stream(
    articles: DataFrame, out_dir: str, checkpoint: str, not_null: str = "text", fmt: str = "json"
) -> StreamingQuery:
    """Write the rows of every micro-batch that have a value in ``not_null`` under ``batch=<number>``.

    The folders written so far are the snapshot. A repeated batch overwrites its own folder, so a retry leaves the
    same files.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.filter(F.col(not_null).isNotNull()).write.mode("overwrite").format(fmt).save(f"{out_dir}/batch={number}")

    return (
        articles.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
