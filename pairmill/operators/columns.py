"""Projection helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later filters and projections read without evaluating them again.

    A filter on a plain projected column is pushed below the projection together with a copy of its
    expression, so a regex chain would run twice. A one-row ``inline`` keeps the value in place, and
    still runs inside whole-stage codegen.
    """
    row = F.struct(*(c.alias(name) for name, c in cols.items()))
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(row)))


def place_by(df: DataFrame, *keys: str) -> DataFrame:
    """Exchange rows by key into the session's number of shuffle partitions.

    The number is explicit because rows multiply after this exchange; left to itself, adaptive execution would
    merge partitions by the small size of the texts.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Those of ``cols`` that the table has."""
    return df.select(*(c for c in cols if c in df.columns))


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def drop_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where one of the columns equals ''; NULL is not '' and stays."""
    for c in cols:
        df = df.filter(F.col(c).isNull() | (F.col(c) != ""))
    return df


def attach(base: DataFrame, values: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Bring computed values to their rows by key; there is no positional assignment."""
    return base.join(values, key, how)


def remaining(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Queue items whose key is not finished yet; duplicates in the queue stay."""
    return queue.join(done.select(key), key, "left_anti")


def grow_done(done: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """The set of finished keys after another run."""
    return done.select(key).union(finished.select(key)).distinct()


def stack_systems(**systems: DataFrame) -> DataFrame:
    """Outputs of several systems as one long table with a ``system`` column."""
    stacked = None
    for name, df in systems.items():
        tagged = df.withColumn("system", F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    if stacked is None:
        raise ValueError("no systems given")
    return stacked


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows in input order; runs as a per-partition top-k and a small merge."""
    return df.orderBy(order).limit(n)


def cap(df: DataFrame, target: int, order: str) -> DataFrame:
    """Stop at a target row count: the first ``target`` rows by a unique ``order`` column.

    Only the order column is sorted (a top-k of ``target`` keys); whole rows are compared with the last key taken.
    """
    last = df.select(order).orderBy(order).limit(target).agg(F.max(order))
    return df.filter(F.col(order) <= last.scalar())


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores when the scan has fewer tasks than there are cores (a few small files with heavy
    expressions behind them). A large scan has more tasks than cores and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
