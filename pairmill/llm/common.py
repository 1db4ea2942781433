"""Helpers that several operators of this folder share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def worker_store() -> dict[str, Any]:
    """A dictionary that lives as long as the Python worker.

    Functions travel to the workers by value, so a global of their module would be made anew for every task.
    """
    return sys.modules.setdefault("_pairmill_worker", types.ModuleType("_pairmill_worker")).__dict__


def per_worker(kind: str, token: str, build: Callable[[], Any]) -> Any:
    """The worker's object of a kind, built at first use and whenever ``token`` has changed; the one before is let go."""
    store = worker_store()
    if store.get(kind, ("",))[0] != token:
        store.pop(kind, None)
        store[kind] = (token, build())
    return store[kind][1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) drawn by hashing ``parts``: the same for the same parts, in every run and engine.

    52 bits of an md5 plus one half, so neither 0 nor 1 comes up. NULL parts count as ''.
    """
    seed = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    digits = F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 52))


def digest128(c: Column) -> Column:
    """Sixteen bytes that stand for a text or binary value."""
    return F.unhex(F.md5(c.cast("binary")))


def digest256(c: Column) -> Column:
    """Thirty-two bytes (SHA-256) that stand for a text or binary value."""
    return F.unhex(F.sha2(c.cast("binary"), 256))


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """A key that is never NULL: the id, or the digest of the text where the id is missing."""
    by_text = F.concat(F.lit("text:"), F.md5(text_or_empty(text).cast("binary")))
    return F.coalesce(F.col(id_col).cast("string"), by_text)
