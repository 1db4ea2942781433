"""Meetings of the members of groups of any size in tasks of bounded size.

The members of a group are dealt into pieces; each pair of pieces of a group is one block, and a member goes to all
blocks of its piece. Groups that fit one piece are one block. Blocks are gathered in bins by a hash, so a task holds
many small blocks or a few large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import partitions

PIECE_ROWS = 1024
BIN_ROWS = 20_000


def into_blocks(rows: DataFrame, sizes: DataFrame, key: str, node: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``piece``, ``lo``, ``hi`` and ``bin`` to rows of groups named by ``key``; ``sizes`` has (key, n) of the groups
    to keep. Runs a job that adds up the sizes."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bins = max(partitions(rows.sparkSession), -(-total // BIN_ROWS))
    pieces = F.ceil(F.col("n") / piece_rows).cast("int")
    dealt = rows.join(sizes.select(key, "n"), key).withColumn("_pieces", pieces)
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), node), "_pieces").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("n", "_pieces")
    dealt = dealt.withColumns({"lo": F.least("piece", "_other"), "hi": F.greatest("piece", "_other")}).drop("_other")
    return dealt.withColumn("bin", F.pmod(F.xxhash64(key, "lo", "hi"), F.lit(bins)))


def block_slices(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each block of a bin that has two rows or more."""
    order = np.lexsort((hi, lo, keys))
    k, a, b = keys[order], lo[order], hi[order]
    new = np.flatnonzero((k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    for start, end in zip(np.concatenate([[0], new]), np.concatenate([new, [len(k)]])):
        if end - start > 1:
            yield order[start:end]


def settle(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row reachable by links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new
