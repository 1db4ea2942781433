"""Token counts by a two-tier lookup on the map side.

Tier one is a table of the most frequent chunks with their lengths in tokens, the same in every task. It is found by
mergeable frequency summaries over all texts: each task reduces what it reads to one summary row of bounded size, and
two rounds of merging leave one. Tier two is a cache in each Python worker for the chunks that the table lacks. No
chunk is ever shuffled; the result depends on neither tier.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import batched
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import per_worker
from pairmill.llm.pieces import chunks, encode_chunks, open_model

# Entries of a frequency summary and of the broadcast table: about half a megabyte.
TABLE_SIZE = 32_768
# Entries that a worker's cache holds before it starts afresh.
CACHE_SIZE = 500_000


def _shrink(counts: Counter, size: int) -> Counter:
    """At most ``size`` entries: the count of the first that has to go is taken from all. What is frequent in the
    whole stays through any number of merges."""
    if len(counts) <= size:
        return counts
    least = heapq.nlargest(size + 1, counts.values())[-1]
    return Counter({k: v - least for k, v in counts.items() if v > least})


def _pack(counts: Counter) -> bytes:
    keys = " ".join(counts).encode()
    values = np.fromiter(counts.values(), dtype="<i8", count=len(counts)).tobytes()
    return zlib.compress(len(keys).to_bytes(8, "little") + keys + values, 1)


def _unpack(blob: bytes) -> Counter:
    blob = zlib.decompress(blob)
    end = 8 + int.from_bytes(blob[:8], "little")
    values = np.frombuffer(blob[end:], dtype="<i8").tolist()
    return Counter(dict(zip(blob[8:end].decode().split(" "), values))) if values else Counter()


def frequent_chunks(texts: DataFrame, col: str = "text", size: int = TABLE_SIZE) -> list[str]:
    """The most frequent chunks of all texts, at most ``size``."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(chunks(text.as_py() or ""))
                if len(counts) > 16 * size:
                    counts = _shrink(counts, 4 * size)
        yield pa.RecordBatch.from_pydict({"summary": pa.array([_pack(_shrink(counts, size))], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0):
                counts = _shrink(counts + _unpack(blob.as_py()), 2 * size)
        yield pa.RecordBatch.from_pydict({"summary": pa.array([_pack(_shrink(counts, size))], pa.binary())})

    summaries = texts.select(col).mapInArrow(summarize, "summary binary")
    # One row per task of the scan; a square-root tree keeps either round small.
    width = max(1, int(texts.rdd.getNumPartitions() ** 0.5))
    merged = summaries.repartition(width).mapInArrow(merge, "summary binary")
    rows = merged.coalesce(1).mapInArrow(merge, "summary binary").collect()
    total: Counter = Counter()
    for row in rows:  # one row
        total.update(_unpack(bytes(row["summary"])))
    return [k for k, _ in heapq.nsmallest(size, total.items(), key=lambda e: (-e[1], e[0]))]


class Lengths:
    """Tokens of chunks: the broadcast table, and a cache of bounded size for what it lacks."""

    def __init__(self, frequent: dict[str, int], model, cache_size: int) -> None:
        self.frequent, self.model, self.most = frequent, model, len(frequent) + cache_size
        self.known = dict(frequent)

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text. What a slice of texts lacks is encoded in one call."""
        found = []
        for some in batched(texts, 256):
            cut = [chunks(t) if t else [] for t in some]
            new = {k for one in cut for k in one if k not in self.known}
            if len(self.known) + len(new) > self.most:
                self.known = dict(self.frequent)
                new = {k for one in cut for k in one if k not in self.known}
            keys = list(new)
            self.known.update((k, len(ids)) for k, ids in zip(keys, encode_chunks(self.model, keys)))
            found += [sum(map(self.known.__getitem__, one)) for one in cut]
        return found


def count_tokens(
    df: DataFrame,
    model_path: str,
    text: str = "text",
    name: str = "n_tokens",
    table_size: int = TABLE_SIZE,
    cache_size: int = CACHE_SIZE,
) -> DataFrame:
    """Add the number of SentencePiece tokens of each whole text, without begin and end tokens.

    NULL and empty texts have 0. Other columns pass through; one that is already called ``name`` is replaced. Repeated
    rows stay. An empty table gives an empty table. Runs a job over all texts when called.
    """
    proto = Path(model_path).read_bytes()
    model = open_model(proto)
    keys = frequent_chunks(df, text, table_size)
    table = {k: len(ids) for k, ids in zip(keys, encode_chunks(model, keys))}
    shared, token = df.sparkSession.sparkContext.broadcast((proto, table)), uuid.uuid4().hex

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def build() -> Lengths:
            proto, table = shared.value
            return Lengths(table, open_model(proto), cache_size)

        known = per_worker("lengths", token, build)
        for batch in batches:
            yield pd.Series(known.count(batch), dtype="int64")

    return df.withColumn(name, lengths(F.col(text)))

