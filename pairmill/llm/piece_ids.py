"""SentencePiece encoding and decoding through a table of distinct chunks.

Documents are dealt into blocks by a hash of the whole row. Each block names its distinct chunks once; the chunks of
all blocks meet by a hash of the chunk, where every distinct one is segmented once; the ids return to the block, which
joins them at the positions of its texts. So the shuffles carry every text once and every chunk once per block, in
packed lists, and never a row per token.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.llm.common import partitions, text_or_empty
from pairmill.llm.pieces import chunks, encode_chunks, open_model

# Bytes of text per block, if that asks for more blocks than there are shuffle partitions.
BLOCK_BYTES = 32 << 20


def _by_bucket(keys: set[str], buckets: int) -> dict[int, list[str]]:
    """The chunks of a block by bucket, each list in order."""
    found = defaultdict(list)
    for key in sorted(keys):
        found[zlib.crc32(key.encode()) % buckets].append(key)
    return found


def _pack_ids(ids: Sequence[Sequence[int]], kind: str) -> bytes:
    lengths = np.fromiter(map(len, ids), dtype="<u4", count=len(ids))
    flat = np.fromiter((i for one in ids for i in one), dtype=kind, count=int(lengths.sum()))
    return zlib.compress(lengths.tobytes() + flat.tobytes(), 5)


def _unpack_ids(blob: bytes, n: int, kind: str) -> list[bytes]:
    """The ids of ``n`` chunks as bytes, four for each id."""
    packed = zlib.decompress(blob)
    ends = (np.cumsum(np.frombuffer(packed, dtype="<u4", count=n)) * 4).tolist()
    flat = np.frombuffer(packed, dtype=kind, offset=4 * n).astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def encode_documents(
    df: DataFrame,
    model_path: str,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep``, then ``ids`` (unsigned 32-bit integers, little-endian, with begin and end id) and
    ``decoded`` (what the library decodes from them) for each whole text.

    NULL counts as an empty text, whose ids are begin and end and which decodes to ''. Repeated rows stay, an empty
    table gives an empty table, columns outside ``keep`` are left out. Raises ValueError if pieces of the model cross
    chunk borders. Runs a job that sums text bytes when called.
    """
    spark = df.sparkSession
    proto = Path(model_path).read_bytes()
    kind = "<u2" if open_model(proto).get_piece_size() <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(proto)
    rows = df.select(*keep, text_or_empty(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(partitions(spark), -(-size // block_bytes))
    placed = rows.withColumn("_block", F.pmod(F.xxhash64(*keep, "_text"), F.lit(blocks)).cast("int"))
    placed = placed.repartition(blocks, "_block")
    at, of = len(keep), len(keep) + 1

    def name_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, set[str]] = defaultdict(set)
        for batch in batches:
            for one, where in zip(batch.column(at), batch.column(of)):
                found[where.as_py()].update(chunks(one.as_py()))
        for where in list(found):
            lists = _by_bucket(found.pop(where), blocks)
            packed = [zlib.compress(" ".join(keys).encode(), 5) for keys in lists.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(lists), pa.int32()), pa.array([where] * len(lists), pa.int32()), pa.array(packed, pa.binary())],
                ["_bucket", "_block", "_keys"],
            )

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = open_model(shared.value), {}
        for batch in batches:
            packed = []
            for blob in batch.column(2):
                keys = zlib.decompress(blob.as_py()).decode().split(" ")
                new = [k for k in keys if k not in known]
                known.update(zip(new, encode_chunks(model, new)))
                packed.append(_pack_ids([known[k] for k in keys], kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array(packed, pa.binary())], ["_block", "_bucket", "_ids"]
            )

    lists = placed.mapInArrow(name_chunks, "_bucket int, _block int, _keys binary")
    segmented = lists.repartition(blocks, "_bucket").mapInArrow(segment, "_block int, _bucket int, _ids binary")
    out = T.StructType(
        [*(rows.schema[c] for c in keep), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    )

    def join_ids(texts: pa.Table, ids: pa.Table) -> pa.Table:
        model = open_model(shared.value)
        begin = model.bos_id().to_bytes(4, "little")
        end = model.eos_id().to_bytes(4, "little")
        found: set[str] = set()
        for text in texts.column("_text"):
            found.update(chunks(text.as_py()))
        lists = _by_bucket(found, blocks)
        del found
        table: dict[str, bytes] = {}
        for bucket, blob in zip(ids.column("_bucket"), ids.column("_ids")):
            keys = lists.pop(bucket.as_py())
            table.update(zip(keys, _unpack_ids(blob.as_py(), len(keys), kind)))
        coded, plain = [], []
        for text in texts.column("_text"):  # cut again, as the chunks of a whole block take several times its size
            one = chunks(text.as_py())
            coded.append(begin + b"".join(map(table.__getitem__, one)) + end)
            plain.append(model.decode(np.frombuffer(coded[-1], "<u4").tolist()))
        columns = [texts.column(c) for c in keep]
        return pa.table([*columns, pa.array(coded, pa.binary()), pa.array(plain, pa.string())], names=out.names)

    return placed.groupBy("_block").cogroup(segmented.groupBy("_block")).applyInArrow(join_ids, out)


def decode_documents(df: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the text that the library decodes from ``ids`` (unsigned 32-bit integers, little-endian). NULL stays NULL."""
    shared = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = open_model(shared.value)
        for batch in batches:
            found = [None if b is None else model.decode(np.frombuffer(b, "<u4").tolist()) for b in batch.to_pylist()]
            yield pa.array(found, pa.string())

    return df.withColumn(name, decode(F.col(ids)))
