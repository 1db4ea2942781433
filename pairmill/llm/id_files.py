"""Token ids as binary files: one concatenated id array per segment, with Elias-Fano coded document boundaries.

Documents are range-partitioned and sorted by id, so the segments of all parts, taken in order of (part, segment), hold
the ids of all documents in ascending order of document id. Segments are rows of a Parquet table, because only Spark's
writers reach every store; the payload of a row is self-contained:

    boundaries  Elias-Fano code of the n_docs + 1 offsets into the id array
    ids         little-endian unsigned integers of ``id_bytes`` bytes: two where the vocabulary allows, else four
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from pairmill.llm import elias_fano
from pairmill.llm.common import per_worker, text_or_empty

# Ids after which a segment is closed. A document is never split.
SEGMENT_IDS = 4_000_000
# Words and pre-tokens that a worker's cache holds before it starts afresh.
CACHE_SIZE = 500_000
# Characters below this one are cut by a pattern here, others by the library.
PLAIN_END = 0x250


class PartIds(dict):
    """The ids of pre-tokens as bytes, by the model at first sight."""

    def __init__(self, tokenizer: Tokenizer, id_bytes: int, cache_size: int) -> None:
        super().__init__()
        self.tokenize, self.most = tokenizer.model.tokenize, cache_size
        # Unsigned little-endian integers of that many bytes.
        self.pack = {2: "<%dH", 4: "<%dI"}[id_bytes]

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[part] = found = self.coded([t.id for t in self.tokenize(part)])
        return found

    def coded(self, ids: list[int]) -> bytes:
        return struct.pack(self.pack % len(ids), *ids)


class WordIds(dict):
    """The ids of words as bytes, encoded by the library at first sight.

    The tokenizer drops white space and no token spans it, so a text is the chain of its words. Its normaliser and its
    byte mapping work character by character on printable ones below ``PLAIN_END``; what they make of each is asked of
    the library once, and words of such characters are cut by one pattern. Other words go to the library whole.
    """

    def __init__(self, tokenizer: Tokenizer, id_bytes: int, cache_size: int = CACHE_SIZE) -> None:
        super().__init__()
        self.tokenizer, self.most, self.parts = tokenizer, cache_size, PartIds(tokenizer, id_bytes, cache_size)
        self.lower, self.bytes, classes = {}, {}, {"L": "", "N": ""}
        for c in filter(str.isprintable, map(chr, range(0x21, PLAIN_END))):
            normal = tokenizer.normalizer.normalize_str(c)
            if len(normal) == 1 and ord(normal) < PLAIN_END:
                self.lower[ord(c)] = normal
                self.bytes[ord(c)] = "".join(p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(c))
                if unicodedata.category(c)[0] in classes:
                    classes[unicodedata.category(c)[0]] += c
        letters, numbers = map(re.escape, classes.values())
        self.plain = re.compile(f"[{re.escape(''.join(map(chr, self.lower)))}]*").fullmatch
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if "<|" in word:  # may hold an added token
            found = self.parts.coded(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif word.isascii() and word.isprintable():
            found = b"".join(map(self.parts.__getitem__, self.cut(word.lower())))
        elif self.plain(word):
            cut = (p if p.isascii() else p.translate(self.bytes) for p in self.cut(word.translate(self.lower)))
            found = b"".join(map(self.parts.__getitem__, cut))
        else:
            normal = self.tokenizer.normalizer.normalize_str(word)
            found = b"".join(self.parts[p] for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def check_tokenizer(tokenizer: Tokenizer) -> None:
    """ValueError unless texts can be cut at white space, and words by the pattern of :class:`WordIds`."""
    words = WordIds(tokenizer, 4)
    plain = "".join(map(chr, words.lower))
    probe = f"It's 42, isn't  IT?\nwe'll-see:<x> ''d ~a1b2 {plain} {' '.join(plain)} a{'a'.join(plain)} 1{'1'.join(plain)}"
    want = tokenizer.encode(probe, add_special_tokens=False).ids
    if np.frombuffer(words.encode(probe), "<u4").tolist() != want:
        raise ValueError("this tokenizer does not work word by word")


def write_token_ids(
    df: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every whole text, end each with ``end_id`` and write the ids in ascending order of ``id_col``.

    NULL counts as an empty text, which has the end id alone. Rows without an id come first; rows with the same id are
    neighbours in no certain order, and however many there are, several tasks share them. Other columns are left out.
    An empty table gives an empty folder of the same schema.
    """
    spark = df.sparkSession
    source = Path(tokenizer_path).read_text()
    tokenizer = Tokenizer.from_str(source)
    check_tokenizer(tokenizer)
    id_bytes = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(source)
    token = hashlib.sha256(f"{id_bytes} {source}".encode()).hexdigest()
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("start_in_part", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("id_bytes", T.IntegerType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("boundaries", T.BinaryType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker("words", token, lambda: WordIds(Tokenizer.from_str(shared.value), id_bytes))
        end = end_id.to_bytes(id_bytes, "little")
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        coded: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // id_bytes
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            values = [part, segment, start, int(offsets[-1]), id_bytes, doc_ids, elias_fano.encode(offsets), b"".join(coded)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

        arrow = pa.schema(
            [
                ("part", pa.int32()), ("segment", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()),
                ("id_bytes", pa.int32()), ("doc_ids", pa.list_(arrow_id)), ("boundaries", pa.binary()), ("ids", pa.binary()),
            ]
        )
        for batch in batches:
            for doc_id, one in zip(batch.column(0), batch.column(1)):
                ids = words.encode(one.as_py()) + end
                doc_ids.append(doc_id.as_py())
                coded.append(ids)
                held += len(ids) // id_bytes
                if held >= segment_ids:
                    yield close()
                    segment, start, held, doc_ids, coded = segment + 1, start + held, 0, [], []
        if coded:
            yield close()

    arrow_id = to_arrow_type(id_type)
    placed.select("doc_id", "text").mapInArrow(pack, schema).write.parquet(path)


def read_token_ids(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids): one row per document of the files. ``start`` counts the ids of all documents
    before it; ``ids`` are unsigned 32-bit integers, little-endian."""
    segments = spark.read.parquet(path)
    schema = _document_schema(segments, id_name)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                edges = elias_fano.EliasFano(row["boundaries"].as_py()).values().astype(np.int64)
                flat = np.frombuffer(row["ids"].as_py(), f"<u{row['id_bytes'].as_py()}").astype("<u4").tobytes()
                n = len(edges) - 1
                ends = pa.array((edges * 4).astype(np.int64))
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, ends.buffers()[1], pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"].as_py()), pa.int32()), row["doc_ids"].values,
                        pa.array(edges[:-1] + row["start_in_part"].as_py()), pa.array(np.diff(edges)), ids.cast(pa.binary()),
                    ],
                    ["part", id_name, "at", "n_tokens", "ids"],
                )

    columns = ["part", "start_in_part", "id_bytes", "doc_ids", "boundaries", "ids"]
    return _with_start(segments.select(*columns).mapInArrow(unpack, schema), segments, id_name)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """The rows of :func:`read_token_ids` whose id is in ``wanted``, without unpacking the others.

    Wanted ids are looked up in the id lists alone. Only segments that hold one are then read whole, and there ``select``
    gives the two boundaries of each document. An id that stands in several documents gives them all, one that ``wanted``
    repeats gives them once, and a NULL or unknown one gives none; other columns of ``wanted`` are left out.
    """
    segments = spark.read.parquet(path)
    listed = segments.select("part", "segment", F.posexplode("doc_ids").alias("at", id_name))
    found = listed.join(wanted.select(id_name), id_name, "left_semi")
    found = found.groupBy("part", "segment").agg(F.collect_list("at").alias("places"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (pa.Table.from_batches([batch.slice(i, 1)]).to_pylist()[0] for i in range(batch.num_rows)):
                edges, flat = elias_fano.EliasFano(row["boundaries"]), np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                spans = [(edges.select(i), edges.select(i + 1)) for i in row["places"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(spans), pa.int32()),
                        pa.array([row["doc_ids"][i] for i in row["places"]], arrow_id),
                        pa.array([row["start_in_part"] + a for a, _ in spans], pa.int64()),
                        pa.array([b - a for a, b in spans], pa.int64()),
                        pa.array([flat[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                    ],
                    ["part", id_name, "at", "n_tokens", "ids"],
                )

    schema = _document_schema(segments, id_name)
    arrow_id = to_arrow_type(schema[id_name].dataType)
    held = segments.drop("n_ids").join(found, ["part", "segment"])
    return _with_start(held.mapInArrow(pick, schema), segments, id_name)


def _document_schema(segments: DataFrame, id_name: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField(id_name, segments.schema["doc_ids"].dataType.elementType),
            T.StructField("at", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )


def _with_start(found: DataFrame, segments: DataFrame, id_name: str) -> DataFrame:
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per part of the files, that is per task that wrote them.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = found.join(F.broadcast(offsets), "part")
    return found.select(id_name, (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
