"""Best-match alignment of two corpora on embedding vectors.

Every left row takes its most cosine-similar right row when the score reaches the threshold. The result is exact in the
first two forms below:

* a right side whose measured size fits ``max_broadcast_bytes`` travels to every task as one matrix;
* otherwise both sides are cut into bands of bounded size, and each pair of bands meets in a task of its own, where right
  blocks are taken one after the other and bounds spare most of the products (``functions/nearest.py``). The best partial match of a left row is kept by an associative maximum. A left vector is
  sent once per right band, so copies follow from sizes alone, whatever the vectors look like;
* ``align_buckets`` compares only rows that share a bucket: the signs of some random projections, in several tables. It
  finds a match with a probability that the caller states.

Both block forms use one mechanism: cells, in which pieces of either side meet. The grid has one cell, the tables have one
for each bucket; pieces keep a cell of any size within bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions.nearest import TIE_DIGITS
from pairmill.functions.nearest import best_rows as _best_rows
from pairmill.functions.vectors import number_kind, packed, unit_matrices
from pairmill.session import stage

# Lines of the table of bucket sizes, which is broadcast.
MOST_BUCKETS = 1 << 20
# Pairs of bands that get a task each; of more, a task has several, one after the other.
MOST_TASKS = 1 << 13
# Pairs of bands for each shuffle partition at least.
WAVES = 2
# Bytes of vectors that a task of packing holds before it sends them on.
PACK_BYTES = 64 << 20


def align_best(
    left: DataFrame,
    right: DataFrame,
    id_col: str = "id",
    vec: str = "embedding",
    threshold: float = 0.85,
    max_broadcast_bytes: int = 64 << 20,
    block_bytes: int = 64 << 20,
    band_bytes: int = 128 << 20,
) -> DataFrame:
    """(left_id, right_id, score): the best right row of each left row, where the unrounded cosine reaches
    ``threshold``; the score is rounded to three digits. A right row may serve many left rows. Left rows need no unique
    id: each gets its own match. A zero vector has cosine 0 with everything. Vectors that are NULL or hold NULL or
    non-finite components match nothing, and neither do vectors of different length. Runs small jobs when called.

    A task of the grid holds a band of each side of ``band_bytes`` in double precision, or one block if that is larger, and
    compares with one right block of ``block_bytes`` after the other. How often a vector is sent follows from the bands, not from the blocks."""
    left, right, kinds = _sides(left, right, id_col, vec)
    size = _size(right, kinds[1])
    if size == 0:
        matches = left.sparkSession.createDataFrame([], _schema(left, right))
    elif size <= max_broadcast_bytes:
        matches = _match_broadcast(left, right, kinds, threshold)
    else:
        matches = _match_grid(left, right, kinds, threshold, size, block_bytes, band_bytes)
    return matches.withColumn("score", F.round("score", 3))


def align_buckets(
    left: DataFrame,
    right: DataFrame,
    id_col: str = "id",
    vec: str = "embedding",
    threshold: float = 0.85,
    recall: float = 0.95,
    bits: int = 12,
    piece_rows: int = 16_384,
    seed: int = 11,
) -> DataFrame:
    """As :func:`align_best`, but a left row only meets right rows that share one of its buckets.

    A bucket is a table and the signs of ``bits`` random projections in it. Two vectors at angle t agree in a sign with
    probability 1 - t / pi; there are as many tables as make a pair at the threshold share a bucket with probability
    ``recall``, and closer pairs more often. Every vector is sent once per table. What is found is compared exactly, so
    scores are right and no match is below the threshold; a left row may get a less similar match, or none, where its best
    one shares no bucket with it. Runs small jobs when called.
    """
    tables = tables_for(threshold, recall, bits)
    left, right, kinds = _sides(left, right, id_col, vec)
    left, _ = stage(left.withColumn("row", F.monotonically_increasing_id()), "align-left")

    def buckets(df: DataFrame, kind: str) -> DataFrame:
        return df.mapInArrow(_bucket_batches(tables, bits, seed, kind), T.StructType([T.StructField("cell", T.LongType()), *df.schema]))

    visitors, residents = buckets(left, kinds[0]), buckets(right, kinds[1])
    pieces = {side: F.ceil(F.count("*") / piece_rows).alias(side) for side in ("of_left", "of_right")}
    sizes = visitors.groupBy("cell").agg(pieces["of_left"]).join(residents.groupBy("cell").agg(pieces["of_right"]), "cell")
    sizes, _ = stage(sizes, "align-buckets")
    return _meet(visitors, residents, sizes, kinds, threshold, _schema(left, right)).withColumn("score", F.round("score", 3))


def tables_for(threshold: float, recall: float, bits: int) -> int:
    """How many tables of ``bits`` signs put a pair at the threshold into one bucket with probability ``recall``."""
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("buckets need a threshold and a recall between 0 and 1")
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - shared))
    if tables << bits > MOST_BUCKETS:
        raise ValueError(f"{tables} tables of {bits} bits are too many buckets")
    return tables


def alignment_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: matches of the exact form, those of them that were found with the same right row, and their share."""
    pairs = exact.select("left_id", "right_id", F.lit(1).alias("one")).join(
        found.select("left_id", "right_id", F.lit(1).alias("hit")).distinct(), ["left_id", "right_id"], "left"
    )
    counts = pairs.agg(F.count("one").alias("n_exact"), F.count("hit").alias("n_found"))
    return counts.withColumn("recall", F.try_divide("n_found", "n_exact"))


def _sides(left: DataFrame, right: DataFrame, id_col: str, vec: str) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """Both sides as (id, vec) with packed vectors, those that can match, and the kinds of their numbers. Vectors are checked
    where they are packed: a filter on them would have a model behind them run twice."""

    def side(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        df = df.select(F.col(id_col).alias(name), F.col(vec).alias("vec"))
        kind = number_kind(pa.list_(pa.float32() if df.schema["vec"].dataType.elementType == T.FloatType() else pa.float64()))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, vectors = packed(batch.column("vec"))
                yield pa.RecordBatch.from_arrays([batch.column(name).take(pa.array(at)), vectors], [name, "vec"])

        return df.mapInArrow(pack, T.StructType([df.schema[name], T.StructField("vec", T.BinaryType())])), kind

    (left, of_left), (right, of_right) = side(left, "left_id"), side(right, "right_id")
    # Copies of a vector tie, and ties go to the lowest id, so one row per distinct vector is enough.
    right, _ = stage(right.groupBy("vec").agg(F.min("right_id").alias("right_id")), "align-right")
    return left, right, (of_left, of_right)


def _size(df: DataFrame, kind: str) -> int:
    """Bytes of the vectors in double precision."""
    return (df.agg(F.sum(F.octet_length("vec"))).first()[0] or 0) * 8 // np.dtype(kind).itemsize


def _schema(left: DataFrame, right: DataFrame) -> T.StructType:
    return T.StructType(
        [left.schema["left_id"], right.schema["right_id"], T.StructField("score", T.DoubleType())]
    )


def _match_broadcast(left: DataFrame, right: DataFrame, kinds: tuple[str, str], threshold: float) -> DataFrame:
    """The right side, whose size the caller has checked, as one matrix in every task."""
    rows = right.orderBy("right_id").toArrow()
    shared = left.sparkSession.sparkContext.broadcast((rows.column("right_id").combine_chunks(), unit_matrices(rows.column("vec"), kinds[1])))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrices = shared.value
        for batch in batches:
            for dim, (at, vectors) in unit_matrices(batch.column("vec"), kinds[0]).items():
                if dim in matrices:
                    places, matrix = matrices[dim]
                    best, score = _best_rows(vectors, matrix, threshold)
                    hit = score >= threshold
                    found = [batch.column("left_id").take(pa.array(at[hit])), ids.take(pa.array(places[best[hit]]))]
                    yield pa.RecordBatch.from_arrays([*found, pa.array(score[hit])], ["left_id", "right_id", "score"])

    return left.mapInArrow(match, _schema(left, right))


def grid_blocks(left_bytes: int, right_bytes: int, block_bytes: int, tasks: int) -> tuple[int, int]:
    """Blocks of the left and of the right side. Right blocks decide how often a left vector is sent, so they are as large
    as allowed; left blocks may be smaller, so that there are at least ``tasks`` pairs of blocks."""
    right_blocks = max(1, -(-right_bytes // block_bytes))
    left_blocks = max(1, -(-left_bytes // block_bytes), -(-tasks // right_blocks))
    return left_blocks, right_blocks


def _match_grid(
    left: DataFrame, right: DataFrame, kinds: tuple[str, str], threshold: float, right_bytes: int, block_bytes: int, band_bytes: int
) -> DataFrame:
    spark = left.sparkSession
    # Rows are told apart by number, as ids may repeat; a model may stand behind the vectors.
    left, _ = stage(left.withColumn("row", F.monotonically_increasing_id()), "align-left")
    # Some tasks for each place, as they do not take the same time.
    tasks = WAVES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_left, of_right = grid_blocks(_size(left, kinds[0]), right_bytes, max(block_bytes, band_bytes), tasks)
    others = {side: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for side, n in (("left", of_left), ("right", of_right))}
    lefts = _bands(left, "row", of_left).select("band", others["right"].alias("other"), F.lit(0).alias("side"), "rows")
    rights = _bands(right, "right_id", of_right).select(others["left"].alias("band"), F.col("band").alias("other"), F.lit(1).alias("side"), "rows")
    pairs = lefts.union(rights).select((F.col("band") * of_right + F.col("other")).alias("pair"), "side", "rows")
    # One task for each pair of bands: dealt by hash, some tasks would get several and others none.
    parts = min(of_left * of_right, MOST_TASKS)
    dealt = pairs.repartitionById(parts, (F.col("pair") % parts).cast("int")).sortWithinPartitions("pair", "side")
    out = _found(_schema(left, right))
    match = _matcher(kinds, threshold, block_bytes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in out]
        held: dict[int, list[pa.Table]] = {0: [], 1: []}
        current = None

        def found() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                sides = [pa.concat_tables(held.pop(side)) for side in (0, 1)]
                yield from match(*sides).select(names).to_batches()

        for batch in batches:
            for pair, side, rows in zip(batch.column("pair").to_pylist(), batch.column("side").to_pylist(), batch.column("rows")):
                if pair != current:
                    yield from found()
                    held, current = {0: [], 1: []}, pair
                held[side].append(pa.ipc.open_stream(rows.as_buffer()).read_all())
        yield from found()

    return _best_of(dealt.mapInArrow(meet, out))


def _bands(df: DataFrame, name: str, bands: int) -> DataFrame:
    """(band, rows): rows dealt to ``bands`` by a hash of column ``name``, many of a band packed into one value."""
    dealt = df.withColumn("band", F.pmod(F.xxhash64(F.lit("piece"), name), F.lit(bands)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            of = rows.column("band").to_numpy()
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(bands + 1))
            for band in np.unique(of).tolist():
                part = rows.take(pa.array(order[ends[band] : ends[band + 1]])).drop_columns("band")
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as to:
                    to.write_table(part)
                value = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([band], pa.int64()), value], ["band", "rows"])

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > PACK_BYTES:
                yield from sent()
                held.clear()
        if held:
            yield from sent()

    return dealt.mapInArrow(pack, "band long, rows binary")


def _bucket_batches(tables: int, bits: int, seed: int, kind: str):
    """Each row once per table, under the number of its bucket there."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype="int64")
        for batch in batches:
            for dim, (at, vectors) in unit_matrices(batch.column("vec"), kind).items():
                planes = np.random.default_rng([seed, dim]).normal(size=(tables, dim, bits))
                rows = batch.take(pa.array(at))
                for number, plane in enumerate(planes):
                    bucket = ((vectors @ plane > 0) @ weights) + (number << bits)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), *rows.columns], ["cell", *rows.schema.names])

    return place


def cell_pieces(visitors: DataFrame, residents: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides with the pieces of their cell that meet: ``sizes`` has (cell, of_left, of_right), the pieces of
    either side. Every left piece of a cell meets every right piece once; a row is in one piece, and is sent to each of the
    other side's. ``sizes`` must be small, as it is broadcast."""

    def piece(name: str, of: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("piece"), name), of)

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    lefts = visitors.join(F.broadcast(sizes), "cell").select(
        *visitors.columns, piece("row", "of_left").alias("left_piece"), every("of_right").alias("right_piece")
    )
    rights = residents.join(F.broadcast(sizes), "cell").select(
        *residents.columns, piece("right_id", "of_right").alias("right_piece"), every("of_left").alias("left_piece")
    )
    return lefts, rights


def _meet(
    visitors: DataFrame, residents: DataFrame, sizes: DataFrame, kinds: tuple[str, str], threshold: float, schema: T.StructType
) -> DataFrame:
    """The best match of each visitor (cell, row, left_id, vec) among the residents (cell, right_id, vec) of its cells."""
    lefts, rights = cell_pieces(visitors, residents, sizes)
    keys = ["cell", "left_piece", "right_piece"]
    met = lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(_matcher(kinds, threshold), _found(schema))
    return _best_of(met)


def _found(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("row", T.LongType()), *schema])


def _matcher(kinds: tuple[str, str], threshold: float, block_bytes: int | None = None):
    """From left rows (row, left_id, vec) and right rows (right_id, vec) to the matches of the left ones among them."""

    def match(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        rights = rights.sort_by("right_id")
        rows, left_ids, right_ids, scores = [], [], [], []
        matrices = unit_matrices(rights.column("vec"), kinds[1])
        rights = rights.select(["right_id"])
        for dim, (at, vectors) in unit_matrices(lefts.column("vec"), kinds[0]).items():
            if dim in matrices:
                places, matrix = matrices[dim]
                best, score = _best_rows(vectors, matrix, threshold, block_bytes)
                hit = score >= threshold
                rows.append(lefts.column("row").take(pa.array(at[hit])))
                left_ids.append(lefts.column("left_id").take(pa.array(at[hit])))
                right_ids.append(rights.column("right_id").take(pa.array(places[best[hit]])))
                scores.append(pa.chunked_array([pa.array(score[hit])]))
        if not rows:
            return lefts.slice(0, 0).select(["row", "left_id"]).append_column(
                "right_id", rights.slice(0, 0).column("right_id")
            ).append_column("score", pa.chunked_array([pa.array([], pa.float64())]))
        parts = [pa.table(dict(zip(("row", "left_id", "right_id", "score"), p))) for p in zip(rows, left_ids, right_ids, scores)]
        return pa.concat_tables(parts)

    return match


def _best_of(met: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.round("score", TIE_DIGITS)).alias("rank"), F.col("right_id"), F.col("score")))
    return met.groupBy("row", "left_id").agg(best.alias("best")).select("left_id", "best.right_id", "best.score")


def attach_matches(
    matches: DataFrame, left: DataFrame, right: DataFrame, id_col: str = "id", cols: tuple[str, ...] = ("title", "text"),
    suffixes: tuple[str, str] = ("kk", "ru"),
) -> DataFrame:
    """Titles and texts of both sides of each match. Texts join by id after matching and never take part in it."""
    a = left.select(F.col(id_col).alias("left_id"), *(F.col(c).alias(f"{c}_{suffixes[0]}") for c in cols))
    b = right.select(F.col(id_col).alias("right_id"), *(F.col(c).alias(f"{c}_{suffixes[1]}") for c in cols))
    named = [f"{c}_{s}" for c in cols for s in suffixes]
    return matches.join(b, "right_id").join(a, "left_id").select("left_id", "right_id", *named, "score")
