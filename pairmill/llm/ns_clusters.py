"""Centroid clustering with bounds from the norm of total displacement.

A row keeps an upper bound of the distance to its centroid and a lower bound of the distance to all others, each with the
round in which it was measured. The history of all centroids goes to every task; in a later round a bound is loosened by the
norm of the displacement since that very round, which is at most the sum of the drifts of the rounds between. Where the
bounds still part, the row keeps its centroid unseen. Where they do not, the distance to its own centroid is measured, and
if that is not enough, all centroids are, in whole numbers.

Only rows that changed their centroid are summed, in built-in aggregates; the sums of k centroids are all that reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.quantized import floors, matrix, whole
from pairmill.session import discard, stage

# Bounds are doubles; two of them part if they differ by more than this share of the larger one.
MARGIN = 1e-9
STATE = "id {id}, vec array<int>, cluster int, before int, upper double, upper_at int, lower double, lower_at int, scanned boolean"


def kept_vectors(df: DataFrame, id_col: str, vec: str, dim: int, scale: int) -> DataFrame:
    """(id, vec) of the rows whose vector has ``dim`` finite components, in whole numbers."""
    fits = F.coalesce(F.size(vec) == dim, F.lit(False)) & whole(F.col(vec))
    rows = df.filter(fits).select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    return rows.select("id", floors(F.col("vec"), scale).alias("vec"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Vectors of the ``k`` smallest SHA-256 digests of ``seed:id``. Rows of one id follow each other by vector; rows without
    an id come last."""
    name = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(F.col("id").isNull(), name, "vec").limit(k)
    return [list(r.vec) for r in first.select("vec").collect()]


def squares(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances, exact: differences stay whole numbers and their squares fit."""
    gap = rows - centroid
    return (gap * gap).sum(axis=1)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the nearest centroid (ties: smaller number), its squared distance, and that of the next one."""
    best = np.zeros(len(rows), np.int64)
    least = squares(rows, centroids[0])
    second = np.full(len(rows), np.inf)
    for j in range(1, len(centroids)):
        d = squares(rows, centroids[j])
        closer = d < least
        second = np.where(closer, least, np.minimum(second, d))
        best[closer] = j
        least = np.where(closer, d, least)
    return best, least, second


def loosening(history: np.ndarray, now: int) -> tuple[np.ndarray, np.ndarray]:
    """For each earlier round the norm of the total displacement of each centroid up to round ``now``, and for each centroid
    the largest norm among the others."""
    moved = np.sqrt(((history[now] - history[: now + 1]).astype(np.float64) ** 2).sum(axis=2))
    k = moved.shape[1]
    others = np.zeros_like(moved)
    for j in range(k):
        rest = np.delete(moved, j, axis=1)
        others[:, j] = rest.max(axis=1) if rest.size else 0.0
    return moved, others


def assign_first(vectors: DataFrame, history: np.ndarray, dim: int) -> DataFrame:
    """All rows measured against all centroids."""
    start = history[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, least, second = nearest(matrix(batch.column("vec"), dim), start)
            n = batch.num_rows
            yield _state(batch, best, np.full(n, -1), np.sqrt(least), np.zeros(n), np.sqrt(second), np.zeros(n), np.ones(n, bool))

    return vectors.mapInArrow(scan, STATE.format(id=vectors.schema["id"].dataType.simpleString()))


def assign_again(state: DataFrame, history: np.ndarray, now: int, dim: int) -> DataFrame:
    """The state after round ``now``: rows whose bounds part stay, the others are measured."""
    moved, others = loosening(history, now)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c).to_numpy(zero_copy_only=False).copy() for c in
                  ("cluster", "upper", "upper_at", "lower", "lower_at")}
            before = of["cluster"].copy()
            high = of["upper"] + moved[of["upper_at"], before]
            low = of["lower"] - others[of["lower_at"], before]
            scanned = np.zeros(len(before), bool)
            at = np.flatnonzero(~_parted(high, low))
            if len(at):
                rows = matrix(batch.column("vec").take(pa.array(at)), dim)
                # The own centroid first: an exact upper bound may be enough.
                own = np.sqrt(((rows - history[now][before[at]]) ** 2).sum(axis=1).astype(np.float64))
                of["upper"][at], of["upper_at"][at] = own, now
                failed = ~_parted(own, low[at])
                at, rows = at[failed], rows[failed]
            if len(at):
                best, least, second = nearest(rows, history[now])
                scanned[at] = True
                of["cluster"][at] = best
                of["upper"][at], of["upper_at"][at] = np.sqrt(least), now
                of["lower"][at], of["lower_at"][at] = np.sqrt(second), now
            yield _state(batch, of["cluster"], before, of["upper"], of["upper_at"], of["lower"], of["lower_at"], scanned)

    return state.mapInArrow(scan, STATE.format(id=state.schema["id"].dataType.simpleString()))


def _parted(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether the upper bound is surely below the lower one. Equal distances never part, so ties are measured."""
    return high + MARGIN * (1.0 + np.abs(high)) < low - MARGIN * np.where(np.isfinite(low), np.abs(low), 0.0)


def _state(batch: pa.RecordBatch, cluster, before, upper, upper_at, lower, lower_at, scanned) -> pa.RecordBatch:
    columns = [
        batch.column("id"), batch.column("vec"), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()),
        pa.array(upper, pa.float64()), pa.array(upper_at, pa.int32()), pa.array(lower, pa.float64()),
        pa.array(lower_at, pa.int32()), pa.array(scanned),
    ]
    names = ["id", "vec", "cluster", "before", "upper", "upper_at", "lower", "lower_at", "scanned"]
    return pa.RecordBatch.from_arrays(columns, names)


def changes(state: DataFrame, dim: int) -> list[tuple[int, int, list[int]]]:
    """For each centroid that won or lost rows in the last round: its number, and the change of its count and of its sums."""
    moved = state.filter("cluster != before").select(
        "vec", F.explode(F.array(F.struct(F.col("cluster").alias("at"), F.lit(1).alias("sign")),
                                 F.struct(F.col("before").alias("at"), F.lit(-1).alias("sign")))).alias("to")
    )
    signed = moved.filter("to.at >= 0").select("to.at", "to.sign", "vec")
    sums = [F.sum(F.get("vec", F.lit(i)).cast("long") * F.col("sign")).alias(f"s{i}") for i in range(dim)]
    rows = signed.groupBy("at").agg(F.sum("sign").alias("n"), *sums).collect()
    return [(r["at"], r["n"], [r[f"s{i}"] for i in range(dim)]) for r in rows]


def cluster_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    dim: int = 64,
    scale: int = 64,
    seed: int = 1,
    bounded: bool = True,
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(id, cluster, distance, scanned) of each vector, the final centroids, and how many rows each round scanned in full.

    Vectors with exactly ``dim`` components, none NULL or non-finite, take part, as whole numbers floor(``scale`` * x); a
    component beyond 2^27 after scaling raises an error. Other rows are left out. Rows of one id, equal vectors and vectors
    halfway between centroids each count by themselves; of centroids equally near the smaller number wins. ``k`` centroids
    start as :func:`first_centroids`, fewer if there are fewer vectors. After each of ``rounds`` assignments a centroid
    becomes floor(sum / count) of its vectors, or stays if it has none; then vectors are assigned once more. ``distance`` is
    squared and exact. Other columns of ``df`` are left out. An empty table gives an empty one. ``bounded=False`` scans every
    row in every round, with the same result. Runs jobs when called;
    each round writes its rows once and shuffles sums only.
    """
    spark = df.sparkSession
    vectors = kept_vectors(df, id_col, vec, dim, scale)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        empty = vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(True).alias("scanned"))
        return empty, [], [0] * (rounds + 1)
    history = np.array([centroids], dtype=np.int64)
    counts = [0] * len(centroids)
    sums = [[0] * dim for _ in centroids]
    state, path = stage(assign_first(vectors, history, dim), "clusters-0")
    scans = []
    for now in range(1, rounds + 1):
        scans.append(state.filter("scanned").count())
        for at, n, change in changes(state, dim):
            counts[at] += n
            sums[at] = [a + b for a, b in zip(sums[at], change)]
        centroids = [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, centroids)]
        history = np.concatenate([history, np.array([centroids], dtype=np.int64)])
        again = assign_again(state if bounded else _unbounded(state), history, now, dim)
        (state, path), old = stage(again, f"clusters-{now}"), path
        discard(spark, old)
    scans.append(state.filter("scanned").count())
    return _with_distance(state, history[-1], dim), centroids, scans


def _unbounded(state: DataFrame) -> DataFrame:
    return state.withColumn("lower", F.lit(float("-inf")))


def _with_distance(state: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            gap = matrix(batch.column("vec"), dim) - centroids[cluster]
            distance = (gap * gap).sum(axis=1).astype(np.int64)
            columns = [batch.column("id"), batch.column("cluster"), pa.array(distance), batch.column("scanned")]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance", "scanned"])

    kind = state.schema["id"].dataType.simpleString()
    narrow = state.select("id", "vec", "cluster", "scanned")
    return narrow.mapInArrow(measure, f"id {kind}, cluster int, distance long, scanned boolean")


def with_inertia(clustered: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add the sum of distances over the row's cluster and over all rows, and the digest of its centroid's components."""
    spark = clustered.sparkSession
    per_cluster = clustered.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    found = per_cluster.collect()  # k rows at most
    total = sum(r["cluster_inertia"] for r in found)
    lines = [(r["cluster"], r["cluster_inertia"], total, ",".join(map(str, centroids[r["cluster"]]))) for r in found]
    table = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid string")
    digest: Column = F.sha2(F.col("centroid").cast("binary"), 256)
    table = table.withColumn("centroid_sha256", digest).drop("centroid")
    return clustered.join(F.broadcast(table), "cluster")
