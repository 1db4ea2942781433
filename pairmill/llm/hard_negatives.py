"""Hard negatives by threshold joins over an inverted index.

Anchors search all rows for their positives, and then, between two shares of each positive's score, for their negatives.
Both searches are threshold joins. Rows and anchors are dealt into blocks, and each block of rows that meets a block of
anchors is indexed: dimensions stand in order of their weight over all rows, and a row is posted under its leading ones
only, as long as the norm of what follows could still lift it to the least threshold of the anchors. Partial scores are
summed posting list by posting list; a row is given up for an anchor once its partial score and the product of the
remaining norms stay below the threshold. Survivors get their exact score in whole numbers.

A threshold begins high. Anchors whose windows did not fill come again with a lower one, down to the bound that the window
itself sets, so the result is that of a full comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.llm.common import partitions
from pairmill.llm.quantized import floors, matrix, whole
from pairmill.session import discard, stage

# Dimensions that share a posting list.
BAND = 8
# Rows of a block: enough blocks for every core, none beyond what a task holds with ease.
LEAST_BLOCK, MOST_BLOCK = 1024, 32_768
# Anchors of a block, and of those the ones that go through the lists at a time.
ANCHOR_BLOCK = 8192
AT_A_TIME = 64
# Bounds are doubles; this share of the product of the norms is granted to rounding.
MARGIN = 1e-9
# Components up to this size give exact sums of products in double precision.
EXACT = 1 << 20
LEAST_SCORE, MOST_SCORE = -(1 << 62), 1 << 62
# Thresholds of the search for positives, as shares of the anchor's norm times the typical norm; the last takes all rows.
POSITIVE_STOPS = (0.4, 0.2, None)


@dataclass(frozen=True)
class ScoreWindow:
    """Whole percentages of the positive's score between which a negative's score lies, and the stops of the search on its
    way from the upper end to the lower."""

    low: int = 50
    high: int = 95
    stops: tuple[int, ...] = (85, 70)


def rest_norms(vectors: np.ndarray) -> np.ndarray:
    """For each vector the norm of what follows the first 0, 1, 2, ... bands of its dimensions."""
    n, dim = vectors.shape
    bands = -(-dim // BAND)
    norms = np.zeros((n, bands + 1))
    if bands:
        squares = np.add.reduceat(vectors.astype(np.float64) ** 2, np.arange(bands) * BAND, axis=1)
        norms[:, :bands] = squares[:, ::-1].cumsum(axis=1)[:, ::-1]
    return np.sqrt(norms)


class Index:
    """Posting lists of a block of rows for anchors that ask for scores of at least ``least`` times their norm.

    Bands of dimensions stand by falling weight in the block. A row is posted in its leading bands only: the first band
    left out is the first whose remaining norm, times any anchor's, is below its threshold. Rows stand by falling number of
    their posted bands, so the posting list of a band is the head of the rows, with their values in it.
    """

    def __init__(self, vectors: np.ndarray, least: float) -> None:
        self.dims = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        vectors = vectors[:, self.dims]
        rest = rest_norms(vectors)
        bands = rest.shape[1] - 1
        posted = np.full(len(vectors), bands)
        if least > 0:
            posted = (rest[:, :bands] * (1 + MARGIN) >= least).sum(axis=1)
        self.order = np.argsort(-posted, kind="stable")
        self.vectors, self.rest, self.posted = vectors[self.order], rest[self.order], posted[self.order]
        self.all_rows = least <= 0
        exact = not vectors.size or np.abs(vectors).max() <= EXACT
        self.dtype = np.float64 if exact else np.int64
        self.lengths = [int((self.posted > b).sum()) for b in range(bands)]
        self.lists = [
            self.vectors[:n, b * BAND : (b + 1) * BAND].astype(self.dtype) for b, n in enumerate(self.lengths)
        ]

    def search(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score): positions of all pairs whose score reaches the anchor's threshold, and the score."""
        anchors = anchors[:, self.dims]
        norms = rest_norms(anchors)
        floor = (thresholds - MARGIN * (1 + norms[:, 0] * self.rest[:, 0].max(initial=0.0)))[:, None]
        live = np.arange(len(self.vectors) if self.all_rows else self.lengths[0] if self.lengths else 0)
        values = anchors.astype(self.dtype if not anchors.size or np.abs(anchors).max() <= EXACT else np.int64)
        partial = np.zeros((len(anchors), len(live)), values.dtype if values.dtype == self.dtype else np.int64)
        for b, length in enumerate(self.lengths):
            head = int(np.searchsorted(live, length))  # the rows that are still looked at and on this list
            if not head:
                break
            partial[:, :head] += (values[:, b * BAND : (b + 1) * BAND] @ self.lists[b][live[:head]].T).astype(partial.dtype)
            # What the bands after this one can still add is at most the product of the remaining norms.
            bound = partial[:, :head] + norms[:, b + 1, None] * self.rest[live[:head], b + 1]
            alive = np.concatenate([(bound >= floor).any(axis=0), np.ones(len(live) - head, bool)])
            if not alive.all():
                live, partial = live[alive], partial[:, alive]
        left = self.posted[live]
        a, r = np.nonzero(partial + norms[:, left] * self.rest[live, left] >= floor)
        score, r = partial[a, r].astype(np.int64), live[r]
        # Dimensions that are not posted, for the pairs that are left.
        cut = np.flatnonzero(self.posted[r] < len(self.lists))
        for start in range(0, len(cut), 1 << 15):
            some = cut[start : start + (1 << 15)]
            score[some] = np.einsum("ij,ij->i", anchors[a[some]], self.vectors[r[some]])
        reached = score >= thresholds[a]
        return a[reached], self.order[r[reached]], score[reached]


def _meet(same: bool, want: int):
    """What a block of anchors finds in a block of rows: for each of an anchor's slots the first ``want`` rows."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.rename_columns([c.removeprefix("other_") for c in rows.column_names])
        out: dict[str, list] = {c: [] for c in ("row", "slot", "at", "score")}
        ids, numbers = rows.column("id").to_pylist(), rows.column("row").to_numpy()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, numbers[i]))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        # Labels of both sides as numbers.
        names = {x: i for i, x in enumerate(dict.fromkeys([*anchors.column("label").to_pylist(), *rows.column("label").to_pylist()]))}
        of_anchor, of_row = (np.array([names[x] for x in t.column("label").to_pylist()], np.int64) for t in (anchors, rows))
        anchor_dims, row_dims = anchors.column("dim").to_numpy(), rows.column("dim").to_numpy()
        anchor_rows, slots = anchors.column("row").to_numpy(), anchors.column("slots").to_pylist()
        lows = np.array([min(s["low"] for s in one) for one in slots], np.int64)
        for dim in np.intersect1d(anchor_dims, row_dims):
            mine, theirs = np.flatnonzero(anchor_dims == dim), np.flatnonzero(row_dims == dim)
            queries = matrix(anchors.column("vec").take(pa.array(mine)), dim)
            lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
            least = np.where(lows[mine] > 0, lows[mine] / np.maximum(lengths, 1e-300), -np.inf).min()
            index = Index(matrix(rows.column("vec").take(pa.array(theirs)), dim), least)
            for start in range(0, len(mine), AT_A_TIME):
                some = mine[start : start + AT_A_TIME]
                a, r, score = index.search(queries[start : start + AT_A_TIME], lows[some])
                a, r = some[a], theirs[r]
                fits = ((of_anchor[a] == of_row[r]) == same) & (anchor_rows[a] != numbers[r])
                a, r, score = a[fits], r[fits], score[fits]
                by = np.lexsort((rank[r], -score, a))
                a, r, score = a[by], r[by], score[by]
                starts, ends = np.searchsorted(a, some), np.searchsorted(a, some, side="right")
                for one, i, j in zip(some, starts, ends):
                    for slot in slots[one] if j > i else ():
                        at = i + int(np.searchsorted(-score[i:j], -slot["high"]))
                        for k in range(at, min(at + want, j)):
                            if score[k] < slot["low"]:
                                break
                            out["row"].append(anchor_rows[one])
                            out["slot"].append(slot["slot"])
                            out["at"].append(r[k])
                            out["score"].append(score[k])
        at = pa.array(out["at"], pa.int64())
        return pa.table(
            {
                "row": pa.array(out["row"], pa.int64()), "slot": pa.array(out["slot"], pa.int32()),
                "other_id": rows.column("id").take(at), "other_row": rows.column("row").take(at),
                "score": pa.array(out["score"], pa.int64()),
            }
        )

    return meet


def _search(rows: DataFrame, n_rows: int, slots: DataFrame, same: bool, want: int) -> DataFrame:
    """(row, slot, other_id, other_row, score, rank, found) of the slots (row, slot, low, high) of anchors: their first ``want``
    rows of the same or of another label, by falling score, between ``low`` and ``high``."""
    n_anchors = slots.select(F.count_distinct("row")).first()[0]
    size = min(max(n_rows // (4 * partitions(rows.sparkSession)), LEAST_BLOCK), MOST_BLOCK)
    row_blocks, anchor_blocks = max(1, -(-n_rows // size)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    asked = slots.groupBy("row").agg(F.collect_list(F.struct("slot", "low", "high")).alias("slots"))
    narrow = ("row", "id", "label", "dim", "vec")
    anchors = rows.filter("anchor").select(*narrow).join(asked, "row")

    def block(n: int, by: str = "row") -> Column:
        return F.pmod(F.xxhash64(F.lit("block"), by), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Every block of anchors meets every block of rows once.
    left = anchors.withColumn("a", block(anchor_blocks)).withColumn("r", every(row_blocks))
    # Fresh names tell the columns of the two sides apart, which come from one table.
    right = rows.select(*(F.col(c).alias(f"other_{c}") for c in narrow))
    right = right.withColumn("r", block(row_blocks, "other_row")).withColumn("a", every(anchor_blocks))
    schema = f"row long, slot int, other_id {rows.schema['id'].dataType.simpleString()}, other_row long, score long"
    met = left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(_meet(same, want), schema)
    best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_row")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= want)
    return ranked.withColumn("found", F.count("*").over(Window.partitionBy("row", "slot")))


def _lowering(
    rows: DataFrame, n_rows: int, slots: DataFrame, lows: Sequence[Column], high: Column, same: bool, want: int, name: str
) -> DataFrame:
    """Results of all slots: searched with the first of ``lows``, then, where fewer than ``want`` rows were found, with the
    next, to the last."""
    done, open_, folders = None, slots, []
    for i, low in enumerate(lows):
        asked = open_.withColumns({"low": low, "high": high}).select("row", "slot", "low", "high")
        found, _ = stage(_search(rows, n_rows, asked, same, want), f"{name}-{i}")
        full = found if i == len(lows) - 1 else found.filter(F.col("found") >= want)
        done = full if done is None else done.unionByName(full)
        if i < len(lows) - 1:
            open_, folder = stage(open_.join(full.select("row", "slot").distinct(), ["row", "slot"], "left_anti"), f"{name}-open-{i}")
            folders.append(folder)
            if open_.isEmpty():
                break
    discard(slots.sparkSession, *folders)
    return done


def mine_hard_negatives(
    df: DataFrame,
    id_col: str = "vec_id",
    vec: str = "embedding",
    label: Column | None = None,
    anchor: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    window: ScoreWindow = ScoreWindow(),
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the vectors in whole numbers floor(``scale`` * x); a component beyond 2^27 after scaling
    raises an error. An ``anchor`` (a condition; by default every row) has as positives its first ``positives`` other rows of
    the same label, and for each of them as negatives the first ``negatives`` rows of other labels whose score is from
    ``window.low`` to ``window.high`` percent of the positive's; fewer where there are fewer. Higher scores come first, then
    smaller ids, rows without an id last. Rows whose label or vector is NULL, or whose vector has NULL or non-finite
    components, take no part. Rows are told apart by number, so a repeated row is another row, also to its anchor. Vectors of
    different length do not meet. Positives with a negative score, and such without a negative, give no row. Other columns
    of ``df`` are left out. An empty table gives an empty one. Runs jobs when called.
    """
    spark = df.sparkSession
    label = F.col("label") if label is None else label
    anchor = F.lit(True) if anchor is None else anchor
    part = df.filter(label.isNotNull() & whole(F.col(vec))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        label.alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        floors(F.col(vec), scale).alias("vec"),
    )
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    part = part.withColumns({"dim": F.size("vec"), "norm": F.sqrt(squares)})
    # Written once: numbers of rows must not change between the searches.
    rows, folder = stage(part, "negatives-rows")
    measured = rows.agg(F.count("*").alias("n"), F.avg("norm").alias("norm")).first()
    n_rows, typical = measured["n"], float(measured["norm"] or 0.0)

    every = F.lit(LEAST_SCORE).cast("long")
    lows = [every if s is None else F.ceil(F.col("norm") * F.lit(s * typical)).cast("long") for s in POSITIVE_STOPS]
    first = rows.filter("anchor").select("row", F.lit(0).alias("slot"), "norm")
    near = _lowering(rows, n_rows, first, lows, F.lit(MOST_SCORE).cast("long"), True, positives, "positives")
    named = rows.filter("anchor").select("row", F.col("id").alias("anchor_id"))
    near = near.join(named, "row").select(
        "row", "anchor_id", F.col("other_id").alias("positive_id"), F.col("rank").alias("slot"),
        F.col("score").alias("positive_score"),
    )
    near, _ = stage(near, "positives")

    score = F.col("positive_score")
    lows = [F.call_function("div", score * p + 99, F.lit(100)) for p in (*window.stops, window.low)]
    high = F.call_function("div", score * window.high, F.lit(100))
    # The window of a negative score is empty.
    slots = near.filter("positive_score >= 0").select("row", "slot", "positive_score")
    hard = _lowering(rows, n_rows, slots, lows, high, False, negatives, "negatives")
    discard(spark, folder)
    met = hard.select("row", "slot", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return met.join(near, ["row", "slot"]).select(
        "anchor_id", "positive_id", F.col("slot").alias("positive_rank"), "rank", "negative_id", "positive_score",
        "negative_score",
    )
