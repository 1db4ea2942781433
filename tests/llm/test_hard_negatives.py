"""Hard negatives against a full comparison, and the index against plain products."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.llm import hard_negatives as hn
from pairmill.llm.hard_negatives import Index, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return df.withColumns({c: F.lit("clash") for c in ("row", "id", "vec", "slot", "score", "norm", "dim", "anchor", "rank")})


def awkward():
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rng.randrange(4)) for i in range(260)]
    rows += rows[:30]  # repeated rows
    rows += [(50, [0.3] * 6, 2), (None, [0.5] * 6, 1), (None, None, 1), (300, None, 1), (301, [0.1] * 6, None)]
    rows += [(302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 2)]
    rows += [(305, [0.0] * 6, 3), (350, [0.0] * 6, 3), (400, [-1.0] * 6, 0), (401, [0.5] * 3, 0), (450, [0.5] * 3, 1)]
    rows += [(451, [0.25] * 3, 1), (452, [0.5, 0.25, 0.25], 0), (500, [], 1), (501, [], 1), (502, [], 2), (550, [9.0] * 6, 77)]
    return rows


def one_hot_label():
    """A third of all rows has one label; the weight of the vectors lies in few dimensions, so that bounds prune."""
    rng = np.random.default_rng(6)
    n = 2500
    label = np.where(rng.random(n) < 0.34, 0, rng.integers(0, 10, n))
    at = rng.normal(size=(10, 40)) * np.exp(-np.arange(40) / 4)
    vectors = at[label] + rng.normal(size=(n, 40)) * np.exp(-np.arange(40) / 4) * 0.7
    return [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, label))]


def brute(rows, every=50):
    part = []
    for i, v, c in rows:
        if c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, np.array([math.floor(float(np.float32(x)) * 256) for x in v], np.int64), c))
    found = []
    last = 1 << 62
    for n, (i, v, c) in enumerate(part):
        if i is None or i % every:
            continue
        scored = [(-int(v @ w), last if j is None else j, m, d) for m, (j, w, d) in enumerate(part) if m != n and len(w) == len(v)]
        positives = sorted(s for s in scored if s[3] == c)[:5]
        others = sorted(s for s in scored if s[3] != c)
        for p, j, *_ in positives:
            fits = [(-s, k) for s, k, *_ in others if 50 * -p <= 100 * -s <= 95 * -p][:3]
            found += [(i, None if j == last else j, r, None if k == last else k, -p, s) for r, (s, k) in enumerate(fits, 1)]
    return collections.Counter(found)


def rows_of(df):
    return collections.Counter(
        (r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()
    )


@pytest.mark.parametrize("rows", [awkward(), one_hot_label()], ids=["awkward", "hot label"])
def test_equals_full_comparison(spark, rows):
    want = brute(rows)
    assert len(want) > 20
    assert rows_of(mine_hard_negatives(frame(spark, rows), anchor=F.col("vec_id") % 50 == 0)) == want


def test_many_blocks(spark, monkeypatch):
    """The same from blocks of a few rows and anchors."""
    monkeypatch.setattr(hn, "LEAST_BLOCK", 40)
    monkeypatch.setattr(hn, "MOST_BLOCK", 40)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 2)
    assert rows_of(mine_hard_negatives(frame(spark, awkward()), anchor=F.col("vec_id") % 50 == 0)) == brute(awkward())


def test_empty(spark):
    assert mine_hard_negatives(frame(spark, awkward()).limit(0)).count() == 0
    assert mine_hard_negatives(frame(spark, awkward()).filter("vec_id = 50"), anchor=F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("size", [30, 1 << 24])
def test_index_finds_all_and_posts_less(size):
    rng = np.random.default_rng(size)
    weight = np.exp(-np.arange(37) / 5)[rng.permutation(37)]
    rows, anchors = ((rng.normal(size=(n, 37)) * weight * size).astype(np.int64) for n in (700, 40))
    scores = anchors @ rows.T
    norms = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
    for share in (0.9, 0.5, 0.1, -0.2):
        thresholds = (share * scores.max(axis=1)).astype(np.int64)
        least = (thresholds / norms).min()
        index = Index(rows, least)
        a, r, score = index.search(anchors, thresholds)
        want = np.argwhere(scores >= thresholds[:, None])
        assert sorted(zip(a, r)) == sorted(map(tuple, want)) and (score == scores[a, r]).all()
        if share == 0.9:
            assert sum(index.lengths) < 0.7 * 700 * 5
