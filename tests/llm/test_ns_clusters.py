"""Clustering with ns-bounds against plain rounds in whole numbers."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.llm.ns_clusters import cluster_vectors, loosening, with_inertia

DIM = 4
SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("id", "vec", "cluster", "upper", "distance", "before")})


def brute(rows, k, rounds, scale):
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centroids)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def awkward():
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(DIM)]) for i in range(150)]
    rows += rows[:20] + [(7, [0.25] * DIM), (None, [0.5] * DIM), (None, None), (200, None), (201, [])]
    rows += [(202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * DIM), (204, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(205, [0.0] * DIM), (206, [-0.0] * DIM), (207, [1.0] * 3), (208, [1e5, -1e5, 3.3, 0.0]), (209, [1e-9] * DIM)]
    return rows


def blobs():
    rng = np.random.default_rng(2)
    at = rng.normal(size=(6, DIM)) * 8
    # A third of all rows in one place.
    which = np.where(rng.random(3000) < 0.34, 0, rng.integers(0, 6, 3000))
    return [(i, [float(x) for x in at[w] + rng.normal(size=DIM) * 0.4]) for i, w in enumerate(which)]


@pytest.mark.parametrize("rows, k, rounds", [(awkward(), 5, 3), (awkward(), 16, 4), (blobs(), 6, 6), (awkward()[:3], 16, 2), (awkward(), 1, 2)])
def test_equals_plain_rounds(spark, rows, k, rounds):
    options = {"k": k, "rounds": rounds, "dim": DIM, "scale": 64}
    found, centroids, scans = cluster_vectors(frame(spark, rows), **options)
    want, at = brute(rows, k, rounds, 64)
    got = found.collect()
    assert centroids == at
    assert collections.Counter((r.id, r.cluster, r.distance) for r in got) == collections.Counter(want)
    plain, _, every = cluster_vectors(frame(spark, rows), bounded=False, **options)
    key = ("id", "cluster", "distance")
    assert collections.Counter(tuple(r[c] for c in key) for r in plain.collect()) == collections.Counter(want)
    assert all(a <= b for a, b in zip(scans, every)) and scans[0] == every[0] == len(want)
    for r in with_inertia(found, centroids).collect():
        assert r.inertia == sum(d for *_, d in want)
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()


def test_bounds_save_scans(spark):
    _, _, scans = cluster_vectors(frame(spark, blobs()), k=6, rounds=6, dim=DIM)
    assert sum(scans[1:]) < 0.5 * 6 * scans[0]


def test_total_displacement_is_no_more_than_the_drifts():
    """A centroid that comes back loosens nothing, though it has drifted twice."""
    history = np.array([[[0, 0], [9, 9]], [[3, 4], [9, 9]], [[0, 0], [9, 9]]])
    moved, others = loosening(history, 2)
    assert moved.tolist() == [[0, 0], [5, 0], [0, 0]]
    assert others.tolist() == [[0, 0], [0, 5], [0, 0]]


def test_empty_and_too_large(spark):
    found, centroids, scans = cluster_vectors(frame(spark, [(1, None), (2, [])]), dim=DIM)
    assert found.count() == 0 and centroids == [] and scans == [0] * 4
    assert with_inertia(found, centroids).count() == 0
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(frame(spark, [(1, [1e30] * DIM)]), dim=DIM)
