"""Alignment in both forms against the full cosine matrix."""

import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from pairmill.functions import nearest
from pairmill.functions.vectors import packed, scaled, unit_matrices
from pairmill.operators import align, infer
from pairmill.operators.align import (
    _best_rows,
    align_best,
    align_buckets,
    alignment_recall,
    attach_matches,
    cell_pieces,
    grid_blocks,
    tables_for,
)
from pairmill.operators.infer import hashed_grams
from pairmill.plans.align import align_corpora


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def frame(spark, vectors, start=0):
    rows = [(start + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def brute(left, right, threshold):
    def unit(m):
        m = np.asarray(m, dtype="float32").astype("float64")
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    s = unit(left) @ unit(right).T
    at = np.round(s, 9).argmax(axis=1)
    return {i: (int(j), round(float(s[i, j]), 3)) for i, j in enumerate(at) if s[i, j] >= threshold}


FORMS = {
    "broadcast": {},
    "grid": {"max_broadcast_bytes": 0, "block_bytes": 1000},
    "one right block": {"max_broadcast_bytes": 0},
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("threshold", [0.85, 0.5, -0.5])
def test_equals_full_matrix(spark, form, threshold):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    left = centres[rng.integers(0, 12, 150)] + rng.normal(scale=0.3, size=(150, 6))
    right = centres[rng.integers(0, 12, 130)] + rng.normal(scale=0.3, size=(130, 6))
    # A third of either side are copies of one vector; some rows are zero.
    left[:50], right[40:85] = left[0], left[0]
    left[60], right[3] = 0, 0
    got = align_best(frame(spark, left), frame(spark, right), threshold=threshold, **FORMS[form]).collect()
    want = brute(left, right, threshold)
    assert {r.left_id: r.right_id for r in got} == {i: j for i, (j, _) in want.items()}
    assert all(r.score == pytest.approx(want[r.left_id][1], abs=1.1e-3) for r in got)


def test_ties_and_zero(spark):
    left = frame(spark, [(1, 0), (0, 0)])
    right = frame(spark, [(1, 0), (1, 0), (0, 1)], start=10)
    for options in FORMS.values():
        rows = align_best(left, right, threshold=0.85, **options).collect()
        assert [tuple(r) for r in rows] == [(0, 10, 1.0)]


def test_empty_right(spark):
    assert align_best(frame(spark, [(1, 0)]), frame(spark, []), threshold=0.5).count() == 0


def letters():
    return lambda texts: [[t.count(c) for c in "abcd"] for t in texts]


def test_align_corpora(spark):
    left = spark.createDataFrame([(1, "aab", "x"), (2, "ccd", "y")], "id long, title string, text string")
    right = spark.createDataFrame([(5, "aab", "u"), (6, "bbd", "v")], "id long, title string, text string")
    rows = align_corpora(left, right, letters).collect()
    assert [tuple(r) for r in rows] == [("aab", "aab", "x", "u", 1.0)]


def test_default_encoder(spark):
    """Titles that differ by a letter meet; the empty one and one of another script match nothing."""
    left = spark.createDataFrame([(1, "Harvest festival opens", "x"), (2, "", "y"), (3, "Қазақ тілі", "z")], "id long, title string, text string")
    right = spark.createDataFrame([(5, "harvest festivals open", "u"), (6, "tax rates", "v"), (7, None, "w")], "id long, title string, text string")
    rows = align_corpora(left, right, threshold=0.6).collect()
    assert [(r.title_kk[:4], r.text_ru) for r in rows if r.title_kk] == [("Harv", "u")]
    # Empty and NULL titles count as the same text.
    assert [r.text_ru for r in rows if not r.title_kk] == ["w"]
    encoded = hashed_grams(dim=64)(["ab", "", "x" * 5000])
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 64 for v in encoded)


def test_attach_keeps_reused_right_rows(spark):
    matches = spark.createDataFrame([(1, 5, 0.9), (2, 5, 0.95)], "left_id long, right_id long, score double")
    side = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (5, "c", "z")], "id long, title string, text string")
    assert attach_matches(matches, side, side).count() == 2


@pytest.mark.parametrize("form", FORMS)
def test_doubles_and_repeated_left_ids(spark, form):
    """Cosines within 1e-8 of the threshold, two left rows for each id."""
    rng = np.random.default_rng(7)
    right = np.linalg.qr(rng.normal(size=(40, 40)))[0][:20]
    cosines = 0.85 + rng.uniform(-1e-8, 1e-8, 200)
    other = np.linalg.qr(np.vstack([right, rng.normal(size=(20, 40))]).T)[0].T[20]
    left = cosines[:, None] * right[rng.integers(0, 20, 200)] + np.sqrt(1 - cosines**2)[:, None] * other
    schema = "id long, embedding array<double>"
    a = spark.createDataFrame([(i // 2, v.tolist()) for i, v in enumerate(left)], schema)
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(right)], schema)
    got = align_best(a, b, threshold=0.85, **FORMS[form]).collect()
    best = (left / np.linalg.norm(left, axis=1, keepdims=True)) @ right.T
    want = sorted((i // 2, int(s.argmax())) for i, s in enumerate(best) if s.max() >= 0.85)
    assert 50 < len(want) < 150
    assert sorted((r.left_id, r.right_id) for r in got) == want


@pytest.mark.parametrize("form", [*FORMS, "buckets"])
def test_odd_vectors_match_nothing(spark, form):
    """NULL vectors, vectors with NULL or non-finite components, and vectors of another length."""
    odd = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], []]
    schema = "id long, embedding array<double>"
    left = spark.createDataFrame([(i, v) for i, v in enumerate([*odd, [1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0]])], schema)
    right = spark.createDataFrame([(10 + i, v) for i, v in enumerate([*odd, [2.0, 0.0], [0.0, 0.0, 1.0]])], schema)
    if form == "buckets":
        rows = align_buckets(left, right, threshold=0.85, bits=2)
    else:
        rows = align_best(left, right, threshold=0.85, **FORMS[form])
    assert [tuple(r) for r in rows.collect()] == [(5, 15, 1.0)]


def test_grid_sends_a_vector_once_per_block(spark):
    """Copies of a left vector are the right side's bytes over those of a block; blocks stay within their bytes."""
    n_left, n_right, dim, block = 3000, 2000, 16, 32_000
    of_left, of_right = grid_blocks(n_left * dim * 8, n_right * dim * 8, block, 8)
    assert (of_left, of_right) == (12, 8)
    assert grid_blocks(1000, 1000, block, 8) == (8, 1)
    sizes = spark.createDataFrame([(0, of_left, of_right)], "cell long, of_left long, of_right long")
    lefts, rights = cell_pieces(
        spark.range(n_left).selectExpr("0L AS cell", "id AS row"), spark.range(n_right).selectExpr("0L AS cell", "id AS right_id"), sizes
    )
    assert lefts.count() == n_left * of_right and rights.count() == n_right * of_left
    keys = ["left_piece", "right_piece"]
    assert lefts.join(rights, keys).select("row", "right_id").distinct().count() == n_left * n_right
    assert lefts.groupBy(*keys).count().agg({"count": "max"}).first()[0] * dim * 8 < 1.4 * block
    assert rights.groupBy(*keys).count().agg({"count": "max"}).first()[0] * dim * 8 < 1.4 * block


def test_hot_vector_in_grid(spark):
    """A third of either side is one vector; the grid deals rows by number, so its blocks stay even."""
    rng = np.random.default_rng(9)
    left, right = rng.normal(size=(900, 8)), rng.normal(size=(600, 8))
    left[:300], right[:200] = left[0], left[0]
    got = align_best(frame(spark, left), frame(spark, right), threshold=0.9, max_broadcast_bytes=0, block_bytes=4096).collect()
    assert {r.left_id: r.right_id for r in got} == {i: j for i, (j, _) in brute(left, right, 0.9).items()}


def test_buckets_reach_their_recall(spark):
    """Recall of matches near the threshold, of which every one found is right; a hot bucket is cut into pieces."""
    rng = np.random.default_rng(5)
    right = rng.normal(size=(400, 24))
    right /= np.linalg.norm(right, axis=1, keepdims=True)
    noise = rng.normal(size=(1200, 24))
    of = rng.integers(0, 400, 1200)
    of[:400] = 7
    noise -= (noise * right[of]).sum(axis=1, keepdims=True) * right[of]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.85, 0.9, 1200)[:, None]
    left = cosine * right[of] + np.sqrt(1 - cosine**2) * noise
    sides = frame(spark, left), frame(spark, right)
    exact = align_best(*sides, threshold=0.85)
    found = align_buckets(*sides, threshold=0.85, recall=0.95, bits=8, piece_rows=50)
    measured = alignment_recall(found, exact).first()
    assert measured.n_exact > 1000 and 0.93 <= measured.recall <= 1
    best = {r.left_id: (r.right_id, r.score) for r in exact.collect()}
    assert all(r.score <= best[r.left_id][1] for r in found.collect())


def test_tables_for():
    assert tables_for(0.85, 0.95, 12) == 30
    assert tables_for(0.85, 0.95, 8) < tables_for(0.85, 0.99, 8)
    for bad in ((0.0, 0.9, 8), (0.85, 1.0, 8), (0.5, 0.99, 18)):
        with pytest.raises(ValueError):
            tables_for(*bad)


@pytest.mark.parametrize("dim", [6, 200])
def test_best_rows_in_single_precision_first(dim):
    """Ties, near ties below single precision, zeros, blocks: as the product in double precision."""
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(900, dim)), rng.normal(size=(700, dim))
    left[:60], right[5], right[100:300] = 0, 0, right[100] * np.arange(1, 201)[:, None]
    left[200:300] = right[400] + rng.normal(size=(100, dim)) * 1e-6
    right[401:420] = right[400] + rng.normal(size=(19, dim)) * 1e-7
    left, right = scaled(left), scaled(right)
    cosines = left @ right.T
    best = np.round(cosines, 9).argmax(axis=1)
    most = cosines[np.arange(900), best]
    for threshold in (-0.5, 0.3):
        for block in (None, 8 * dim * 64):
            at, score = _best_rows(left, right, threshold, block)
            hit = most >= threshold
            assert ((score >= threshold) == hit).all() and (at[hit] == best[hit]).all()
            assert np.allclose(score[hit], most[hit], atol=1e-12, rtol=0)


def test_blocks_do_not_multiply_what_is_sent(spark):
    """Small blocks are multiplied inside a band: a row is sent once per band, whatever the size of a block."""
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(400, 8)), rng.normal(size=(300, 8))
    sides = frame(spark, left), frame(spark, right)
    want = {i: j for i, (j, _) in brute(left, right, 0.5).items()}
    made = []
    real = align.grid_blocks

    def counted(*args):
        made.append(real(*args))
        return made[-1]

    for band in (64 << 20, 4000):
        align.grid_blocks = counted
        try:
            got = align_best(*sides, threshold=0.5, max_broadcast_bytes=0, block_bytes=800, band_bytes=band).collect()
        finally:
            align.grid_blocks = real
        assert {r.left_id: r.right_id for r in got} == want
    assert [of_right for _, of_right in made] == [1, 5]


def test_titles_are_matched_once(spark):
    """Repeated ids and titles, NULL titles: one match per left row, the lowest id of equal right titles."""
    schema = "id long, title string, text string"
    left = spark.createDataFrame([(1, "aab", "x"), (2, "aab", "y"), (3, None, "z"), (4, "", "q")], schema)
    right = spark.createDataFrame([(9, "aab", "u"), (6, "aab", "v"), (7, "cc", "w")], schema)
    rows = align_corpora(left, right, letters).collect()
    assert sorted((r.text_kk, r.text_ru, r.score) for r in rows) == [("x", "v", 1.0), ("y", "v", 1.0)]


def test_encoder_gets_bounded_calls(spark, monkeypatch):
    """Calls have few characters; vectors of a list or a matrix come back in order, NaN as NULL."""
    monkeypatch.setattr(infer, "CALL_CHARS", 100)
    df = spark.range(300).selectExpr("id", "repeat('x', CAST(id AS INT)) AS text").coalesce(1)

    def sizes(matrix):
        def call(texts):
            assert sum(map(len, texts)) <= 100 or len(texts) == 1
            made = [[float(len(t)), float("nan")] for t in texts]
            return np.array(made) if matrix else made

        return call

    for matrix in (True, False):
        rows = infer.encode(df, "text", "v", sizes, {"matrix": matrix}).collect()
        assert [r.v for r in sorted(rows, key=lambda r: r.id)] == [[float(i), None] for i in range(300)]


def test_hashed_grams_against_brute_force(monkeypatch):
    monkeypatch.setattr(infer, "WINDOW", 100)
    rng = random.Random(3)
    texts = ["", "a", "ab", "İ😀😀x"] + ["".join(rng.choices("abcdE \n😀Қ", k=rng.randint(0, 90))) for _ in range(100)]
    for size in (1, 2, 3, 5):
        for text, vector in zip(texts, hashed_grams(64, size)(texts)):
            text = f" {text.lower()} "
            counts = np.zeros(64)
            for i in range(max(1, len(text) - size + 1)):
                counts[int(hashlib.md5(text[i : i + size].encode()).hexdigest()[:7], 16) % 64] += 1
            assert (vector == counts / np.sqrt((counts**2).sum())).all()


def test_bounds_leave_the_best_rows(monkeypatch):
    """Tiles, groups and bounds: rows in few directions with near copies, ties and zeros, as the product of all."""
    bounded = []
    real = nearest._bounded
    monkeypatch.setattr(nearest, "_bounded", lambda *args: bounded.append(real(*args)) or bounded[-1])
    for name, size in (("LEAST", 64), ("PART", 200), ("TILE_ROWS", 128)):
        monkeypatch.setattr(nearest, name, size)
    rng = np.random.default_rng(6)
    axes = rng.normal(size=(10, 96))
    right = rng.normal(size=(1500, 10)) @ axes + rng.normal(size=(1500, 96)) * 0.3
    left = right[rng.integers(0, 1500, 1200)] + rng.normal(size=(1200, 96)) * 0.5
    left[:40], right[7], right[200:300] = 0, 0, right[200] * np.arange(1, 101)[:, None]
    left[40:90] = right[200] * 3
    left, right = scaled(left), scaled(right)
    cosines = left @ right.T
    best = np.round(cosines, 9).argmax(axis=1)
    most = cosines[np.arange(1200), best]
    for threshold in (-0.5, 0.6):
        for block in (None, 8 * 96 * 500):
            at, score = nearest.best_rows(left, right, threshold, block)
            hit = most >= threshold
            assert ((score >= threshold) == hit).all() and (at[hit] == best[hit]).all()
            assert np.allclose(score[hit], most[hit], atol=1e-12, rtol=0)
    assert any(bounded)


def test_titles_are_encoded_once(spark):
    """A check of the vectors does not have the encoder run again."""
    calls = spark.sparkContext.accumulator(0)

    def counted():
        def call(texts):
            calls.add(len(texts))
            return [[t.count(c) for c in "abcd"] for t in texts]

        return call

    schema = "id long, title string, text string"
    left = spark.createDataFrame([(i, "a" * i + "b", "x") for i in range(1, 8)], schema)
    right = spark.createDataFrame([(i, "a" * i + "c", "y") for i in range(1, 6)], schema)
    assert align_corpora(left, right, counted, max_broadcast_bytes=0).count() > 0
    assert calls.value == 12


def test_packed_vectors():
    """Vectors with NULL or non-finite components go, zero has one sign, sliced columns keep their places."""
    rows = [[9.0], [1.0, -0.0], None, [], [float("nan"), 1.0], [None, 2.0], [3.0]]
    at, vectors = packed(pa.array(rows, pa.list_(pa.float32())).slice(1))
    assert at.tolist() == [0, 2, 5]
    assert vectors.to_pylist() == [np.array(v, "float32").tobytes() for v in ([1, 0], [], [3])]
    found = unit_matrices(pa.chunked_array([vectors[:1], vectors[1:]]), "float32")
    assert {dim: (at.tolist(), rows.tolist()) for dim, (at, rows) in found.items()} == {
        0: ([1], [[]]), 1: ([2], [[1.0]]), 2: ([0], [[1.0, 0.0]])
    }
