"""Exact deduplication against brute force, on awkward rows and with digests that collide."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairmill.llm.exact_dedup import drop_exact_copies, exact_copies

SCHEMA = "doc_id long, text string, n int"


def frame(spark, rows, parts=5):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(parts)
    clash = ("digest", "keep_id", "kept", "salt", "size", "id", "group_size", "odd.name")
    return df.withColumns({c: F.lit(f"clash {c}") for c in clash})


def rows_of(kind):
    rng = random.Random(3)
    if kind == "awkward":
        long = "long text " * 200_000
        return [
            (1, "a"), (1, "a"), (2, None), (3, ""), (None, "a"), (None, None), (None, "b"), (None, "b"), (4, long),
            (9, long), (5, "A"), (6, "a "), (7, "e\u0301"), (8, "\u00e9"), (9, "a"), (9, "a"), (9, "c"),
        ]
    # One text holds a third of all rows, some ids are repeated, beside the same text and beside others.
    hot = [(i, "hot") for i in range(1000)]
    rest = [(rng.randrange(2500), f"text {rng.randrange(900)}") for _ in range(2000)]
    rows = hot + rest + rest[:50]
    rng.shuffle(rows)
    return rows


def check(rows, found):
    want = {}
    for i, t in rows:
        ids, size = want.get(t or "", ([], 0))
        want[t or ""] = (ids + [i] * (i is not None), size + 1)
    text_of = {hashlib.sha256(t.encode()).digest(): t for t in want}
    assert len(found) == len(rows)
    kept = collections.Counter()
    for r in found:
        ids, size = want[text_of[bytes(r.digest)]]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), size)
        if r.kept:
            assert r.id == r.keep_id
            kept[bytes(r.digest)] += 1
    assert set(kept) == set(text_of) and set(kept.values()) == {1}
    given = collections.Counter((i, hashlib.sha256((t or "").encode()).digest()) for i, t in rows)
    assert collections.Counter((r.id, bytes(r.digest)) for r in found) == given


@pytest.mark.parametrize("kind", ["awkward", "hot"])
def test_groups(spark, kind):
    rows = rows_of(kind)
    check(rows, exact_copies(frame(spark, rows)).collect())


@pytest.mark.parametrize("kind", ["awkward", "hot"])
def test_colliding_digests(spark, kind):
    """With a digest of one of three values texts still only meet their equals."""
    rows = rows_of(kind)
    weak = exact_copies(frame(spark, rows), digest=lambda c: F.pmod(F.length(c), F.lit(3)).cast("string").cast("binary"))
    found = weak.collect()
    want = {t: (max((i for i, u in rows if (u or "") == t and i is not None), default=None), sum((u or "") == t for _, u in rows))
            for t in {u or "" for _, u in rows}}
    assert sum(r.kept for r in found) == len(want) and len(found) == len(rows)
    given = collections.Counter((i, *want[t or ""]) for i, t in rows)
    assert collections.Counter((r.id, r.keep_id, r.group_size) for r in found) == given


@pytest.mark.parametrize("kind", ["awkward", "hot"])
def test_drop(spark, kind):
    rows = rows_of(kind)
    df = frame(spark, rows)
    left = drop_exact_copies(df)
    assert left.columns == df.columns
    found = left.collect()
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert collections.Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in found) == collections.Counter(best.items())
    assert all(rows[r.n] == (r.doc_id, r.text) and r["odd.name"] == "clash odd.name" and r.digest == "clash digest" for r in found)


def test_empty(spark):
    none = frame(spark, rows_of("awkward")).limit(0)
    assert exact_copies(none).count() == 0 and drop_exact_copies(none).count() == 0


def test_hot_text_leaves_each_task_once(spark):
    """Texts are combined before they travel: the first exchange gets one row per text and task."""
    df = spark.range(0, 3000, numPartitions=6).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    from pairmill.llm.exact_dedup import copy_groups

    groups = copy_groups(df.select(F.col("doc_id").alias("id"), F.md5("text").cast("binary").alias("digest"), "text"))
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") + plan.count("SortAggregate") >= 4
    assert [(r.keep_id, r.size) for r in groups.collect()] == [(2999, 3000)]
