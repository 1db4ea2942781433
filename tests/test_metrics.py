"""Scores against brute force."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairmill.functions import overlap as ov
from pairmill.functions import text as tx
from pairmill.operators import bertscore as bs
from pairmill.operators import metrics as me
from pairmill.plans import evaluate as ev


def grams(seq, n):
    return Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))


def clipped(a, b):
    return sum((a & b).values()), sum(a.values()), sum(b.values())


def fm(m, c, r):
    return 2 * m / (c + r) if m else 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def bleu_tokens(text):
    text = text.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in tx.BLEU_ENTITIES:
        text = text.replace(entity, char)
    text = f" {text} "
    for pattern, replacement in tx.BLEU_SPACING:
        text = re.sub(pattern, replacement.replace("$", "\\"), text)
    return text.split()


def bleu(c, r):
    c, r = bleu_tokens(c), bleu_tokens(r)
    logs, smooth, any_match = [], 1.0, False
    for n in range(1, 5):
        m, total, _ = clipped(grams(c, n), grams(r, n))
        if not total:
            break
        any_match |= m > 0
        if m == 0:
            smooth *= 2
        logs.append(math.log(100 * m / total if m else 100 / (smooth * total)))
    if not any_match:
        return 0.0
    penalty = 1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c))
    return penalty * math.exp(sum(logs) / len(logs))


def chrf(c, r):
    c, r = "".join(c.split()), "".join(r.split())
    p = q = k = 0
    for n in range(1, 7):
        m, a, b = clipped(grams(c, n), grams(r, n))
        if a and b:
            p, q, k = p + m / a, q + m / b, k + 1
    if not k or not p + q:
        return 0.0
    p, q = p / k, q / k
    return 100 * 5 * p * q / (4 * p + q)


def expected(c, r, tokenizer):
    pattern = "[a-z0-9]+" if tokenizer == "ascii" else r"[^\W_]+"
    a, b = re.findall(pattern, c.lower()), re.findall(pattern, r.lower())
    return (
        fm(*clipped(grams(a, 1), grams(b, 1))), fm(*clipped(grams(a, 2), grams(b, 2))), fm(lcs(a, b), len(a), len(b)),
        bleu(c, r), chrf(c, r),
    )


@pytest.mark.parametrize("tokenizer", ["ascii", "unicode"])
def test_scores_against_brute_force(spark, tokenizer):
    rng = random.Random(11)
    words = ["a", "b", "ab", "ba", "the", "сөз", "Мәтін", "3.5", "x-1", "&amp;", "<skipped>", "end.", "(q)", "-\n", "😀", "\t", "\u0001"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(1, 40))), " ".join(rng.choices(words, k=rng.randint(1, 40)))) for _ in range(300)]
    pairs += [("a a a a a b", "a a b b b b"), ("x", "x"), ("x", "y"), ("!", "?"), ("aaaa" * 300, "aaa" * 500), (" \n", "a")]
    df = spark.createDataFrame([("s", i, c, r) for i, (c, r) in enumerate(pairs)], "system string, pair_id int, cand string, ref string")
    got = {r.pair_id: r for r in me.pair_scores(df, tokenizer=tokenizer).collect()}
    assert len(got) == len(pairs)
    for i, (c, r) in enumerate(pairs):
        assert [got[i][m] for m in me.METRICS] == pytest.approx(expected(c, r, tokenizer), abs=1e-9), pairs[i]


def test_known_values(spark):
    df = spark.createDataFrame(
        [("s", 1, "a b c", "a b d"), ("s", 2, "a c b d", "a b c d"), ("s", 3, "Қазақ тілі", "Қазақ тілі"), ("s", 4, "", "x"), ("s", 5, None, "x")],
        "system string, pair_id int, cand string, ref string",
    )
    got = {r.pair_id: r for r in me.pair_scores(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].rouge1 == pytest.approx(2 / 3) and got[1].rouge2 == pytest.approx(1 / 2)
    assert got[2].rougeL == pytest.approx(3 / 4)
    assert got[3].rouge1 == 0 and got[3].bleu == pytest.approx(100) and got[3].chrf == pytest.approx(100)
    unicode = {r.pair_id: r for r in me.pair_scores(df, tokenizer="unicode").collect()}
    assert unicode[3].rouge1 == unicode[3].rouge2 == unicode[3].rougeL == 1
    board = me.leaderboard(me.pair_scores(df)).first()
    assert board.n_pairs == 3


def test_lcs_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.choices("abc", k=rng.randint(0, 30)), rng.choices("abc", k=rng.randint(0, 30))
        assert ov.lcs_length(a, b) == lcs(a, b)


def test_scoring_shuffles_nothing(spark):
    df = spark.createDataFrame([("s", 1, "a", "b")], "system string, pair_id int, cand string, ref string")
    plan = me.pair_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bertscore_with_long_sides(spark):
    """A pair of many blocks, next to short pairs, equals the full matrix."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows, want = [], {}
    for pair, (n, m) in enumerate([(1300, 1100), (3, 2), (1, 600)]):
        c, r = rng.normal(size=(n, 8)), rng.normal(size=(m, 8))
        c, r = c.astype("float32"), r.astype("float32")
        for side, block in (("cand", c), ("ref", r)):
            rows += [(pair, side, i, [float(x) for x in v]) for i, v in enumerate(block)]
        s = (c / np.linalg.norm(c, axis=1, keepdims=True)).astype("float64") @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
        p, q = s.max(axis=1).mean(), s.max(axis=0).mean()
        want[pair] = (p, q, 2 * p * q / (p + q))
    tokens = spark.createDataFrame(rows, "pair_id int, side string, pos int, vec array<float>")
    got = {r.pair_id: (r.precision, r.recall, r.f1) for r in bs.bertscore_match(tokens).collect()}
    assert got.keys() == want.keys()
    for pair in want:
        assert got[pair] == pytest.approx(want[pair], abs=1e-5)


def test_identity_system_is_the_upper_bound(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    outputs = ev.system_outputs(docs, "doc_id", "text", "text", {"identity": ("identity", None, {})})
    scored = me.pair_scores(outputs, tokenizer="unicode")
    row = scored.agg(*(F.min(m).alias(m) for m in ("rouge1", "rougeL", "bleu", "chrf"))).first()
    assert row.chrf == pytest.approx(100) and row.bleu == pytest.approx(100)
    assert row.rouge1 in (0.0, 1.0) and row.rougeL in (0.0, 1.0)


def test_char_overlaps_against_brute_force(spark, monkeypatch):
    """Few and many different characters, equal texts, empty ones, and texts beyond the size that is sorted together."""
    rng = random.Random(3)
    orders = ov.CHRF_ORDERS
    for alphabet in ("ab", "abcdefgh\U0001f600", "".join(map(chr, range(0x4E00, 0x4E00 + 20_000)))):
        ref = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(200)]
        cand = [t if i % 3 == 0 else t[i % 7 :] + t[:9] for i, t in enumerate(ref)]
        want = [[clipped(grams(c, n), grams(r, n))[0] for n in orders] for c, r in zip(cand, ref)]
        for together in (1 << 17, 50):
            monkeypatch.setattr(ov, "SORTED_CHARS", together)
            assert ov.char_matches(cand, ref, orders).tolist() == want
    df = spark.createDataFrame([("abc", "abcd"), (None, "a"), ("", "")], "c string, r string")
    rows = [r[0] for r in df.select(ov.char_overlaps("c", "r", (1, 3))).collect()]
    assert [[tuple(x) for x in r] for r in rows] == [[(3, 3, 4), (1, 1, 2)], [(0, 0, 1), (0, 0, 0)], [(0, 0, 0), (0, 0, 0)]]
    assert ov.char_matches([], [], orders).shape == (0, 6)


def test_word_overlaps_against_brute_force(spark, monkeypatch):
    """Token grams as numbers: repeated grams, many different tokens, equal lists, empty ones, NULL, slices of a batch."""
    rng = random.Random(5)
    for kinds in (3, 5000):
        ref = [[f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 40))] for _ in range(150)]
        cand = [t if i % 3 == 0 else t[i % 5 :] + t[:4] for i, t in enumerate(ref)]
        want = [[clipped(grams(c, n), grams(r, n))[0] for n in ov.BLEU_ORDERS] for c, r in zip(cand, ref)]
        sides = pa.array([["x"], *cand])[1:], pa.array([["y", "z"], *ref])[1:]
        for together in (1 << 17, 50):
            monkeypatch.setattr(ov, "SORTED_CHARS", together)
            assert ov.word_matches(*sides, ov.BLEU_ORDERS).tolist() == want
    df = spark.createDataFrame([(["a", "b", "a"], ["a", "a"]), (["a"], ["a"]), (None, ["a"]), ([], [])], "c array<string>, r array<string>")
    rows = [r[0] for r in df.select(ov.word_overlaps("c", "r", (1, 2))).collect()]
    assert [[tuple(x) for x in r] for r in rows] == [
        [(2, 3, 2), (0, 2, 1)], [(1, 1, 1), (0, 0, 0)], [(0, 0, 1), (0, 0, 0)], [(0, 0, 0), (0, 0, 0)],
    ]


def test_scores_make_no_gram_strings(spark, sf):
    """The systems read their pairs once, and all scores cross to Python in one step."""
    systems = {"identity": ("identity", None, {}), "lead": ("lead", None, {}), "tfidf": ("tfidf", None, {})}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = me.pair_scores(ev.system_outputs(docs, "doc_id", "text", "text", systems))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 2 and "array_intersect" not in plan


def test_long_pair_meets_in_many_cells(spark, monkeypatch):
    """One pair with most of all tokens is a grid of cells, so that no join key holds all its meetings."""
    monkeypatch.setattr(bs, "BLOCK", 16)
    monkeypatch.setattr(bs, "STRIP", 2)
    side = F.when(F.col("id") % 2 == 0, "cand").otherwise("ref")
    long_pair = spark.range(1200).select(F.lit(0).alias("pair_id"), side.alias("side"), F.col("id").alias("pos"))
    short = spark.range(40).select((F.col("id") % 10 + 1).cast("int").alias("pair_id"), F.when(F.col("id") < 20, "cand").otherwise("ref").alias("side"), F.col("id").alias("pos"))
    angle = F.col("pos") % 17 + F.col("pair_id") + 0.3
    tokens = long_pair.unionByName(short).withColumn("vec", F.array(F.cos(angle), F.sin(angle * 2), F.lit(0.4)))
    cand, ref = bs.strips(tokens, ["pair_id"])
    cells = cand.join(ref, ["pair_id", "_cand_strip", "_ref_strip"]).groupBy("pair_id", "_cand_strip", "_ref_strip").count()
    of_long = [r["count"] for r in cells.filter("pair_id = 0").collect()]
    blocks = 75
    assert sum(of_long) == blocks * blocks and len(of_long) > 200 and max(of_long) < 200
    assert all(r["count"] <= 9 for r in cells.filter("pair_id > 0").collect())
    spread = {r.pair_id: r for r in bs.bertscore_match(tokens).collect()}
    monkeypatch.setattr(bs, "BLOCK", 4096)
    for row in bs.bertscore_match(tokens).collect():
        assert tuple(spread[row.pair_id]) == pytest.approx(tuple(row))
