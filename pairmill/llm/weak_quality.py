"""Document quality by weak supervision.

Each rule looks at one property of a text and votes good (1) or bad (-1), or abstains (0). Expectation-maximisation over
the counts of vote patterns estimates how accurate the votes of each rule are and how many documents are good;
a document's posterior probability of being good weighs its votes by those accuracies. There are at most three to the power of the
number of rules patterns, whatever the number of documents, so the estimate takes one narrow aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import text_or_empty
from pairmill.operators.columns import compute_once
from pairmill.session import stage

# Fixed values of the base features.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_ends",
    "n_letters", "n_bare",
)
# Above this product of windows and repeated windows, positions are found by sorting instead of by look-up.
LOOK_UP = 50_000_000


def _windows(words: Column) -> Column:
    """Hashes of all runs of three words. At 64 bits, two different runs of a text of a thousand words agree once in
    3e13 texts."""
    last = F.size(words) - 3
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def _with_repeated_positions(df: DataFrame) -> DataFrame:
    """Add ``__pm_at``: positions of the windows that occur twice or more, ascending. Both ways give the same; looking each
    window up is the faster for few repeats, sorting takes n log n for any number."""
    windows, repeated = F.col("__pm_windows"), F.col("__pm_repeated")
    small = F.size(windows).cast("long") * F.size(repeated) <= LOOK_UP
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = compute_once(df, __pm_placed=F.when(~small, pairs))
    placed = F.col("__pm_placed")

    def same(p: Column, k: Column) -> Column:
        return F.coalesce(F.get(placed, k)["x"] == p["x"], F.lit(False))

    twins = F.filter(placed, lambda p, k: same(p, k + 1) | ((k > 0) & same(p, k - 1)))
    by_sort = F.sort_array(F.transform(twins, lambda p: p["i"]))
    at = F.sequence(F.lit(0), F.size(windows) - 1)
    by_look_up = F.filter(at, lambda i: F.array_contains(repeated, F.get(windows, i)))
    none = F.array().cast("array<int>")
    found = F.when(F.size(repeated) == 0, none).when(small, by_look_up).otherwise(by_sort)
    return compute_once(df, __pm_at=found).drop("__pm_windows", "__pm_repeated", "__pm_placed")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base features n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides:
    n_lines, n_capitals, n_shouts, n_ends, n_letters, n_bare. All are long; a NULL text counts as empty and has 0 everywhere.

    Words are runs without space, line breaks and the like. n_repeat_words counts the words inside runs of three words
    that the text holds twice or more. All is computed inside the row, in time proportional to n log n of its words.
    """
    t = text_or_empty(text)
    df = compute_once(
        df,
        __pm_words=F.array_remove(F.split(t, SPACE), ""),
        __pm_lines=F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        n_symbols=F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        n_capitals=F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        n_shouts=F.regexp_count(t, F.lit("!!")).cast("long"),
        n_ends=F.regexp_count(t, F.lit(r"[.?!](?=[\x20\x09-\x0D]|$)")).cast("long"),
        n_letters=(F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long"),
        n_bare=F.regexp_count(t, F.lit(r"(?:^|[\x20\n])[^\p{L}\p{N}\x20\n]+(?=[\x20\n]|$)")).cast("long"),
    )
    df = compute_once(
        df.withColumns(
            {
                "n_lines": F.size("__pm_lines").cast("long"),
                "n_dup_lines": (F.size("__pm_lines") - F.size(F.array_distinct("__pm_lines"))).cast("long"),
            }
        ).drop("__pm_lines"),
        n_words=F.size("__pm_words").cast("long"),
        word_chars=F.length(F.array_join("__pm_words", "")).cast("long"),
        __pm_windows=_windows(F.col("__pm_words")),
    ).drop("__pm_words")
    df = compute_once(df, __pm_sorted=F.sort_array("__pm_windows"))
    twice = F.filter("__pm_sorted", lambda x, i: F.get(F.col("__pm_sorted"), i + 1) == x)
    df = compute_once(df, __pm_repeated=F.array_distinct(twice)).drop("__pm_sorted")
    df = _with_repeated_positions(df)
    covered = F.transform("__pm_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("__pm_at"), k + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0), lambda a, n: a + n).cast("long")
    return df.withColumn("n_repeat_words", total).drop("__pm_at")


def _vote(bad: Column, good: Column | None = None) -> Column:
    if good is None:
        return F.when(bad, -1).otherwise(0)
    return F.when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes on the columns of :func:`features`."""
    words, chars = F.col("n_words"), F.col("word_chars")
    mean = F.coalesce(F.try_divide(chars, words), F.lit(0.0))
    per_end = F.coalesce(F.try_divide(words, F.col("n_ends")), F.lit(1e9))
    return {
        "symbols": _vote(F.col("n_symbols") * 10 > words, F.col("n_symbols") * 100 <= words),
        "letters": _vote(F.col("n_letters") * 20 < chars * 17, F.col("n_letters") * 10 >= chars * 9),
        "bare": _vote(F.col("n_bare") * 5 > words),
        "capitals": _vote(F.col("n_capitals") * 2 > chars),
        "shouts": _vote(F.col("n_shouts") * 20 > words),
        "repeats": _vote(F.col("n_repeat_words") * 3 > words),
        "lines": _vote(F.col("n_dup_lines") * 3 > F.col("n_lines")),
        "sentences": _vote((per_end > 100) | (per_end < 2), (per_end >= 3) & (per_end <= 40)),
        "lengths": _vote((mean < 2) | (mean > 12), (mean >= 3) & (mean <= 9)),
    }


# What is known of a rule before any vote is counted: how often it votes bad, abstains or votes good on good and on bad
# documents. Worth ``PRIOR_VOTES`` counted votes.
PRIOR = {True: {-1: 0.02, 0: 0.28, 1: 0.70}, False: {-1: 0.50, 0: 0.30, 1: 0.20}}
PRIOR_VOTES = 10.0
PRIOR_SHARE = 0.8


def estimate(
    patterns: Mapping[tuple[int, ...], int], rules: int, rounds: int = 200, close: float = 1e-9
) -> tuple[list[dict[int, float]], float]:
    """(evidence of each rule's votes, log-odds of good before any vote) by expectation-maximisation over counts of vote
    patterns.

    Each rule has its own rates of voting bad, good or not at all, on good and on bad documents. The evidence of a vote is
    the logarithm of its rate on good documents over that on bad ones; a vote never counts against its own meaning and
    an abstention counts nothing, which keeps good and bad from changing places.
    """
    order = sorted(patterns)
    total = sum(patterns.values())
    evidence = [{v: math.log(PRIOR[True][v] / PRIOR[False][v]) for v in (-1, 1)} for _ in range(rules)]
    share = PRIOR_SHARE
    for _ in range(rounds if total else 0):
        good = {p: posterior(p, evidence, _log_odds(share)) for p in order}
        mass = {True: sum(patterns[p] * good[p] for p in order)}
        mass[False] = total - mass[True]
        new = []
        for j in range(rules):
            rates = {
                (y, v): (
                    PRIOR_VOTES * PRIOR[y][v]
                    + sum(patterns[p] * (good[p] if y else 1 - good[p]) for p in order if p[j] == v)
                )
                / (PRIOR_VOTES + mass[y])
                for y in (True, False)
                for v in (-1, 1)
            }
            bad_vote, good_vote = (math.log(rates[True, v] / rates[False, v]) for v in (-1, 1))
            new.append({-1: min(0.0, bad_vote), 1: max(0.0, good_vote)})
        new_share = min(0.99, max(0.5, mass[True] / total))
        moved = max([abs(new_share - share), *(abs(a[v] - b[v]) for a, b in zip(new, evidence) for v in (-1, 1))])
        evidence, share = new, new_share
        if moved <= close:
            break
    return evidence, _log_odds(share)


def _log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def posterior(votes: Sequence[int], evidence: Sequence[Mapping[int, float]], start: float) -> float:
    """The probability of being good, given the votes."""
    odds = start + sum(e[v] for v, e in zip(votes, evidence) if v)
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def judge(
    df: DataFrame,
    text: str = "text",
    rules: Mapping[str, Column] | None = None,
    keep: float = 0.5,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Add the features, ``base_failed``, ``p_good`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words in repeated runs. ``kept``: not failed, and the
    posterior probability of being good is at least ``keep``. Accuracies are estimated on the documents that did not
    fail. Repeated rows get the same verdict; NULL and empty texts fail; an empty table gives an empty one. Columns of
    the input that carry a name of these are replaced. Runs one aggregate over all documents when called.

    With ``carry`` only those columns of the input stay; they are written together with the features, which are then computed
    once and not once for the estimate and once for the result.
    """
    rules = dict(rules or default_rules())
    df = features(df, text)
    if carry is not None:
        df, _ = stage(df.select(*carry, *FEATURES), "quality")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    names = [f"__pm_vote_{i}" for i in range(len(rules))]
    df = compute_once(df, base_failed=failed, **dict(zip(names, rules.values())))
    rows = df.filter("not base_failed").groupBy(*names).agg(F.count("*").alias("__pm_n")).collect()
    evidence, before = estimate({tuple(r[n] for n in names): r["__pm_n"] for r in rows}, len(rules))
    odds = F.lit(before)
    for name, e in zip(names, evidence):
        odds = odds + F.when(F.col(name) < 0, e[-1]).when(F.col(name) > 0, e[1]).otherwise(0.0)
    df = df.withColumn("p_good", 1 / (1 + F.exp(-odds))).drop(*names)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))
