"""Scores of a candidate text against its reference, as column expressions.

All of them rest on one quantity, the clipped overlap of two bags of n-grams: the sum over grams of the smaller of the two
counts. Tokens and texts are cut by built-in functions; grams never become strings or rows. In an Arrow batch they are
numbers, and the overlaps of its rows come from one sort of them for each order. Only the overlaps come back, so scoring a
table is a map and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROUGE_ORDERS = (1, 2)
BLEU_ORDERS = (1, 2, 3, 4)
CHRF_ORDERS = (1, 2, 3, 4, 5, 6)
CHRF_BETA = 2


def f_measure(match: Column, cand: Column, ref: Column) -> Column:
    """2PR / (P + R) with P = match / cand and R = match / ref, 0 when nothing matches."""
    return F.coalesce(F.try_divide(match * 2.0, cand + ref), F.lit(0.0))


def rouge_n(of: Column) -> Column:
    """ROUGE-N F-measure from the overlap of order n."""
    return f_measure(of["m"], of["c"], of["r"])


def bleu(overlaps: Sequence[Column]) -> Column:
    """Sentence BLEU, 0 to 100: orders up to the longest gram the candidate has, geometric mean of the precisions,
    each zero match smoothed by twice the previous smoothing, brevity penalty; no match at all gives 0."""
    log_sum, order, misses = F.lit(0.0), F.lit(0), F.lit(0)
    for of in overlaps:
        match, total = of["m"], of["c"]
        missed = (total > 0) & (match == 0)
        misses = misses + missed.cast("int")
        precision = F.when(missed, F.lit(100.0) / (F.pow(F.lit(2.0), misses) * total)).when(
            total > 0, match * 100.0 / total
        )
        log_sum = log_sum + F.coalesce(F.log(precision), F.lit(0.0))
        order = order + (total > 0).cast("int")
    cand_len, ref_len = overlaps[0]["c"], overlaps[0]["r"]
    brevity = F.when(cand_len < ref_len, F.exp(1 - F.try_divide(ref_len, cand_len))).otherwise(1.0)
    # Any longer match contains a match of a single token.
    return F.when(overlaps[0]["m"] > 0, brevity * F.exp(log_sum / order)).otherwise(0.0)


def chrf(overlaps: Sequence[Column]) -> Column:
    """Sentence chrF, 0 to 100: precision and recall averaged over the orders where both sides have grams."""
    precision, recall, orders = F.lit(0.0), F.lit(0.0), F.lit(0)
    for of in overlaps:
        match, cand, ref = of["m"], of["c"], of["r"]
        both = (cand > 0) & (ref > 0)
        precision = precision + F.when(both, match / cand).otherwise(0.0)
        recall = recall + F.when(both, match / ref).otherwise(0.0)
        orders = orders + both.cast("int")
    weight = CHRF_BETA**2
    p, r = F.try_divide(precision, orders), F.try_divide(recall, orders)
    return F.coalesce(F.try_divide(100.0 * (1 + weight) * p * r, weight * p + r), F.lit(0.0))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with a row of the table held as the bits of one integer."""
    where: dict[str, int] = {}
    for i, token in enumerate(b):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        if token in where:
            hits = row & where[token]
            row = ((row + hits) | (row - hits)) & full
    return len(b) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def _lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([lcs_length(x or (), y or ()) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def lcs(cand: Column | str, ref: Column | str) -> Column:
    """Longest common subsequence of two token arrays; the one score that no built-in function expresses."""
    return F.when(_equal(cand, ref), F.array_size(cand)).otherwise(_lcs(*_unequal(cand, ref)))


def _equal(cand: Column | str, ref: Column | str) -> Column:
    cand, ref = (F.col(c) if isinstance(c, str) else c for c in (cand, ref))
    return cand == ref


def _unequal(cand: Column | str, ref: Column | str) -> list[Column]:
    """Both sides where they differ, else NULL: equal sides need no counting, so they do not go to Python."""
    return [F.when(~_equal(cand, ref), c if isinstance(c, Column) else F.col(c)) for c in (cand, ref)]


# Tokens or characters of the rows whose grams are sorted together; a longer pair of texts is sorted alone.
SORTED_CHARS = 1 << 17


def _with_sizes(matches: Column, equal: Column, cand: Column, ref: Column, orders: Sequence[int]) -> Column:
    """Array of (m, c, r) for each order: clipped matches of two bags of grams, and their sizes; from the lengths of both."""
    equal = F.coalesce(equal, F.lit(False))

    def windows(length: Column, n: int) -> Column:
        return F.greatest(F.coalesce(length, F.lit(0)) - (n - 1), F.lit(0))

    sizes = F.array(*(F.struct(windows(cand, n).alias("c"), windows(ref, n).alias("r")) for n in orders))
    return F.zip_with(
        matches,
        sizes,
        lambda m, size: F.struct(F.when(equal, size["c"]).otherwise(m).alias("m"), size["c"].alias("c"), size["r"].alias("r")),
    )


def char_overlaps(cand: Column | str, ref: Column | str, orders: Sequence[int] = CHRF_ORDERS) -> Column:
    """Array of the clipped overlaps (m, c, r) of two texts, one for each order. NULL counts as empty."""
    orders = tuple(orders)

    @F.arrow_udf("array<int>")
    def matches(a: pa.Array, b: pa.Array) -> pa.Array:
        texts = (side.fill_null("").to_pylist() for side in (a, b))
        return _lists(char_matches(*texts, orders))

    return _with_sizes(matches(*_unequal(cand, ref)), _equal(cand, ref), F.length(cand), F.length(ref), orders)


def word_overlaps(cand: Column | str, ref: Column | str, orders: Sequence[int]) -> Column:
    """The same for two arrays of tokens."""
    orders = tuple(orders)

    @F.arrow_udf("array<int>")
    def matches(a: pa.Array, b: pa.Array) -> pa.Array:
        return _lists(word_matches(a, b, orders))

    return _with_sizes(matches(*_unequal(cand, ref)), _equal(cand, ref), F.array_size(cand), F.array_size(ref), orders)


def _lists(found: np.ndarray) -> pa.Array:
    rows, width = found.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype="int32") * width), pa.array(found.ravel()))


def char_matches(cand: list[str], ref: list[str], orders: Sequence[int]) -> np.ndarray:
    """For each pair of texts and each order the matches of their bags of character grams."""

    def some(at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [*cand[at:end], *ref[at:end]]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return chars, np.fromiter(map(len, texts), dtype="int64", count=len(texts))

    return _in_groups(np.array([len(a) + len(b) for a, b in zip(cand, ref)], dtype="int64"), some, orders)


def word_matches(cand: pa.Array, ref: pa.Array, orders: Sequence[int]) -> np.ndarray:
    """For each pair of token lists and each order the matches of their bags of token grams."""
    lengths = [side.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64") for side in (cand, ref)]
    # Numbers of tokens hold for both sides of the batch.
    tokens = pa.chunked_array([cand.flatten(), ref.flatten()]).combine_chunks()
    codes = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = [np.r_[0, np.cumsum(lengths[0])], np.r_[0, np.cumsum(lengths[1])] + lengths[0].sum()]

    def some(at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([codes[e[at] : e[end]] for e in ends]), np.concatenate([n[at:end] for n in lengths])

    return _in_groups(lengths[0] + lengths[1], some, orders)


def _in_groups(sizes: np.ndarray, some: Callable, orders: Sequence[int]) -> np.ndarray:
    """The matches of all pairs, of as many together as hold ``SORTED_CHARS``. ``some`` gives the values of the pairs from one
    number up to another, those of all candidates before those of all references, and the length of each text."""
    found = np.zeros((len(sizes), len(orders)), dtype="int32")
    sizes = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SORTED_CHARS, side="right")))
        found[at:end] = _sorted_matches(*some(at, end), orders)
        at = end
    return found


def _sorted_matches(values: np.ndarray, lengths: np.ndarray, orders: Sequence[int]) -> np.ndarray:
    n = len(lengths) // 2
    alphabet, chars = np.unique(values, return_inverse=True)
    place = np.repeat(np.arange(2 * n), lengths)
    # The pair above the side, so that both sides of a gram are neighbours once sorted.
    pair, side = place % n, place // n
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
    size = max(1, len(alphabet))
    found = np.zeros((n, len(orders)), dtype="int64")
    grams, kinds = chars.astype("int64"), size
    for order in range(1, max(orders) + 1):
        fits = np.flatnonzero(room >= order)
        if not len(fits):
            break
        if order > 1:
            # A gram is the one before it and its last character; numbers are drawn together before they overflow.
            if kinds * size >= (1 << 61) // n:
                known, grams = np.unique(grams, return_inverse=True)
                kinds = len(known)
            grams = grams[kept[fits]] * size + chars[fits + order - 1]
            kinds *= size
        kept = np.zeros(len(chars) + 1, dtype="int64")
        kept[fits] = np.arange(len(fits))
        if order in orders:
            keys = np.sort((pair[fits] * kinds + grams) * 2 + side[fits])
            first = np.flatnonzero(np.r_[True, (keys[1:] >> 1) != (keys[:-1] >> 1)])
            of_ref = np.add.reduceat(keys & 1, first)
            both = np.minimum(of_ref, np.diff(np.r_[first, len(keys)]) - of_ref)
            found[:, list(orders).index(order)] = np.bincount((keys[first] >> 1) // kinds, both, minlength=n)
    return found
