"""Batch inference with user-supplied callables.

A factory builds the callable once per task, inside the worker, so models are loaded there and never
travel. Only the one input column crosses to Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def generate(
    df: DataFrame,
    in_col: str,
    out_col: str,
    factory: Callable[..., Callable[[str], str]],
    prefix: str = "",
    options: dict | None = None,
) -> DataFrame:
    """Text to text, one call per row: ``factory(**options)`` gives the callable. A call that raises, or a NULL
    input, gives ''. ``prefix`` is put before the input text."""
    options = dict(options or {})

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = factory(**options)

        def one(text):
            try:
                return "" if text is None else call(text)
            except Exception:
                return ""

        for batch in batches:
            yield pd.Series([one(t) for t in batch], dtype="object")

    text = F.concat(F.lit(prefix), F.col(in_col)) if prefix else F.col(in_col)
    return df.withColumn(out_col, run(text))


def encode(
    df: DataFrame, in_col: str, out_col: str, factory: Callable[..., Callable[[list[str]], list]], options: dict | None = None
) -> DataFrame:
    """Text to vector. A call gets some texts of an Arrow batch, at most ``CALL_ROWS`` and ``CALL_CHARS`` characters unless
    one text alone has more; it returns as many vectors, as a matrix or a list. What a task holds does not grow with the
    batch but for its 32-bit results."""
    options = dict(options or {})

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = factory(**options)
        for batch in batches:
            batch = batch.fill_null("")
            made = [_vectors(call(part.to_pylist()), len(part)) for part in _parts(batch)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float32()))

    return df.withColumn(out_col, run(F.col(in_col)))


# Texts and characters that an encoder gets in one call.
CALL_ROWS = 4096
CALL_CHARS = 1 << 18


def _parts(batch: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.utf8_length(batch).to_numpy(zero_copy_only=False).astype("int64"))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = min(at + CALL_ROWS, max(at + 1, int(np.searchsorted(ends, before + CALL_CHARS, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def _vectors(made: Sequence | np.ndarray, rows: int) -> pa.Array:
    """Vectors of a call as Arrow lists of 32-bit numbers, NaN as NULL."""
    if len(made) != rows:
        raise ValueError(f"the encoder made {len(made)} vectors of {rows} texts")
    if isinstance(made, np.ndarray) and made.ndim == 2:
        flat, lengths = made.astype("float32").ravel(), np.full(rows, made.shape[1])
    else:
        lists = [np.array([float(x) for x in v], dtype="float32") for v in made]
        flat, lengths = np.concatenate([np.zeros(0, "float32"), *lists]), [len(v) for v in lists]
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32(), from_pandas=True))


def hashed_grams(dim: int = 256, size: int = 3) -> Callable[[list[str]], np.ndarray]:
    """The default encoder, which needs no model: counts of character grams in ``dim`` hashed places, at length one.

    A text is lower-cased and has a blank put on both ends; one that is shorter than a gram is a gram itself. Texts that
    share many grams have a high cosine, whatever their language or script. Grams are numbers, and only distinct ones among
    ``WINDOW`` of them are hashed."""

    @lru_cache(1 << 16)
    def place(gram: str) -> int:
        return int(hashlib.md5(gram.encode()).hexdigest()[:7], 16) % dim

    def encoded(texts: list[str]) -> np.ndarray:
        padded = [f" {t.lower()} " for t in texts]
        lengths = np.fromiter(map(len, padded), dtype="int64", count=len(padded))
        counts = np.zeros((len(padded), dim))
        for i in np.flatnonzero(lengths < size):
            counts[i, place(padded[i])] += 1
        joined = "".join(padded)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum(lengths)
        for at in range(0, len(chars), WINDOW):
            start = np.arange(at, min(at + WINDOW, len(chars)))
            text = np.searchsorted(ends, start, side="right")
            fits = start + size <= ends[text]
            start, text = start[fits], text[fits]
            if not len(start):
                continue
            _, first, number = np.unique(_gram_numbers(chars, start, size), return_index=True, return_inverse=True)
            places = np.array([place(joined[i : i + size]) for i in start[first].tolist()])
            low = text[0]
            cells = (text - low) * dim + places[number]
            high = text[-1] + 1
            counts[low:high] += np.bincount(cells, minlength=(high - low) * dim).reshape(-1, dim)
        return counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))

    return encoded


# Grams that are numbered together.
WINDOW = 1 << 17
# Bits of a character's number.
CHAR_BITS = 21


def _gram_numbers(chars: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A number for each gram of ``size`` characters, the same for equal grams."""
    numbers, bits = chars[start].astype("int64"), CHAR_BITS
    for i in range(1, size):
        if bits + CHAR_BITS > 63:
            _, numbers = np.unique(numbers, return_inverse=True)
            bits = len(start).bit_length()
        numbers = numbers << CHAR_BITS | chars[start + i]
        bits += CHAR_BITS
    return numbers
