"""Vectors of whole numbers: each component times a scale, rounded down."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Larger components are refused: sums and products of whole numbers must fit in 64 bits.
LARGEST = 1 << 27


def whole(vec: Column) -> Column:
    """True for vectors without NULL or non-finite components; false for a NULL vector."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def floors(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double. A component beyond ``LARGEST`` raises an error."""

    def one(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * F.lit(float(scale)))
        fits = F.abs(x.cast("double")) <= F.lit(LARGEST / scale)
        return F.when(fits, scaled.cast("int")).otherwise(F.raise_error(F.lit("a component is too large to be scaled")).cast("int"))

    return F.transform(vec, one)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column, all lists of length ``dim``, as a matrix of 64-bit integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64)
