"""Small NumPy helpers for Arrow batches of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def unit_rows(vectors) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, so their cosine with anything is 0."""
    rows = np.array([np.asarray(v, dtype="float64") for v in vectors])
    if rows.size == 0:
        return rows.reshape(len(rows), 0)
    return scaled(rows)


def scaled(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def packed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of the vectors in a list column that are there and hold neither NULL nor a non-finite component, and their
    components as bytes: 32-bit numbers if the column has these, else 64-bit ones."""
    kind = number_kind(column.type)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    # Zero has one sign, so that equal vectors have equal bytes; NULL is not finite.
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (odd[ends[1:]] == odd[ends[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    kept = flat[np.repeat(good, lengths)]
    bounds = np.concatenate([[0], np.cumsum(lengths[good])]) * flat.itemsize
    offsets = pa.py_buffer(bounds.astype("int32"))
    return np.flatnonzero(good), pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, offsets, pa.py_buffer(kept)])


def number_kind(kind: pa.DataType) -> str:
    """The NumPy numbers in which :func:`packed` keeps the vectors of a list column of this type."""
    return "float32" if kind.value_type == pa.float32() else "float64"


def unit_matrices(column: pa.Array | pa.ChunkedArray, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length in a column of packed vectors: the places of its vectors, and the vectors at length one."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    lengths = np.concatenate([np.zeros(0, "int64"), *(pc.binary_length(c).to_numpy() for c in chunks)])
    parts = []
    for chunk in chunks:
        bounds = np.frombuffer(chunk.buffers()[1], "int32", len(chunk) + 1, 4 * chunk.offset) if len(chunk) else [0]
        if bounds[-1] > bounds[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], "uint8")[bounds[0] : bounds[-1]].view(kind))
    flat = np.concatenate([np.zeros(0, kind), *parts])
    lengths = lengths // flat.itemsize
    starts = np.cumsum(lengths) - lengths
    found = {}
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        rows = flat.reshape(-1, dim) if dim and len(at) == len(lengths) else flat[starts[at][:, None] + np.arange(dim)]
        found[dim] = at, scaled(rows.astype("float64"))
    return found
