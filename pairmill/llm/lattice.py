"""Near-duplicate vectors by lattice hashing.

Each table projects a vector to sixteen random directions and decodes both halves to the nearest point of the E8 lattice;
the pair of points is the vector's cell. A vector lives in its cell and visits the cells that lie nearest otherwise.
Vectors that meet in a cell of any table are compared by cosine. Their links give components; inside each component all
pairs are compared once, which gives the exact number of links of each vector.

Copies of a vector are one node. A cell or component of any size is compared in blocks, so no task holds a whole group,
and no pair becomes a row: a block leaves labels or counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.blocks import block_slices, into_blocks, settle
from pairmill.llm.components import components
from pairmill.session import freeze

# A pair at cosine 0.95 meets in a table with probability 0.44, in none of twelve with 0.001.
TABLES = 12
PROBES = 4
SCALE = 0.25
HALVES = 2
SEED = 20


def decode_e8(points: np.ndarray) -> np.ndarray:
    """The nearest point of the E8 lattice for each row of eight numbers: the better of the nearest points of D8 and of
    D8 shifted by one half."""

    def decode_d8(x: np.ndarray) -> np.ndarray:
        near = np.rint(x)
        rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        # An odd sum is mended where rounding went furthest.
        at = np.abs(x[rows] - near[rows]).argmax(axis=1)
        near[rows, at] += np.where(x[rows, at] >= near[rows, at], 1.0, -1.0)
        return near

    whole, half = decode_d8(points), decode_d8(points - 0.5) + 0.5
    better = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(better[:, None], whole, half)


def e8_neighbours() -> np.ndarray:
    """The 240 shortest lattice vectors."""
    found = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    found.append(v)
    for signs in range(256):
        v = np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)])
        if signs.bit_count() % 2 == 0:
            found.append(v)
    return np.array(found)


class Tables:
    """Random directions and shifts of all tables for vectors of one length."""

    def __init__(self, dim: int, tables: int, scale: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        width = 8 * HALVES
        self.directions, self.shifts = [], []
        for _ in range(tables):
            basis = rng.normal(size=(dim, width))
            # Orthogonal directions where there is room for them; scaled so that lengths shrink alike in any dimension.
            if dim >= width:
                basis = np.linalg.qr(basis)[0]
            self.directions.append(basis / scale * np.sqrt(dim / 64) if dim >= width else basis / np.sqrt(64) / scale)
            self.shifts.append(rng.uniform(size=width))
        self.salt = rng.integers(1, 1 << 62, size=(tables, width), dtype=np.int64) | 1
        self.around = e8_neighbours()

    def cells(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """Cell numbers of each vector: for each table the home cell and ``probes`` others, nearest first."""
        found = []
        for t, (directions, shift) in enumerate(zip(self.directions, self.shifts)):
            x = unit @ directions + shift
            code = np.concatenate([decode_e8(x[:, 8 * h : 8 * h + 8]) for h in range(HALVES)], axis=1)
            rest = x - code
            # Going to a neighbour adds this to the squared distance, up to a constant.
            cost = np.concatenate([-rest[:, 8 * h : 8 * h + 8] @ self.around.T for h in range(HALVES)], axis=1)
            nearest = np.argpartition(cost, probes, axis=1)[:, :probes]
            doubled = np.rint(code * 2).astype(np.int64)
            home = (doubled * self.salt[t]).sum(axis=1) + t
            steps = np.rint(self.around * 2).astype(np.int64)
            moves = np.concatenate([(steps * self.salt[t, 8 * h : 8 * h + 8]).sum(axis=1) for h in range(HALVES)])
            found.append(np.column_stack([home, home[:, None] + moves[nearest]]))
        return np.stack(found, axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as doubles) for each vector length in a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    found = []
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        found.append((rows, flat[starts[rows][:, None] + np.arange(dim)[None, :]]))
    return found


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vec: Column) -> Column:
    """True for vectors that have a direction."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec: str = "embedding",
    threshold: float = 0.95,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``df``.

    ``n_links`` counts the other rows linked directly (cosine at least ``threshold``, in double precision), copies
    included; ``component_id`` is the smallest id reachable by links, ``kept`` tells whether that is the row's own. Vectors
    that are NULL, zero, or hold NULL or non-finite components, link with nothing; neither do vectors of different length.
    Rows without an id take part and count; a component without any id has NULL. Other columns are left out. An empty
    table gives an empty one. Runs jobs when called.
    """
    kind = df.schema[vec].dataType.elementType.simpleString()
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))

    def name_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            names: list[bytes] = [b""] * len(column)
            for at, vectors in _matrix(column):
                for i, v in zip(at, vectors + 0.0):
                    names[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), column, pa.array(names, pa.binary())], ["id", "vec", "node"]
            )

    named = rows.filter(usable(F.col("vec"))).mapInArrow(name_nodes, f"id {id_type}, vec array<{kind}>, node binary")
    nodes = named.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("vec").alias("vec"))
    nodes = freeze(nodes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            names = batch.column("node")
            for at, vectors in _matrix(batch.column("vec")):
                dim = vectors.shape[1]
                made.setdefault(dim, Tables(dim, tables, scale, SEED))
                for start in range(0, len(at), 2048):
                    some = at[start : start + 2048]
                    cells = made[dim].cells(unit(vectors[start : start + 2048]), probes).reshape(len(some), -1)
                    # The length takes part in the cell, so lengths never meet.
                    cells = cells * 1_000_003 + dim
                    home = np.tile(np.arange(cells.shape[1]) % (probes + 1) == 0, len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells.ravel()), pa.array(home), names.take(pa.array(np.repeat(some, cells.shape[1])))],
                        ["cell", "home", "node"],
                    )

    placed = nodes.select("node", "vec").mapInArrow(place, "cell long, home boolean, node binary")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    sizes = freeze(sizes.filter("n > 1 and homes > 0"))
    dealt = into_blocks(placed, sizes, "cell", "node").join(nodes.select("node", "vec"), "node")

    def link_cells(table: pa.Table) -> pa.Table:
        names = table.column("node").combine_chunks()
        key, lo, hi, piece = (table.column(c).to_numpy() for c in ("cell", "lo", "hi", "piece"))
        home = table.column("home").to_numpy()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, vectors in _matrix(table.column("vec")):
            directions = unit(vectors)
            for block in block_slices(key[at], lo[at], hi[at]):
                inside = at[block]
                linked = directions[block] @ directions[block].T >= threshold
                linked &= home[inside][:, None] | home[inside][None, :]
                if lo[inside[0]] != hi[inside[0]]:
                    linked &= piece[inside][:, None] != piece[inside][None, :]
                np.fill_diagonal(linked, False)
                if linked.any():
                    label = settle(linked)
                    far = np.flatnonzero(label != np.arange(len(label)))
                    a.append(inside[far])
                    b.append(inside[label[far]])
        return pa.table({"a": names.take(pa.array(np.concatenate(a))), "b": names.take(pa.array(np.concatenate(b)))})

    links = dealt.groupBy("bin").applyInArrow(link_cells, "a binary, b binary")
    found = freeze(components(links.distinct()))
    groups = freeze(found.groupBy("component").agg(F.count("*").alias("n")))
    members = found.join(nodes.select("node", "vec", "copies"), "node")

    def count_links(table: pa.Table) -> pa.Table:
        names = table.column("node").combine_chunks()
        _, key = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)
        lo, hi, piece, copies = (table.column(c).to_numpy() for c in ("lo", "hi", "piece", "copies"))
        links = np.zeros(table.num_rows, np.int64)
        for at, vectors in _matrix(table.column("vec")):
            directions = unit(vectors)
            for block in block_slices(key[at], lo[at], hi[at]):
                inside = at[block]
                linked = directions[block] @ directions[block].T >= threshold
                if lo[inside[0]] != hi[inside[0]]:
                    linked &= piece[inside][:, None] != piece[inside][None, :]
                np.fill_diagonal(linked, False)
                links[inside] += linked @ copies[inside]
        return pa.table({"node": names, "links": links})

    counted = into_blocks(members, groups, "component", "node").groupBy("bin")
    counted = counted.applyInArrow(count_links, "node binary, links long").groupBy("node").agg(F.sum("links").alias("links"))
    least = found.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    linked = found.join(least, "component").join(counted, "node").select("node", "links", "least")
    by_node = nodes.select("node", "copies", F.col("id").alias("own")).join(linked, "node", "left")
    by_node = by_node.select(
        "node",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("links").isNotNull(), F.col("least")).otherwise(F.col("own")).alias("component_id"),
    )
    judged = named.select("id", "node").join(by_node, "node").select("id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col("vec"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return judged.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
