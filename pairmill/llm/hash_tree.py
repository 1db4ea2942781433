"""Sharding by a hierarchical weighted hash tree.

Shards sit in racks, racks in regions. A key descends from the root: at each level every child draws ``-ln(u) / weight``
with ``u`` hashed from key and child, and the smallest draw wins, so a child wins in proportion to its weight. A draw
depends on nothing but key, child and its weight: when weights change, keys move only into subtrees that grew or out
of subtrees that shrank, and all other choices stay. A shard that opens a new region therefore takes keys into itself
and nothing else moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.llm.common import row_key, uniform
from pairmill.operators.ordering import global_row_number
from pairmill.session import freeze


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 3) -> list[Leaf]:
    """Shards of weight one in full racks and regions, as far as they go."""
    return [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def _children(leaves: Sequence[Leaf], level: str) -> Column:
    """The nodes of a level with their total weights, as a constant array."""
    weights: dict[int, float] = {}
    for leaf in leaves:
        node = getattr(leaf, level)
        weights[node] = weights.get(node, 0.0) + leaf.weight
    return F.array(
        *(F.struct(F.lit(n).alias("id"), F.lit(w).alias("weight")) for n, w in sorted(weights.items()) if w > 0)
    )


def _pick(key: Column, level: str, children: Column) -> Column:
    def draw(child: Column) -> Column:
        u = uniform(key, F.lit(level), child["id"])
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["id"].alias("id"))

    return F.array_min(F.transform(children, draw))["id"]


def _below(leaves: Sequence[Leaf], upper: str, lower: str) -> Column:
    """Node of the upper level -> its children, as a constant map."""
    pairs = []
    for node in sorted({getattr(leaf, upper) for leaf in leaves}):
        pairs += [F.lit(node), _children([leaf for leaf in leaves if getattr(leaf, upper) == node], lower)]
    return F.create_map(*pairs)


def assign_shards(
    df: DataFrame, leaves: Sequence[Leaf], name: str = "shard", id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Add the shard of each row; the id and the tree decide alone.

    Rows without an id go by their text, equal rows go together. Map-only; the other columns stay, one called ``name``
    is replaced.
    """
    key = row_key(id_col, text)
    df = df.withColumn("__pm_region", _pick(key, "region", _children(leaves, "region")))
    df = df.withColumn("__pm_rack", _pick(key, "rack", _below(leaves, "region", "rack")[F.col("__pm_region")]))
    return df.withColumn(name, _pick(key, "shard", _below(leaves, "rack", "shard")[F.col("__pm_rack")])).drop("__pm_region", "__pm_rack")


def with_slots(df: DataFrame, order: Sequence[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in ``order``; equal rows in no certain order.

    Rows are numbered over the whole table in order of (shard, order) by range partitions, and the rows of the shards
    before are taken off. So a shard of any size, or a third of all rows with one id, is numbered by many tasks. Pass
    narrow rows: they are written to the checkpoint folder.
    """
    fixed = freeze(df).withColumn("__pm_tie", F.monotonically_increasing_id())
    numbered = global_row_number(fixed, [shard, *order, "__pm_tie"], "__pm_row")
    # One row per shard.
    counts = fixed.groupBy(shard).agg(F.count("*").alias("__pm_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, F.coalesce(F.sum("__pm_n").over(before), F.lit(0)).alias("__pm_before"))
    slots = numbered.join(F.broadcast(counts), shard)
    return slots.withColumn(name, F.col("__pm_row") - 1 - F.col("__pm_before")).drop("__pm_row", "__pm_before", "__pm_tie")
