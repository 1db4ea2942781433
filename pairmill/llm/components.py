"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.session import freeze

# Far above what the alternation needs: its rounds grow with the square of the logarithm of the nodes.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a > b).

    Large: every node links its larger neighbours to the smallest node it knows. Small: every node links itself and its
    smaller neighbours to the smallest of them.
    """
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = near.join(least, "u")
    if large:
        linked = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = met.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        linked = linked.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b of any one ordered type): the smallest node reachable.

    Edges from a node to itself and such with NULL are left out; repeated ones and their direction do not matter. Each
    round is written to the checkpoint folder. Runs jobs when called.
    """
    plain = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    plain, before = freeze(plain), None
    for _ in range(MOST_ROUNDS):
        plain = freeze(_star(_star(plain, large=True), large=False))
        # Done when every node has one edge, and that to a node that has none: the table no longer changes.
        state = plain.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return plain.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        plain.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
