"""Exact deduplication that no hot text can stall.

Copies are first combined inside each map task, then inside salted groups of their digest, then over the salts. Every one
of these steps groups by the digest and the text itself, so texts of one digest never merge unless they are equal. What
leaves is narrow: a digest, the id that stays, and the size of the group. Rows find their group by digest alone where the
digest has one text, which the groups show, and by digest and text where it has several.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import digest256, text_or_empty
from pairmill.session import freeze

# Reduce tasks over which the copies of one text are spread before they meet.
SALTS = 16
# Groups above this share of all rows are hot. There are fewer than its inverse, so their broadcast is bounded.
HOT_SHARE = 0.001


def copy_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, size) of each distinct text of rows (id, digest, text); ``keep_id`` is the largest id.

    The salt is the number of the map task, so after the combination inside the task a text leaves it once.
    """
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    some = salted.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
    return some.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("size"))


def with_group(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows with the columns of their group; both sides name it in ``__pm_group``, and ``groups`` has ``__pm_size``.

    Groups of more than a share ``HOT_SHARE`` of the ``total`` rows are broadcast, fewer than its inverse. Their rows go
    through the exchange under numbers of their own (``__pm_row``), so no task gathers a hot group.
    """
    values = [c for c in groups.columns if c != "__pm_group"]
    is_hot = F.col("__pm_size") > F.lit(HOT_SHARE * total)
    hot = groups.filter(is_hot).select(F.col("__pm_group").alias("__pm_hot"), F.struct(*values).alias("__pm_hot_values"))
    cold = groups.filter(~is_hot).select(F.col("__pm_group").alias("__pm_cold"), F.struct(*values).alias("__pm_cold_values"))
    met = rows.join(F.broadcast(hot), F.col("__pm_group") == F.col("__pm_hot"), "left")
    found = F.col("__pm_hot").isNotNull()
    own = F.col("__pm_row").cast("string").cast("binary")
    met = met.withColumn("__pm_to", F.when(found, own).otherwise(F.col("__pm_group")))
    met = met.join(cold, (F.col("__pm_to") == F.col("__pm_cold")) & F.col("__pm_hot").isNull(), "left")
    return met.select(
        *(F.col(f"`{c}`") for c in rows.columns),
        *(F.when(found, F.col(f"__pm_hot_values.{c}")).otherwise(F.col(f"__pm_cold_values.{c}")).alias(c) for c in values),
    )


def _judged(
    df: DataFrame, id_col: str, text: str, salts: int, digest: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame, int]:
    """One narrow row per row of ``df`` with its group, written once; the groups in which several rows carry the id that
    stays, with the number of the first such row; the number of rows."""
    whole = text_or_empty(text)
    rows = df.select(F.col(id_col).alias("id"), digest(whole).alias("digest"), whole.alias("text"))
    merged = copy_groups(rows, salts)
    # By digest the texts are no longer needed, so what is read again below is narrow.
    groups = merged.groupBy("digest").agg(
        F.count("*").alias("__pm_texts"), F.max("keep_id").alias("__pm_keep"), F.sum("size").alias("__pm_size")
    )
    groups = freeze(groups.withColumnRenamed("digest", "__pm_group"))
    total = groups.agg(F.sum("__pm_size")).first()[0] or 0
    narrow = rows.select("id", "digest", F.col("digest").alias("__pm_group"), F.monotonically_increasing_id().alias("__pm_row"))
    found = with_group(narrow, groups, total)

    shared = groups.filter("__pm_texts > 1").select(F.col("__pm_group").alias("digest"))
    if not shared.isEmpty():
        # Digests of several texts: there the texts take part in the join, and in the name of the group.
        texts = merged.join(shared, "digest", "left_semi").select(
            F.col("digest").alias("__pm_d"), F.col("text").alias("__pm_t"), F.lit(1).cast("long").alias("__pm_texts"),
            F.col("keep_id").alias("__pm_keep"), F.col("size").alias("__pm_size"),
        )
        doubtful = rows.join(shared, "digest", "left_semi")
        met = doubtful.join(texts, (F.col("digest") == F.col("__pm_d")) & (F.col("text") == F.col("__pm_t")))
        named = met.withColumns(
            {
                "__pm_group": F.concat(F.col("digest"), F.lit(":").cast("binary"), F.col("text").cast("binary")),
                "__pm_row": F.monotonically_increasing_id(),
            }
        )
        found = found.filter("__pm_texts = 1").unionByName(named.select(found.columns))
    found = freeze(found)
    stays = found.filter(F.col("id").eqNullSafe(F.col("__pm_keep")))
    again = stays.groupBy("__pm_group").agg(F.count("*").alias("__pm_size"), F.min("__pm_row").alias("__pm_first"))
    return found, freeze(again.filter("__pm_size > 1")), total


def exact_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = digest256,
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest), one row per row of ``df``.

    Rows of equal text, code point by code point, are a group; a NULL text counts as empty, so NULL and empty texts are one
    group, and texts of any length are compared whole. ``keep_id`` is the largest id of the group, NULL if none of its rows
    has one. Exactly one row of a group is ``kept``: the one with ``keep_id``, and of repeated rows with that id any one.
    Other columns of ``df`` are left out, so no name clashes. An empty table gives an empty one. Runs jobs when called.

    ``digest`` gives the binary value that deals the work; it may be weak, as texts are always compared in full.
    """
    found, again, total = _judged(df, id_col, text, salts, digest)
    kept = F.col("id").eqNullSafe(F.col("__pm_keep"))
    if not again.isEmpty():
        found = with_group(found.withColumnRenamed("__pm_size", "__pm_all"), again, total).withColumn("__pm_size", F.col("__pm_all"))
        kept = kept & (F.col("__pm_first").isNull() | (F.col("__pm_first") == F.col("__pm_row")))
    return found.select(
        "id", F.col("__pm_keep").alias("keep_id"), F.col("__pm_size").alias("group_size"), kept.alias("kept"), "digest"
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each group of :func:`exact_copies`, with all its columns: the one with the largest id, and of repeated rows
    with that id and text any one. NULL and empty texts are one group. Columns of any name pass through, but for names that
    begin with ``__pm_``. An empty table gives an empty one. Runs jobs when called.
    """
    found, again, total = _judged(df, id_col, text, salts, digest256)
    if not found.filter("__pm_group != digest").isEmpty():
        raise ValueError("two texts have one SHA-256 digest")
    groups = found.groupBy("__pm_group").agg(F.max("__pm_keep").alias("__pm_keep"), F.count("*").alias("__pm_size"))
    marked = df.withColumns(
        {"__pm_group": digest256(text_or_empty(text)), "__pm_row": F.monotonically_increasing_id()}
    )
    stays = with_group(marked, groups, total).filter(F.col(id_col).eqNullSafe(F.col("__pm_keep")))
    if not again.isEmpty():
        twice = again.select("__pm_group")
        single = stays.join(twice, "__pm_group", "left_anti")
        stays = single.unionByName(stays.join(twice, "__pm_group", "left_semi").dropDuplicates(["__pm_group"]))
    return stays.select(*(F.col(f"`{c}`") for c in df.columns))
