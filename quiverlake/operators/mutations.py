"""Views over physical nodes: what is live after upserts and deletes, and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live(nodes: DataFrame) -> DataFrame:
    """Nodes that are neither replaced nor deleted.  nodes: (id, node, deleted, ...).

    The newest node of an id decides; a delete is a row of its own with the newest
    node number given out so far and ``deleted`` set.  The aggregate per id combines before its
    shuffle, so an id that is written very often costs a row for each task.
    """
    newest = nodes.groupBy("id").agg(F.max(F.struct("node", "deleted")).alias("last"))
    newest = newest.where(~F.col("last.deleted")).select(F.col("last.node").alias("node"))
    return nodes.where(~F.col("deleted")).join(newest, "node", "left_semi")


def last_wins(batch: DataFrame, order: str = "ordinal") -> DataFrame:
    """One record for each id of a batch, the last one."""
    last = batch.groupBy("id").agg(F.max(order).alias(order))
    return batch.join(last, ["id", order], "left_semi")


def upserted(current: DataFrame, batch: DataFrame, order: str = "ordinal") -> DataFrame:
    """Live records after a batch: its ids replace those of ``current``."""
    new = last_wins(batch, order)
    return current.join(new.select("id"), "id", "left_anti").unionByName(new.drop(order), allowMissingColumns=True)


def without(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id").distinct(), "id", "left_anti")


def compacted(nodes: DataFrame) -> DataFrame:
    """Live nodes numbered from 0 in physical order."""
    return renumbered(live(nodes))


def renumbered(alive: DataFrame) -> DataFrame:
    """Nodes numbered from 0 in their order.

    Numbers come from counts of each range of nodes and a row number within it,
    so no task holds all rows.
    """
    span = 1 << 16
    ranged = alive.withColumn("_range", F.floor(F.col("node") / span))
    counts = ranged.groupBy("_range").count()
    before = counts.select("_range", (F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("node"))
    numbered = ranged.withColumn("_row", within).join(before, "_range")
    return numbered.withColumn("node", F.coalesce("_before", F.lit(0)) + F.col("_row") - 1).drop("_range", "_row", "_before")
