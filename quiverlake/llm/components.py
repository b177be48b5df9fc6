"""Connected components of a link table, distributed.

Each round joins every node's neighbours to the smallest of them ("large star",
then "small star"), which keeps components and shortens paths; it ends when no
link changes.  Minima are map-side aggregates, and a hub's links meet only in
joins, whose skewed partitions Spark splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import shuffle_partitions, written


def _forest(batches):
    """A spanning forest of a task's links: what it leaves out follows from what it keeps."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        keep_u, keep_v = [], []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep_u.append(max(a, b))
                keep_v.append(min(a, b))
        yield pa.RecordBatch.from_arrays([pa.array(keep_u, pa.int64()), pa.array(keep_v, pa.int64())], schema=schema)
        if len(parent) > 2_000_000:  # bounded memory: later links start a new forest
            parent.clear()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is its smallest node.  No links: no rows."""
    files = max(6, shuffle_partitions(links.sparkSession) // 8)
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = written(edges.mapInArrow(_forest, "u long, v long").where("u <> v").distinct(), "links", files)
    for _ in range(60):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = written(small, "links", files)
        mark = [F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))]
        if edges.agg(*mark).first() == now.agg(*mark).first():
            break
        edges = now
    else:
        raise RuntimeError("components did not settle in 60 rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
