"""Top-k search.

One query: a distance expression and ``TakeOrderedAndProject``, which keeps k
rows for each task.  Many queries: an Arrow kernel multiplies lanes of vectors
by blocks of queries and keeps each lane's best k of each query, so only
``lanes * queries * k`` rows are merged.  Exact results come from the double
precision expression; the kernel re-scores what it keeps the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..errors import InvalidArgument
from ..functions import vectors as V

#: Queries of a block, candidates that they are multiplied by at a time, and numbers of pairs that are scored again together.
QUERY_BLOCK, TILE, PAIR_NUMBERS = 512, 8_192, 4_000_000
#: Numbers that a lane of candidates has at most (about), and rows that are worth a lane of their own.
LANE_NUMBERS, LANE_ROWS = 8_000_000, 500


def check_k(k: int, most: int | None = None) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1 or (most is not None and k > most):
        raise InvalidArgument("k must be greater than zero" + (f" and at most {most}" if most else ""))


def top_k(records: DataFrame, query, k: int, metric: str, where: Column | None = None, vector: str = "vector", by: str = "node") -> DataFrame:
    """The k nearest live records, nearest first, ties to the earlier node, with all their columns plus distance.

    ``query``: numbers, or a Column.  The filter is applied before any distance;
    only k rows leave the scan, and wide columns are fetched for them alone when
    the caller joins them on.
    """
    check_k(k)
    q = query if isinstance(query, Column) else V.literal(query)
    df = records if where is None else records.where(where)
    return df.withColumn("distance", V.distance(metric, F.col(vector), q)).orderBy("distance", by).limit(k)


def portable(hits: DataFrame) -> DataFrame:
    """The same hits in an order that doesn't depend on insertion: by distance, then id."""
    return hits.orderBy("distance", "id")


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * (q @ x.T)
    return np.maximum(0.0, 1.0 - q @ x.T) if metric == "cosine" else -(q @ x.T)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, summed in order: equal to the expression's fold."""
    if metric == "l2":
        return np.cumsum((q - x) ** 2, axis=1)[:, -1]
    fold = np.cumsum(q * x, axis=1)[:, -1]
    return np.maximum(0.0, 1.0 - fold) if metric == "cosine" else -fold


def _nearest(qid: np.ndarray, q: np.ndarray, node: np.ndarray, x: np.ndarray, k: int, metric: str, skip_self: bool) -> pa.RecordBatch:
    """The k best of the candidates for each query, tile by tile; ties to the smaller node.

    All that the product puts no farther out than its k-th, give or take its
    rounding, are scored again one by one, however many are equally far.
    """
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    squares = lambda v: (v * v).sum(1)
    for at in range(0, len(x), TILE):
        n, y = node[at : at + TILE], x[at : at + TILE]
        d = _distances(q, y, metric)
        if skip_self:
            d[qid[:, None] == n[None, :]] = np.inf
        keep = min(len(n), k)
        slack = 8 * y.shape[1] * np.finfo(float).eps * (1 + squares(q) + squares(y).max())
        near = np.isfinite(d) & (d <= (np.partition(d, keep - 1, axis=1)[:, keep - 1] + slack)[:, None])
        held = np.cumsum(near.sum(1) * y.shape[1]) // PAIR_NUMBERS
        for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(held)) + 1):
            i, j = np.nonzero(near[part])
            i = part[i]
            i, m, s = (np.concatenate(c) for c in zip(best, (i, n[j], _exact(q[i], y[j], metric)), strict=True))
            order = np.lexsort((m, s, i))
            i, m, s = i[order], m[order], s[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            best = [i[first], m[first], s[first]]
    return pa.RecordBatch.from_arrays([pa.array(qid[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "node", "distance"])


def _query_blocks(single: bool):
    """Queries -> blocks of them, packed."""
    kind = np.float32 if single else np.float64

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                ids, x = np.asarray(part.column(0), np.int64).tobytes(), np.asarray(part.column(1).flatten(), kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([x], pa.binary())], names=["ids", "packed"])

    return run


def _lanes(k: int, metric: str, skip_self: bool, single: bool | None):
    """A lane's candidates, then the queries that ask it -> their best k in the lane.  Queries come in packed blocks, or (``single`` None) as rows like the candidates."""
    kind = np.float32 if single else np.float64

    def run(batches):
        now, nodes, rows = None, [], []
        for batch in batches:
            lane, asks = np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((lane[1:] != lane[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(lane)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if lane[a] != now:
                    now, nodes, rows = lane[a], [], []
                if not asks[a]:
                    nodes.append(np.asarray(part.column(2), np.int64))
                    rows.append(np.asarray(part.column(3).flatten(), np.float64).reshape(b - a, -1))
                    continue
                if not nodes:
                    continue
                nodes, rows = [np.concatenate(nodes)], [np.concatenate(rows)]
                if single is None:
                    qid, q = np.asarray(part.column(2), np.int64), np.asarray(part.column(3).flatten(), np.float64).reshape(b - a, -1)
                    for i in range(0, len(qid), QUERY_BLOCK):
                        yield _nearest(qid[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK], nodes[0], rows[0], k, metric, skip_self)
                    continue
                for ids, packed in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    qid = np.frombuffer(ids, np.int64)
                    yield _nearest(qid, np.frombuffer(packed, kind).astype(np.float64).reshape(len(qid), -1), nodes[0], rows[0], k, metric, skip_self)

    return run


def knn(records: DataFrame, queries: DataFrame, k: int, metric: str, skip_self: bool = False, vector: str = "vector") -> DataFrame:
    """(query_id, rank, node, distance): the k nearest records of every query (node, vector); exact.

    The records are dealt to lanes of at most about LANE_NUMBERS numbers, every
    block of queries asks every lane, and the lanes' best k are merged; neither
    side passes through the driver.
    """
    check_k(k)
    metric = V.metric(metric)
    spark = records.sparkSession
    base = records.select(F.col("node").cast("long").alias("node"), F.col(vector).alias("vector"))
    single = queries.schema[vector].dataType.elementType == FloatType()
    n, dim = base.agg(F.count("*"), F.max(F.size("vector"))).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    lanes = max(1, -(-n * (dim or 0) // LANE_NUMBERS), min(partitions, n // LANE_ROWS))
    own = base.select(F.pmod(F.xxhash64("node"), F.lit(lanes)).cast("int").alias("lane"), F.lit(False).alias("asks"), "node", "vector", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("packed"))
    asked = queries.select(F.col("node").cast("long").alias("node"), F.col(vector)).mapInArrow(_query_blocks(single), "ids binary, packed binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(True).alias("asks"), F.lit(None).cast("long").alias("node"), F.lit(None).cast(base.schema["vector"].dataType).alias("vector"), "ids", "packed")
    met = own.unionByName(asked).repartitionById(min(lanes, partitions), "lane").sortWithinPartitions("lane", "asks")
    found = met.mapInArrow(_lanes(k, metric, skip_self, single), "query_id long, node long, distance double")
    return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query's rows (query_id, node, distance), with their rank."""
    best = Window.partitionBy("query_id").orderBy("distance", "node")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "node", "distance")
