"""Approximate nearest neighbours by adaptive dimension scan (operator 7).

Vectors are dealt to lists by their nearest centroid and rotated at random;
within a list they lie in column blocks.  A query scans its probed lists block
by block: from the distance over the first ``t`` of ``d`` rotated dimensions a
hypothesis test decides whether the whole distance can still be below the
query's bound, and most candidates go after a block or two.  Survivors get
their exact distance from the original vectors.

Centroids, the number of probed lists and each query's first bound come from a
sample of bounded size; every row is indexed.  A long list is cut into blocks,
and many queries of one list into groups, so no task holds an unbounded group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import pack, unpack
from .store import shuffle_partitions, written

#: Numbers in the sample that the index is fitted on (20,000 rows of 64 dimensions are 1.3 million).
SAMPLE_NUMBERS = 1_300_000
#: Sampled vectors for each list at least, rows of a list's block, queries of a group.
SAMPLED_EACH, BLOCK_ROWS, QUERY_ROWS = 4, 8_192, 1_024
#: Rotated dimensions compared at a time, and the test's strictness (larger: fewer wrong drops).
COLUMNS, EPSILON = 16, 2.1
#: Share of true neighbours, in the sample, that probed lists must hold.
COVERAGE = 0.975


def _valid(batch: pa.RecordBatch, d: int):
    """Rows that take part, and their vectors in double precision."""
    column = batch.column(1)
    if column.null_count == 0 and column.values.null_count == 0:
        n = np.diff(np.asarray(column.offsets))
        if (n == d).all():
            values = np.asarray(column.flatten(), np.float64).reshape(-1, d)
            ok = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
            return np.flatnonzero(ok), values[ok]
    rows, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == d and all(x is not None for x in v):
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                rows.append(i)
                out.append(x)
    return np.array(rows, np.int64), np.array(out).reshape(-1, d)


def _squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)


class Index:
    """What all tasks share: centroids, rotation, probes and the sample; its size is bounded by SAMPLE_NUMBERS."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.d = d = sample.shape[1]
        self.sample = sample.astype(np.float32)
        lists = max(1, min(int(np.sqrt(rows)), len(sample) // SAMPLED_EACH))
        centers = sample[rng.choice(len(sample), lists, replace=False)]
        for _ in range(8):
            own = self._nearest(sample, centers)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, sample)
            count = np.bincount(own, minlength=lists)
            centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
        self.centers = centers
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        own = self._nearest(sample, centers)
        asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
        near = _squared(sample[asked], sample)
        near[np.arange(len(asked)), asked] = np.inf
        found = np.argsort(near, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
        place = np.argsort(np.argsort(_squared(sample[asked], centers), axis=1, kind="stable"), axis=1, kind="stable")
        ranks = np.take_along_axis(place, own[found], axis=1)
        self.probes = min(lists, int(np.quantile(ranks, COVERAGE)) + 1) if len(sample) > k else lists
        self.k = k

    @staticmethod
    def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return np.concatenate([_squared(x[i : i + 4096], centers).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def bound(self, q: np.ndarray) -> np.ndarray:
        """Squared distance within which k rows besides the query's own lie for certain (infinite if the sample is too small)."""
        if len(self.sample) <= self.k:
            return np.full(len(q), np.inf)
        near = _squared(q, self.sample.astype(np.float64))
        # a query in the sample finds itself; and rounding of the sample must not cut a tie
        loose = min(2 * self.k, len(self.sample) - 1)  # the test drops a few wrongly: a bound with k in reserve
        return np.partition(near, loose, axis=1)[:, loose] * (1 + 1e-5) + 1e-12


def _assign(index: Index, salts: int):
    """(vec_id, embedding) -> (list, salt, vec_id, vector)."""

    def run(batches):
        for batch in batches:
            rows, x = _valid(batch, index.d)
            ids = np.asarray(batch.column(0).take(pa.array(rows)), np.int64) if len(rows) else np.zeros(0, np.int64)
            own = index._nearest(x, index.centers)
            salt = (ids * 2654435761 >> 7) % salts
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array(salt, pa.int32()), pa.array(ids, pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], names=["list", "salt", "vec_id", "vector"]
            )

    return run


def _probe(index: Index, exhaustive: bool = False):
    """Queries -> one row for each probed list and batch: the queries, their vectors and bounds."""
    probes = len(index.centers) if exhaustive else index.probes

    def run(batches):
        for batch in batches:
            rows, x = _valid(batch, index.d)
            if not len(rows):
                continue
            ids = np.asarray(batch.column(0).take(pa.array(rows)), np.int64)
            bound = np.full(len(x), np.inf) if exhaustive else index.bound(x)
            to = np.argpartition(_squared(x, index.centers), probes - 1, axis=1)[:, :probes]
            who, where = np.repeat(np.arange(len(x)), to.shape[1]), to.reshape(-1)
            order = np.argsort(where, kind="stable")
            who, where = who[order], where[order]
            cut = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]])
            lists, blobs, number = [], [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                for i in range(a, b, QUERY_ROWS):
                    w = who[i : min(b, i + QUERY_ROWS)]
                    lists.append(int(where[a]))
                    number.append(len(w))
                    blobs.append((pack(ids[w]), x[w].tobytes(), bound[w].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int32()), pa.array(number, pa.int32()), *(pa.array([z[j] for z in blobs], pa.binary()) for j in range(3))], names=["list", "n", "ids", "vectors", "bounds"]
            )

    return run


def scan(q: np.ndarray, qid: np.ndarray, bound: np.ndarray, x: np.ndarray, xid: np.ndarray, rotation: np.ndarray, k: int, epsilon: float = EPSILON, tile: int = 2_000_000):
    """Adaptive scan of one block: (query row, candidate row, exact distance) of each query's best ``k`` in it."""
    d = q.shape[1]
    rq, rx = q @ rotation, x @ rotation
    out_q, out_x, out_s = [], [], []
    step = max(1, tile // max(1, len(x)))
    for lo in range(0, len(q), step):
        hi = min(len(q), lo + step)
        a = rq[lo:hi]
        limit = bound[lo:hi].copy()
        part = _squared(a[:, :COLUMNS], rx[:, :COLUMNS])
        t = min(COLUMNS, d)
        if not np.isfinite(limit).all():
            # no bound yet: the k-th best of a few candidates gives one
            few = rx[: max(4 * k, 64)]
            if len(few) > k:
                first = _squared(a, few)
                first[qid[lo:hi, None] == xid[None, : len(few)]] = np.inf
                limit = np.minimum(limit, np.partition(first, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12)
        with np.errstate(invalid="ignore", over="ignore"):
            test = lambda s, lim, t: s * (d / t) <= lim * (1 + (epsilon / np.sqrt(t) if t < d else 1e-9)) ** 2
            i, j = np.nonzero(test(part, limit[:, None], t) & (qid[lo:hi, None] != xid[None, :]))
            s = part[i, j]
            while t < d and len(i):
                u = min(d, t + COLUMNS)
                gap = a[i, t:u] - rx[j, t:u]
                s = s + np.einsum("ij,ij->i", gap, gap)
                keep = test(s, limit[i], u)
                i, j, s, t = i[keep], j[keep], s[keep], u
        gap = q[lo:hi][i] - x[j]
        exact = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        order = np.lexsort((xid[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        out_q.append(i[best] + lo)
        out_x.append(j[best])
        out_s.append(exact[best])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in (out_q, out_x, out_s))


def _search(index: Index, epsilon: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(-1, index.d)
        xid = np.asarray(rows.column("vec_id").combine_chunks(), np.int64)
        qid = np.concatenate([unpack(b, np.int64) for b in queries.column("ids").to_pylist()])
        q = np.frombuffer(b"".join(queries.column("vectors").to_pylist()), np.float64).reshape(-1, index.d)
        bound = np.frombuffer(b"".join(queries.column("bounds").to_pylist()), np.float64)
        i, j, s = scan(q, qid, bound, x, xid, index.rotation, index.k, epsilon)
        return pa.table({"query_id": qid[i.astype(int)], "vec_id": xid[j.astype(int)], "score": s}, schema=schema)

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` found for every row of ``queries``, by Euclidean distance.

    Vectors that are null, zero, hold null or non-finite numbers or have another
    than the most frequent dimension take no part, on either side.  Rows with
    the query's own id are no candidates, repeated ones included; a query id
    that comes twice is asked once, with the least of its vectors.  Ties go to
    the smaller id.  Rows with a null id take no part.  An empty table on either
    side gives no rows.  Other columns are not read, so their names cannot clash.
    """
    spark = vectors.sparkSession
    narrow = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    base, asked = narrow(vectors), narrow(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = base.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    d, rows = sizes["d"], sizes["count"]
    most = max(64, SAMPLE_NUMBERS // d)
    spot = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30))
    some = base.where(F.size("embedding") == d).where(spot <= int((1 << 30) * min(1.0, most / rows))).select("vec_id", "embedding").limit(2 * most)
    got = some.toArrow()
    parts = [_valid(b, d)[1] for b in got.to_batches()]
    sample = np.concatenate(parts) if parts else np.zeros((0, d))
    if not len(sample):
        return empty
    index = Index(sample, rows, k)
    salts = max(1, -(-rows // BLOCK_ROWS))
    partitions = shuffle_partitions(spark)
    placed = written(base.mapInArrow(_assign(index, salts), "list int, salt int, vec_id long, vector binary"), "placed")
    # the blocks of each list: one for every BLOCK_ROWS rows; a row for each list comes to the driver
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}

    def searched(asked: DataFrame, exhaustive: bool) -> DataFrame:
        probes = written(asked.mapInArrow(_probe(index, exhaustive), "list int, n int, ids binary, vectors binary, bounds binary"), "probes")
        groups = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.sum("n").alias("n")).collect()}
        plan = spark.createDataFrame([(a, -(-counts[a] // BLOCK_ROWS), -(-groups[a] // (8 * QUERY_ROWS))) for a in sorted(counts) if groups.get(a)], "list int, blocks int, shares int")
        plan = F.broadcast(plan)  # a row for each list
        own = placed.join(plan, "list").withColumn("block", F.col("salt") % F.col("blocks")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        put = probes.join(plan, "list").withColumn("share", F.pmod(F.xxhash64("ids"), F.col("shares")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["list", "block", "share"]
        left = own.select(*keys, "vec_id", "vector").repartition(partitions, *keys).groupBy(*keys)
        right = put.select(*keys, "ids", "vectors", "bounds").repartition(partitions, *keys).groupBy(*keys)
        return left.cogroup(right).applyInArrow(_search(index, np.inf if exhaustive else EPSILON), "query_id long, vec_id long, score double")

    found = written(searched(asked, False), "found")
    # a query that the drops left short of k is asked once more, of all lists and with no drops
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(asked.join(full, "vec_id", "left_anti").select("vec_id", "embedding"), "short")
    if short.limit(1).count():
        again = searched(short, True)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
