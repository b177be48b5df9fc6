"""Approximate search: inverted lists as a Parquet table partitioned by list.

Centroids come from a bounded sample; every live vector is dealt to its nearest
one.  A search probes as many of the lists nearest to the query as hold, by
measurement on the sample, nearly all of the ``ef`` nearest vectors; Catalyst
prunes the others' files, and the filter runs before any distance.  ``ef`` is the
planner's, so a narrow filter probes more.  The model (centroids, sizes, reach)
is kept beside the table, so an index is loaded without reading a vector, and new
vectors are dealt to its lists as a part of their own.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources import files
from . import search as exact
from .search import _distances, top_k

#: Numbers in the sample that centroids are fitted on; sampled vectors for each centroid at least; candidates scanned at least for each unit of ef.
SAMPLE_NUMBERS, SAMPLED_EACH, PER_EF = 4_000_000, 4, 8
#: Share of the ef nearest vectors that probed lists must hold; sampled queries it is measured with, and their neighbours.
COVERAGE, ASKED, DEPTH = 0.975, 256, 1_024
#: Numbers of a list that one task writes (about).
FILE_NUMBERS = 16_000_000


@dataclass
class Lists:
    """A built index: where its table is, its centroids, how many vectors each list holds, and how far searches must reach.

    ``reach[j]`` lists hold COVERAGE of the j + 1 nearest vectors in the sample, which is ``share`` of all.
    """

    path: str
    metric: str
    centers: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray
    share: float
    schema: str = ""
    parts: list[int] = field(default_factory=lambda: [0])

    def rows(self, spark) -> DataFrame:
        """All that is in the lists, with ``list``; a filter on that prunes files."""
        return spark.read.schema(f"{self.schema}, part int").option("basePath", self.path).parquet(*[f"{self.path}/part={p}" for p in self.parts])


def _fit(x: np.ndarray, lists: int, metric: str, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(10):
        own = np.concatenate([_distances(x[i : i + 4096], centers, "l2").argmin(1) for i in range(0, len(x), 4096)])
        sums, n = np.zeros_like(centers), np.bincount(own, minlength=lists)
        np.add.at(sums, own, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _order(q: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """The lists, nearest to each query first."""
    return np.argsort(_distances(q, centers, "l2" if metric == "l2" else "dot"), axis=1, kind="stable")


def _reach(x: np.ndarray, centers: np.ndarray, metric: str, seed: int) -> np.ndarray:
    """How many lists hold COVERAGE of the 1, 2, ... nearest others of sampled vectors; a vector that is repeated is asked once."""
    distinct = np.sort(np.unique(x, axis=0, return_index=True)[1])
    asked = np.random.default_rng(seed + 1).permutation(distinct)[:ASKED]
    own = np.concatenate([_distances(x[i : i + 4096], centers, "l2").argmin(1) for i in range(0, len(x), 4096)])
    depth, ranks = min(DEPTH, len(x) - 1), []
    for at in range(0, len(asked), 32):
        some = asked[at : at + 32]
        d = _distances(x[some], x, metric)
        d[np.arange(len(some)), some] = np.inf
        found = np.argsort(d, axis=1, kind="stable")[:, :depth]
        ranks.append(np.take_along_axis(np.argsort(_order(x[some], centers, metric), axis=1), own[found], axis=1))
    held = np.cumsum([np.bincount(r, minlength=len(centers)) for r in np.concatenate(ranks).T], axis=0).reshape(depth, len(centers)).cumsum(axis=1)
    return np.maximum.accumulate((held < COVERAGE * held[:, -1:]).sum(axis=1) + 1)


def _assign(centers: np.ndarray):
    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("vector")
            n = batch.num_rows
            x = np.asarray(batch.column(i).flatten(), np.float64).reshape(n, -1)
            own = _distances(x, centers, "l2").argmin(1) if n else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*batch.schema.names, "list"])

    return run


def _write_part(records: DataFrame, lists: Lists, part: int, expected: np.ndarray) -> Lists:
    """Deals records to their lists, written by as many tasks as a list's expected size asks for, and counts what was written."""
    dim = lists.centers.shape[1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", list int"
    placed = records.mapInArrow(_assign(lists.centers), kinds)
    pieces = F.element_at(F.array(*[F.lit(int(p)) for p in np.maximum(1, -(-expected * dim // FILE_NUMBERS))]), F.col("list") + 1)
    placed.repartition("list", F.pmod(F.xxhash64("node"), pieces)).write.partitionBy("list").parquet(f"{lists.path}/part={part}")
    sizes = lists.sizes.copy()
    for r in replace(lists, schema=kinds, parts=[part]).rows(records.sparkSession).groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] += r["count"]
    return replace(lists, sizes=sizes, schema=kinds)


def build(records: DataFrame, path: str, metric: str, rows: int, dim: int, seed: int = 11) -> Lists:
    """Writes the lists of ``records`` (node, id, vector, metadata_json, meta) below ``path``.

    There are as many as the root of ``rows``, or a SAMPLED_EACH'th of the sample where that is fewer.
    """
    share = min(1.0, SAMPLE_NUMBERS / max(1, rows * dim))
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    drawn = records.where(spot).select("vector").limit(2 * SAMPLE_NUMBERS // max(1, dim)).toArrow().column("vector").combine_chunks()
    sample = np.asarray(drawn.flatten(), np.float64).reshape(len(drawn), -1) if len(drawn) else np.zeros((0, dim))
    lists = max(1, min(int(np.sqrt(rows)), len(sample) // SAMPLED_EACH))
    centers = _fit(sample, lists, metric, seed) if len(sample) else np.zeros((1, dim))
    reach = _reach(sample, centers, metric, seed) if len(sample) else np.zeros(0, int)
    own = np.concatenate([_distances(sample[i : i + 4096], centers, "l2").argmin(1) for i in range(0, len(sample), 4096)]) if len(sample) else np.zeros(0, int)
    expected = np.bincount(own, minlength=len(centers)) * rows // max(1, len(sample))
    made = Lists(path, metric, centers, np.zeros(len(centers), np.int64), reach, min(1.0, len(sample) / max(1, rows)))
    return _write_part(records, made, 0, expected)


def extend(index: Lists, records: DataFrame, part: int) -> Lists:
    """The index with more records, dealt to the lists that there are."""
    grown = _write_part(records, index, part, index.sizes)
    grown = replace(grown, parts=[*index.parts, part], share=index.share * index.sizes.sum() / max(1, grown.sizes.sum()))
    save(records.sparkSession, grown)
    return grown


def save(spark, index: Lists) -> None:
    """Writes the model of the index's last part."""
    out = io.BytesIO()
    np.savez(out, centers=index.centers, sizes=index.sizes, reach=index.reach, share=index.share, metric=index.metric, schema=index.schema)
    files.write(spark, f"{index.path}/_model-{index.parts[-1]}.npz", out.getvalue())


def load(spark, path: str, parts: list[int]) -> Lists:
    """An index as it was when its last part of ``parts`` was written."""
    got = np.load(io.BytesIO(files.read(spark, f"{path}/_model-{parts[-1]}.npz")))
    return Lists(path, str(got["metric"]), got["centers"], got["sizes"], got["reach"], float(got["share"]), str(got["schema"]), list(parts))


def probed(index: Lists, query: np.ndarray, ef: int) -> list[int]:
    """The lists nearest to the query that hold COVERAGE of its ef nearest vectors, and PER_EF * ef vectors together.

    All lists where the ef nearest are more than were measured.
    """
    near = _order(query[None, :], index.centers, index.metric)[0]
    enough = np.searchsorted(np.cumsum(index.sizes[near]), PER_EF * ef) + 1
    depth = len(index.reach)
    # the sample's ef nearest lie farther out than the collection's
    reach = index.reach[min(ef, depth) - 1] if depth and ef * index.share <= depth else len(near)
    return [int(x) for x in near[: max(enough, reach)]]


def search(index: Lists, spark, query, k: int, ef: int, where: Column | None = None, alive=None) -> DataFrame:
    """``alive``: takes dead nodes from a frame."""
    lists = probed(index, np.asarray(query, np.float64), ef)
    rows = index.rows(spark).where(F.col("list").isin(lists))
    return top_k(rows if alive is None else alive(rows), query, k, index.metric, where)


def within_reach(index: Lists, spark, query, k: int, ef: int, hits: DataFrame) -> bool:
    """Whether ``hits`` of a filtered search are k and lie among the ef nearest vectors of the probed lists, which other lists hold hardly any of; True if all lists were probed."""
    lists = probed(index, np.asarray(query, np.float64), ef)
    if len(lists) == len(index.centers):
        return True
    n, last = hits.agg(F.count("*"), F.max("distance")).first()
    if n < k:
        return False
    rows = index.rows(spark).where(F.col("list").isin(lists))
    return rows.where(V.distance(index.metric, F.col("vector"), V.literal(query)) < last).limit(ef + 1).count() <= ef


def _probes(index: Lists, ef: int):
    """Queries (node, vector) -> a row for each of their lists."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            lists = [probed(index, q, ef) for q in x]
            at = np.repeat(np.arange(batch.num_rows), [len(p) for p in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) if lists else [], pa.int32()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["list", "node", "vector"])

    return run


def search_many(index: Lists, queries: DataFrame, k: int, ef: int, alive=None, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, node, distance): for every query (node, vector) the k nearest in its probed lists.

    Each list is a lane of the batch search, or several if it is long; a query
    goes to the lanes of its own lists only.
    """
    spark, dim = queries.sparkSession, index.centers.shape[1]
    pieces = np.maximum(1, -(-index.sizes * dim // exact.LANE_NUMBERS))
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    plan = F.broadcast(spark.createDataFrame([(i, int(p), int(f)) for i, (p, f) in enumerate(zip(pieces, first, strict=True))], "list int, pieces int, first int"))  # a row for each list
    asked = queries.select(F.col("node").cast("long").alias("node"), F.col("vector").cast("array<float>").alias("vector"))
    asked = asked.mapInArrow(_probes(index, ef), "list int, node long, vector array<float>").join(plan, "list")
    asked = asked.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("pieces") - 1)).alias("lane"), F.lit(True).alias("asks"), "node", "vector")
    rows = index.rows(spark)
    own = (rows if alive is None else alive(rows)).join(plan, "list")
    own = own.select((F.col("first") + F.pmod(F.xxhash64("node"), F.col("pieces"))).cast("int").alias("lane"), F.lit(False).alias("asks"), "node", "vector")
    lanes, partitions = int(pieces.sum()), int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    met = own.unionByName(asked).repartitionById(min(lanes, partitions), "lane").sortWithinPartitions("lane", "asks")
    return exact.merged(met.mapInArrow(exact._lanes(k, index.metric, skip_self, None), "query_id long, node long, distance double"), k)
