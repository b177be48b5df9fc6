"""Access-path choice: the same arithmetic for every query, and its inputs explained."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument

SAMPLE = 512
#: The number of values up to which Spark pushes a list down to Parquet as it is.
PUSHED = "spark.sql.parquet.pushdown.inFilterThreshold"
#: What samples of nodes are drawn with, unless another seed is given.
SEED = 20_240_229
_MASK = 2**64 - 1


class SplitMix64:
    """A tiny deterministic generator; samples are reproducible everywhere."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        return z ^ (z >> 31)

    def below(self, n: int) -> int:
        return self.next() % n

    def unit(self) -> float:
        return ((self.next() >> 11) + 1.0) / (1 << 53)


@dataclass(frozen=True)
class Plan:
    strategy: str
    ef: int | None
    adaptive_ef: int
    scan_cost: float | None
    graph_cost: float
    selectivity: float | None


def choose(nodes: int, live: int, dim: int, k: int, selectivity: float | None = None, ef: int | None = None, ef_search: int = 64, m: int = 16, exact: bool = False) -> Plan:
    """exact if asked for; a filtered scan where it costs no more than the index; else the index with a budget that grows as the filter narrows."""
    if k < 1:
        raise InvalidArgument("k must be greater than zero")
    if ef is not None and ef < 1:
        raise InvalidArgument("ef must be greater than zero")
    base = max(ef if ef is not None else ef_search, k)
    adaptive, scan = base, None
    if selectivity is not None:
        adaptive = max(min(math.ceil(base / max(selectivity, 1.0 / max(live, 1))), live), k)
        scan = nodes / max(dim, 1) + live * selectivity
    graph = adaptive * m * 0.5
    strategy = "exact" if exact else "filtered_exact" if scan is not None and scan <= graph else "index"
    return Plan(strategy, adaptive if strategy == "index" else None, adaptive, scan, graph, selectivity)


def sampled_nodes(nodes: int, seed: int = SEED) -> list[int] | None:
    """Positions that the selectivity is estimated from, with repeats; None for all of a small collection."""
    if nodes <= SAMPLE:
        return None
    rng = SplitMix64(seed)
    return [rng.below(nodes) for _ in range(SAMPLE)]


def selectivity(records: DataFrame, matches, nodes: int, seed: int = SEED, whole: bool = False) -> float:
    """Share of live records that match; 1.0 where none is live.  records: (node, deleted, ...).

    ``whole`` counts every record.  Else it is an estimate from the sampled nodes,
    which a search makes before it chooses its path: a count would read the metadata
    of every record, as the filtered scan does.  They are pushed down to Parquet as
    a list, so that of a table in order of nodes only the pages that hold them are read.
    """
    drawn = None if whole else sampled_nodes(nodes, seed)
    df, conf = records.where(~F.col("deleted")), records.sparkSession.conf
    before = conf.get(PUSHED)
    if drawn is not None:
        # SAMPLE rows at most
        some = records.sparkSession.createDataFrame([(n,) for n in drawn], "node long")
        df = df.where(F.col("node").isin(sorted(set(drawn)))).join(F.broadcast(some), "node")
    conf.set(PUSHED, str(max(SAMPLE, int(before))))
    try:
        row = df.agg(F.count("*").alias("n"), F.count_if(matches).alias("m")).first()
    finally:
        conf.set(PUSHED, before)
    return row["m"] / row["n"] if row["n"] else 1.0
