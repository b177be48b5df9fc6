"""Retrieval: the texts of a search's hits, put together for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contexts(hits: DataFrame, texts: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(query_id, hits, context): the texts of each query's hits (query_id, rank, node), nearest first.

    texts: (node, text).  A hit without a text counts, but adds nothing.  The
    hits are few (k for each query), so Spark can send them to the texts.
    """
    found = hits.select("query_id", "rank", "node").join(texts.select("node", "text"), "node", "left")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    grouped = found.groupBy("query_id").agg(ordered.alias("rows"))
    parts = F.filter(F.transform("rows", lambda r: r["text"]), lambda t: t.isNotNull())
    return grouped.select("query_id", F.size("rows").alias("hits"), F.array_join(parts, separator).alias("context"))
