"""Mixing sources to target weights (operator 1), in DataFrame functions only.

Tokens are summed per source, targets are set against these sums, and a
document of a source with repetition rate ``r`` is emitted ``floor(r)`` times
plus once more with probability ``r - floor(r)``, drawn from a hash of its id.
The only shuffle is the aggregate per source; the table of sources joins by
broadcast while Spark finds it small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import named, numbered, place, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: What all targets add up to, and what one target may reach, as multiples of the sizes.
TOTAL, MOST = 1.5, 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, source: str = "source", weights: tuple = WEIGHTS) -> DataFrame:
    """``sources`` with a column weight: ``weights`` in turn, by code point of the source, null last."""
    turn = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights)
    out = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:], 1):
        out = F.when(turn == i, F.lit(float(w))).otherwise(out)
    return sources.withColumn("weight", out)


def targets(sources: DataFrame, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(..., source_size, weight) -> plus target: shares of ``total`` times all sizes by weight, none above ``most`` times its size.

    Sharing the excess again by weight until none is above leaves one level
    ``x`` with target = min(cap, x * weight).  Sources reach their caps in order
    of cap / weight, so with running sums the level is the first that doesn't
    lift the next source over its cap.  If all are capped the total isn't met.
    """
    cap = F.col("source_size") * F.lit(most)
    ratio = F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf")))
    whole = Window.partitionBy().orderBy("ratio", F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    df = sources.withColumn("ratio", ratio)
    left = F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum(cap).over(whole), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(whole), F.lit(0.0))
    df = df.withColumn("level", F.when(open_weight > 0, left / open_weight))
    # before its own place, a source's level exceeds its ratio exactly if it is capped
    df = df.withColumn("reached", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    first = F.first("reached", ignorenulls=True).over(Window.orderBy("ratio", F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("x", first)
    reached = F.when(F.col("x").isNull(), cap).otherwise(F.least(cap, F.col("x") * F.col("weight")))
    return df.withColumn("target", reached).drop("ratio", "level", "reached", "x")


def draw(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the key only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """With numbered columns: plus size, source_size, target and copies."""
    base = numbered(docs)
    doc_id, text, source = (place(docs, c) for c in (doc_id, text, source))
    sums = base.select(F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    small = written(targets(cycled_weights(sums, weights=weights), total, most).select(F.col("source").alias("key"), "source_size", "target"), "sources", 1)
    both = base.withColumn("size", n_words(F.col(text))).join(small, F.col(source).cast("string").eqNullSafe(F.col("key")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    once = (draw(F.col(doc_id)) < rate - F.floor(rate)).cast("long")
    return both.withColumn("copies", F.floor(rate) + once)


def rates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` plus size, source_size, target and copies, how often the mix takes each row.

    Null text: size 0.  A null source is a source of its own, after all others.
    A source of size 0 has target 0 and its rows are taken no time.  Rows with
    equal ids draw alike.  An added name that ``docs`` has already gets an
    underscore at its end.  An empty table gives no rows.
    """
    return named(_taken(docs, **options), docs, ["size", "source_size", "target", "copies"])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    taken = _taken(docs, **options).where("copies > 0")
    return named(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs, [])
