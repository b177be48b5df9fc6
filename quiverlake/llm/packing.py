"""Best-fit packing planned on a histogram of lengths (operator 8).

Documents are tokenised and cut, then only their lengths are counted: at most
``capacity`` numbers, whatever the corpus.  Best-fit decreasing runs over these
counts, many equal bins at a time, and yields slots in order for each length.
Each piece then takes the slot of its rank among the pieces of its length.
Ranks come from counts of (length, salt) groups and a row number within each
group, so that a length that a third of all pieces share is ranked by many
tasks.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import pack, unpack
from .store import shuffle_partitions, spread, text_batches, written
from .tokens import BYTE_BPE, encoder

CAPACITY = 2048
#: Id that ends every document.
END = 0
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("salt", pa.int32())])


def _pieces(capacity: int, name: str, path: str | None, with_ids: bool, salts: int):
    """Rows -> their pieces, dealt to salts in turn, so that no number of equal rows fills one."""

    def run(batches):
        encode, turn = encoder(name, path), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[list] = [[] for _ in _PIECES]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                start, piece = 0, 0
                step = len(ids) % capacity or min(len(ids), capacity)
                while start < len(ids):
                    part = ids[start : start + step].tobytes()
                    for col, x in zip(rows, (doc, piece, start, step, zlib.crc32(part), part if with_ids else None, turn % salts), strict=True):
                        col.append(x)
                    start, piece, step, turn = start + step, piece + 1, capacity, turn + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PIECES, strict=True)], schema=_PIECES)

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over {length: count} -> slot runs, rows of
    (length, first rank, slots in a bin, bins, first bin, offset) in order of length and rank.

    Equal pieces put one after another fill the tightest bin until none fits,
    then the next tightest; so whole groups of equal bins are filled at once.
    """
    groups: dict[int, list[list]] = {}  # room left -> [bins, content]; content: a linked list of (length, slots, offset)
    rooms: list[int] = []
    done: list[tuple[int, tuple]] = []

    def put(room: int, bins: int, content) -> None:
        if bins and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append([bins, content])
        elif bins:
            done.append((bins, content))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                bins, content = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, content = capacity, None
                bins = -(-left // (capacity // length))
            fit = room // length
            full = min(bins, left // fit)
            put(room - fit * length, full, (content, length, fit, capacity - room))
            left -= full * fit
            if full < bins:
                put(room - left * length, int(left > 0), (content, length, left, capacity - room))
                put(room, bins - full - int(left > 0), content)
                left = 0
    for room in rooms:
        done += [(bins, content) for bins, content in groups[room]]
    runs, first = [], 0
    for bins, content in done:
        while content is not None:
            content, length, slots, offset = content
            runs.append((length, slots, bins, first, offset))
        first += bins
    runs.sort()
    out, at, now = [], 0, None
    for length, slots, bins, base, offset in runs:
        at = at if length == now else 0
        now = length
        out.append((length, at, slots, bins, base, offset))
        at += slots * bins
    return np.array(out, np.int64).reshape(-1, 6)


def _take_slots(blob: bytes):
    def run(batches):
        runs = unpack(blob, np.int64).reshape(-1, 6)
        key = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in ("length", "rank"))
            r = runs[np.searchsorted(key, (length << 48) + rank, "right") - 1] if len(length) else runs[:0]
            inside = rank - r[:, 1]
            cols = [batch.column(k) for k in range(batch.num_columns) if batch.schema.field(k).name != "rank"]
            names = [f.name for f in batch.schema if f.name != "rank"]
            cols += [pa.array(r[:, 4] + inside // np.maximum(r[:, 2], 1)), pa.array(r[:, 5] + inside % np.maximum(r[:, 2], 1) * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row for each piece.

    Null or empty text: one piece of the end id alone.  Rows are packed as they
    come, repeated ones and null ids too; rows equal in all of this are
    interchangeable.  Whole texts are encoded, however long.  An empty table gives
    no rows.  Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    text_batches(spark)
    salts = shuffle_partitions(spark)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, salt int"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = spread(rows, "doc_id", "text").mapInArrow(_pieces(capacity, tokenizer, path, with_ids, salts), kinds)
    salted = written(cut if with_ids else cut.drop("ids"), "pieces")
    cut = salted.drop("salt")
    groups = written(salted.groupBy("length", "salt").count(), "lengths", max(6, salts // 8))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(within)).join(offsets, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("row") - 1).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(_take_slots(pack(plan(histogram, capacity).reshape(-1))), f"{schema}, sequence_id long, offset long")
