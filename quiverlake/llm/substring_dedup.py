"""Substring dedup by sliding sentence spans (operator 4).

From every sentence forwards, and to every sentence backwards, the shortest run
of consecutive sentences that is long enough is hashed.  Runs join globally by
hash; every occurrence but the first removes the sentences it covers.

Sentences are short: besides lines and end marks, a word ends one whose key is
the least within REACH words on either side.  Such ends depend on the words next
to them only, so a passage that several documents hold is cut alike in all of
them, whatever sentence it starts or stops in the middle of; only the few words
up to the first and from the last of its own ends are beyond comparison.

Only what can matter travels: a block of documents settles its own repeats and
sends each run's first occurrence within the block to the run's hash range, so
a run that a third of all documents hold costs one entry for each block.  The
range answers each block with the runs that it loses, and the block adds them up
to one row for each of its documents that loses anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, buffers, chunks, mix, pack, pack_sorted, range_sums, unpack, unpack_sorted
from .ngram_jaccard import _header, _parts
from .store import BROADCAST_ROWS, named, numbered, place, shuffle_partitions, spread, text_batches, written

#: A run is long enough with this many sentences and words together, or with MANY_WORDS words.
SENTENCES, WORDS, MANY_WORDS = 3, 40, 50
#: Words on either side that an inner end's key is compared with.
REACH = 2
#: Runs of a block.
BLOCK_RUNS = 400_000
#: Ranges that may be broadcast, besides the limit of their rows.
BROADCAST_BYTES = 8 << 20
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
_REMOVED = pa.schema([("rid", pa.int64()), ("tid", pa.int32()), ("payload", pa.binary())])


def _inner_ends(words: Words) -> np.ndarray:
    """Which words have the least key (ties included) among those of their text within REACH."""
    key, row = words.keys(), words.row
    least = key.copy()
    for d in range(1, REACH + 1):
        same = row[d:] == row[:-d]
        least[d:] = np.where(same, np.minimum(least[d:], key[:-d]), least[d:])
        least[:-d] = np.where(same, np.minimum(least[:-d], key[d:]), least[:-d])
    return key == least


class Sentences:
    """Sentences of a chunk, of a word at least each: a line or text ends one, so do . ! ? before white space, and inner ends."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        words = Words(raw, at)
        n = len(words.start)
        self.texts = len(at) - 1
        last = np.zeros(n, bool)
        if n:
            row_end = words.row_at[1:][words.counts > 0] - 1
            last[row_end] = True
            last |= _STOP[raw[words.end - 1]]
            feeds = np.concatenate([[0], np.cumsum(raw == 10)])
            last[:-1] |= feeds[words.start[1:]] > feeds[words.end[:-1]]
            last |= _inner_ends(words)
        end = np.flatnonzero(last) + 1
        begin = np.concatenate([[0], end[:-1]]) if len(end) else end
        self.words = end - begin
        self.row = words.row[begin] if n else np.zeros(0, np.int64)
        self.row_at = np.searchsorted(self.row, np.arange(self.texts + 1))
        h = words.hashes(lower=True)
        # a sentence's hash depends on its words in order, not on white space
        place = np.arange(n) - np.repeat(begin, self.words)
        part = mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        self.hash = mix(sums[end] - sums[begin] + self.words.astype(np.uint64))
        self.byte_from = words.start[begin] if n else begin
        self.byte_to = words.end[end - 1] if n else end

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, hash) of the runs, as sentences of the chunk."""
        n = len(self.words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.concatenate([[0], np.cumsum(self.words)])
        i = np.arange(n)
        enough = np.maximum(i + SENTENCES, np.searchsorted(total, total[:-1] + WORDS))
        forward = np.minimum(enough, np.searchsorted(total, total[:-1] + MANY_WORDS))
        forward = np.where(forward <= self.row_at[1:][self.row], forward, 0)
        enough = np.minimum(i + 1 - SENTENCES, np.searchsorted(total, total[1:] - WORDS, "right") - 1)
        backward = np.maximum(enough, np.searchsorted(total, total[1:] - MANY_WORDS, "right") - 1)
        # a run that is found both ways counts once
        back = np.flatnonzero((backward >= self.row_at[:-1][self.row]) & (forward[backward] != i + 1))
        ahead = np.flatnonzero(forward)
        first, end = np.concatenate([ahead, backward[back]]), np.concatenate([forward[ahead], back + 1])
        return first, end, mix(range_sums(self.hash, first, end) + (end - first).astype(np.uint64))


def _removal(rid: np.ndarray, tid: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row for each document: the sentence ranges to remove."""
    order = np.lexsort((first, tid, rid))
    rid, tid, first, end = (x[order] for x in (rid, tid, first, end))
    cut = np.concatenate([[0], np.flatnonzero((rid[1:] != rid[:-1]) | (tid[1:] != tid[:-1])) + 1, [len(rid)]]) if len(rid) else np.zeros(1, np.int64)
    ranges = np.stack([first, end], axis=1).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(rid[cut[:-1]], pa.int64()), pa.array(tid[cut[:-1]], pa.int32()), pa.array([_fewest(ranges[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
        schema=_REMOVED,
    )


def _losers(h, rid, tid, first):
    """Rows in order of (hash, document, place); which open a hash; which come later than its first occurrence.

    The rows of one document that is there twice occur at the same place, so none of them is later.
    """
    order = np.argsort(h, kind="stable")
    opens = np.ones(len(order), bool)
    opens[1:] = h[order][1:] != h[order][:-1]
    several = ~opens
    several[:-1] |= several[1:]
    some = order[several]
    order[several] = some[np.lexsort((first[some], tid[some], rid[some], h[some]))]
    top = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]] if len(order) else order
    later = (rid[order] != rid[top]) | (tid[order] != tid[top]) | (first[order] != first[top])
    return order, opens, later


def _lost(rid, tid, first, end) -> bytes:
    return _header(pack(rid), pack(tid), pack(first.astype(np.int32)), pack((end - first).astype(np.int32)))


def _span_blocks(buckets: int):
    """(rid, tid, text) -> messages with the block's first occurrences, and under bucket -1 what the block removes itself."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []

        def flush():
            nonlocal number
            h, rid, tid, first, end = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order, opens, later = _losers(h, rid, tid, first)
            lost, top = order[later], order[opens]
            rows = [(number, -1, _lost(rid[lost], tid[lost], first[lost], end[lost]))] if len(lost) else []
            h, rid, tid, first, end = (x[top] for x in (h, rid, tid, first, end))
            edges = ((np.arange(1, buckets, dtype=np.float64) / buckets) * 2.0**64).astype(np.uint64)
            cut = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
            for b in range(buckets):
                s = slice(cut[b], cut[b + 1])
                if cut[b + 1] > cut[b]:
                    rows.append((number, b, _header(pack_sorted(h[s])) + _lost(rid[s], tid[s], first[s], end[s])))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MESSAGE)], schema=_MESSAGE)

        for batch in batches:
            rids, tids = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int32)
            raw, at = buffers(batch.column(2))
            for i, part, own in chunks(raw, at):
                s = Sentences(part, own)
                first, end, h = s.runs()
                row = s.row[first] if len(first) else first
                kept.append((h, rids[i + row], tids[i + row], first - s.row_at[row], end - s.row_at[row]))
                if sum(len(x[0]) for x in kept) >= BLOCK_RUNS:
                    yield flush()
        if kept:
            yield flush()

    return run


def _span_winners(batches):
    """Messages in order of bucket -> to each block the runs that it loses."""
    now, rows = None, []

    def settle():
        parts = [_parts(blob) for _, blob in rows]
        h = [unpack_sorted(p[0], np.uint64) for p in parts]
        rid, tid, first, length = ([unpack(p[k], kind) for p in parts] for k, kind in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32)))
        of = np.repeat(np.arange(len(rows)), [len(x) for x in h])
        rid, tid, first, length = (np.concatenate(x) for x in (rid, tid, first, length))
        order, _, later = _losers(np.concatenate(h), rid, tid, first)
        lost = order[later]
        lost = lost[np.argsort(of[lost], kind="stable")]
        cut = np.searchsorted(of[lost], np.arange(len(rows) + 1))
        out = [(rows[k][0], _lost(*(x[lost[i:j]] for x in (rid, tid, first)), (first + length)[lost[i:j]])) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["block", "payload"])

    for batch in batches:
        for block, bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket == -1:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload.as_py()], pa.binary())], names=["block", "payload"])
                continue
            if bucket != now and rows:
                yield settle()
                rows = []
            now = bucket
            rows.append((block, payload.as_py()))
    if rows:
        yield settle()


def _added_up(table: pa.Table) -> pa.Table:
    """All answers to a block -> its documents that lose anything."""
    parts = [_parts(x.as_py()) for x in table.column("payload")]
    rid, tid, first, length = (np.concatenate([unpack(p[k], kind) for p in parts]) for k, kind in ((0, np.int64), (1, np.int32), (2, np.int32), (3, np.int32)))
    return pa.Table.from_batches([_removal(rid, tid, first, first + length)])


def _merged(batches):
    """All removed ranges of a document -> the fewest ranges that cover the same sentences."""
    for batch in batches:
        out = []
        for blobs in batch.column(2):
            r = np.frombuffer(b"".join(blobs.as_py()), np.int32).reshape(-1, 2)
            out.append(_fewest(r[np.argsort(r[:, 0], kind="stable")]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["rid", "tid", "ranges"])


def _fewest(r: np.ndarray) -> np.ndarray:
    """The fewest ranges that cover what ``r`` does, which goes by first sentence."""
    reach = np.maximum.accumulate(r[:, 1])
    cut = np.flatnonzero(np.concatenate([[True], r[1:, 0] > reach[:-1]]))
    return np.stack([r[cut, 0], reach[np.append(cut[1:], len(r)) - 1]], axis=1).astype(np.int32)


def _cut(position: int, ranges: int):
    """Rows with their removed sentence ranges -> rows with the remaining text, and counts."""

    def run(batches):
        for batch in batches:
            raw, at = buffers(batch.column(position))
            removed = batch.column(ranges).to_pylist()
            texts, sentences, gone, words_gone = [], [], [], []
            for i, part, own in chunks(raw, at):
                s = Sentences(part, own)
                for k in range(len(own) - 1):
                    lo, hi = s.row_at[k], s.row_at[k + 1]
                    sentences.append(int(hi - lo))
                    if not removed[i + k]:
                        texts.append(None)
                        gone.append(0)
                        words_gone.append(0)
                        continue
                    mark = np.zeros(hi - lo + 1, np.int32)
                    r = np.frombuffer(removed[i + k], np.int32).reshape(-1, 2)
                    mark[r[:, 0]] += 1
                    mark[r[:, 1]] -= 1
                    out = np.cumsum(mark)[:-1] > 0
                    gone.append(int(out.sum()))
                    words_gone.append(int(s.words[lo:hi][out].sum()))
                    # a sentence goes with the white space behind it
                    begin = s.byte_from[lo:hi]
                    edge = np.append(begin, own[k + 1])
                    keep = [part[own[k] : begin[0]].tobytes()] if len(begin) and not out[0] else []
                    keep += [part[edge[j] : edge[j + 1]].tobytes() for j in np.flatnonzero(~out)]
                    texts.append(b"".join(keep).decode().rstrip(" \t\n\v\f\r") if out[-1:].any() else b"".join(keep).decode())
            old = batch.column(position)
            hit = pa.array([x is not None for x in texts], pa.bool_())
            text = pa.compute.if_else(hit, pa.array(texts, pa.string()), old.cast(pa.string()))
            cols = [*batch.columns]
            cols[position] = text
            del cols[ranges]
            cols += [pa.array(sentences, pa.int64()), pa.array(gone, pa.int64()), pa.array(words_gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols) - 3)] + ["n_sentences", "n_removed", "words_removed"])

    import pyarrow.compute  # noqa: F401

    return run


_ADDED = ["n_sentences", "n_removed", "words_removed"]


def _deduplicated(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """With numbered columns: the remaining text in place, plus _ADDED."""
    spark = docs.sparkSession
    text_batches(spark)
    partitions = shuffle_partitions(spark)
    id_at, text_at = place(docs, doc_id), place(docs, text)
    base = numbered(docs)
    base = spread(base.withColumn(text_at, F.col(text_at).cast("string")), id_at, text_at)
    tid = F.xxhash64(F.col(text_at))
    # 32 bits of it tell apart texts of one doc_id
    keyed = base.withColumn("rid", F.coalesce(F.col(id_at).cast("long"), tid)).withColumn("tid", F.shiftright(tid, 32).cast("int"))
    sent = keyed.select("rid", "tid", text_at).mapInArrow(_span_blocks(2 * partitions), "block long, bucket int, payload binary")
    # own removals need no meeting: spread them
    to = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("payload"), F.lit(partitions)).cast("int")).otherwise(F.col("bucket"))
    lost = sent.withColumn("to", to).repartition(partitions, "to").sortWithinPartitions("bucket").drop("to").mapInArrow(_span_winners, "block long, payload binary")
    lost = lost.groupBy("block").applyInArrow(_added_up, "rid long, tid int, payload binary")
    # a document is in several blocks only if its row is repeated
    lost = lost.groupBy("rid", "tid").agg(F.collect_list("payload").alias("ranges")).mapInArrow(_merged, "rid long, tid int, ranges binary")
    lost = written(lost, "spans", max(6, partitions // 8))
    rows, size = lost.agg(F.count("*"), F.sum(F.octet_length("ranges"))).first()
    small = rows <= BROADCAST_ROWS // 4 and (size or 0) <= BROADCAST_BYTES
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(base.schema))
    joined = keyed.join(F.broadcast(lost) if small else lost, ["rid", "tid"], "left").select(*base.columns, "ranges")
    return joined.mapInArrow(_cut(base.columns.index(text_at), len(base.columns)), f"{kinds}, n_sentences long, n_removed long, words_removed long")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated spans removed from ``text``, plus n_sentences, n_removed and words_removed.

    The first occurrence is that of the smallest doc_id (a null one by a hash of
    its text), then of the smallest place.  Repeated rows share their fate: the
    occurrences of rows with equal id and text count as one.  Null text stays
    null; a document may lose its whole text and then has an empty one.  Whole
    texts are read, however long; an empty table gives no rows.  An added name
    that ``docs`` has already gets an underscore at its end.
    """
    return named(_deduplicated(docs, doc_id, text), docs, _ADDED)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` after removal, with its own columns; n_chars, where there, follows the text.  Documents that lose all their text go."""
    done = _deduplicated(docs, doc_id, text).where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_sentences"))))
    if "n_chars" in docs.columns:
        chars, words = place(docs, "n_chars"), F.col(place(docs, text))
        done = done.withColumn(chars, F.when(F.col("n_removed") > 0, F.length(words)).otherwise(F.col(chars)).cast(docs.schema["n_chars"].dataType))
    return named(done, docs, [])
