"""N-gram Jaccard join (operator 3): a blocked sparse product of the document by n-gram incidence.

A document's row of the incidence matrix is its set of word shingles.  Rows come
in blocks (about a million entries of a task's documents), columns in hash
ranges, and only blocks travel:

1. Every block sends each column range its entries, each distinct shingle once.
   The range counts how many documents hold each shingle and adds up, per
   document, how many of its shingles another document holds too.  A document
   that shares fewer than ``threshold`` of its own shingles cannot link.
2. The sets of what remains, one document for each distinct set, go through the
   same exchange again; now each shingle gets its document frequency.  A
   document posts only its rarest shingles: if two sets overlap in ``a`` or
   more, their ``|x| - a + DEPTH`` rarest have ``min(DEPTH, a)`` in common.
3. Overlap counts over these postings are accumulated per pair, and pairs below
   the bounds from their sizes and counts are discarded; the rest is verified
   on whole sets.  Groups of near copies would give all their pairs, so first
   each posting list is joined with its most central document only, and then
   pairs are formed just between different components.  What is verified or
   already connected covers every pair that could link.  A document has no more
   in common with another than it has with all others together, so the sizes
   that its partners may have end there: documents around one passage that are
   too long to link with each other never become pairs.  A long list is dealt to
   tiles, and each pair of tiles is a task's work of its own.

Rows with the same set (exact copies among them) are one node throughout.
Sets are of 64-bit hashes; nothing is capped or sampled.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import Words, buffers, chunks, mix, pack, pack_sorted, shingles, unpack, unpack_sorted
from .store import bounded, named, numbered, place, shuffle_partitions, spread, text_batches, written

#: Entries of a block of the incidence matrix.
BLOCK_ENTRIES = 1_000_000
#: Common rare shingles that a linked pair must have (fewer where its overlap bound is lower).
DEPTH = 8
#: Pairs formed at a time within one posting list, and entries of a list that form one tile.
PAIR_TILE, LIST_TILE = 400_000, 20_000


def _least_overlap(x, y, num: int, den: int):
    """Smallest intersection of sets of sizes x and y whose Jaccard similarity is num / den or more."""
    return -((-num * (x + y)) // (num + den))


def _own_least(n, num: int, den: int):
    """Smallest intersection with a set of any size."""
    return -((-num * n) // den)


def _header(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _parts(blob: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(blob):
        (n,) = struct.unpack_from("<I", blob, i)
        out.append(blob[i + 4 : i + 4 + n])
        i += 4 + n
    return out


_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _messages(block: int, rows: int, tokens: np.ndarray, doc: np.ndarray, buckets: int, head: bytes, top: int, count_only: bool):
    """One message for each column range: its shingles in order, and whose they are.

    tokens: sorted, below 2**top; doc: row of the block.  With count_only a shingle
    that several rows of the block hold is sent without them: they are known to
    share it, which is counted here.
    """
    edges = ((np.arange(1, buckets, dtype=np.float64) / buckets) * 2.0**top).astype(np.uint64)
    cut = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
    wide = np.uint16 if rows < 65_535 else np.uint32
    none = np.iinfo(wide).max
    for b in range(buckets):
        t, d = tokens[cut[b] : cut[b + 1]], doc[cut[b] : cut[b + 1]]
        if not count_only:
            yield block, b, _header(head if b == 0 else b"", pack_sorted(t), pack(d.astype(wide)), struct.pack("<B", d.astype(wide).itemsize))
            continue
        have = np.bincount(d, minlength=rows).astype(np.uint32)
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        at = np.flatnonzero(new)
        several = np.diff(np.append(at, len(t))) > 1
        local = np.bincount(d[np.repeat(several, np.diff(np.append(at, len(t))))], minlength=rows).astype(np.uint32) if len(t) else have
        who = d[at].astype(wide)
        who[several] = none
        yield block, b, _header(head if b == 0 else b"", pack_sorted(t[at]), pack(who), struct.pack("<B", who.itemsize), pack(have), pack(local))


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MESSAGE)], schema=_MESSAGE)


def _text_blocks(buckets: int, bits: int, k: int):
    """Blocks of documents -> messages of shingles cut to ``bits`` bits (enough to tell shared ones)."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, sizes, signs, tokens, docs, rows, entries = [], [], [], [], [], 0, 0

        def flush():
            nonlocal number, rows, entries
            t, d = np.concatenate(tokens), np.concatenate(docs)
            order = np.argsort(t, kind="stable")
            head = _header(pack(np.concatenate(ids)), pack(np.concatenate(sizes)), pack(np.concatenate(signs)))
            out = _batch(_messages(number, rows, t[order], d[order], buckets, head, bits, True))
            number, rows, entries = number + 1, 0, 0
            for x in (ids, sizes, signs, tokens, docs):
                x.clear()
            return out

        for batch in batches:
            raw, at = buffers(batch.column(1))
            rid = np.asarray(batch.column(0).cast(pa.int64()), np.int64)
            for i, part, own in chunks(raw, at):
                h, row, size, sign = _sets(part, own, k)
                ids.append(rid[i : i + len(own) - 1])
                sizes.append(size.astype(np.int64))
                signs.append(sign)
                tokens.append(h >> np.uint64(64 - bits))
                docs.append((row + rows).astype(np.int64))
                rows += len(own) - 1
                entries += len(h)
                if entries >= BLOCK_ENTRIES or rows >= 50_000:
                    yield flush()
        if rows:
            yield flush()

    return run


def _sets(raw: np.ndarray, at: np.ndarray, k: int):
    """Distinct shingles of a chunk's texts: (shingle, text) sorted by text, set sizes, set signatures."""
    n = len(at) - 1
    h, row = shingles(Words(raw, at), k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    size = np.bincount(row, minlength=n)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h), out=sums[1:])
    edge = np.concatenate([[0], np.cumsum(size)])
    sign = mix(sums[edge[1:]] - sums[edge[:-1]] + size.astype(np.uint64))
    sign[size == 0] = 0
    return h, row, size, sign.view(np.int64)


def _shared_counts(batches):
    """Messages of a column range -> for each block, per row how many shingles it has and how many are shared."""
    for bucket in _by_bucket(batches):
        blocks, heads, tokens, who, at, have, local = [], [], [], [], [0], [], []
        for block, payload in bucket:
            head, t, w, width, hv, lc = _parts(payload)
            blocks.append(block)
            heads.append(head)
            tokens.append(unpack_sorted(t, np.uint64))
            w = unpack(w, np.uint16 if width == b"\x02" else np.uint32)
            own = w.astype(np.int64)
            own[w == np.iinfo(w.dtype).max] = -1
            have.append(unpack(hv, np.uint32))
            local.append(unpack(lc, np.uint32).astype(np.int64))
            own[own >= 0] += at[-1]
            who.append(own)
            at.append(at[-1] + len(have[-1]))
        t, w = np.concatenate(tokens), np.concatenate(who)
        order = np.argsort(t, kind="stable")
        s = t[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        shared = w[order[same[:-1] | same[1:]]]
        found = np.bincount(shared[shared >= 0], minlength=at[-1]) + np.concatenate(local)
        out = []
        for k, block in enumerate(blocks):
            out.append((block, 0, _header(heads[k], pack(have[k]), pack(found[at[k] : at[k + 1]].astype(np.uint32)))))
        yield _batch(out)


def _by_bucket(batches):
    """The messages of one bucket after another (a partition comes sorted by bucket)."""
    now, rows = None, []
    for batch in batches:
        for block, bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != now:
                if rows:
                    yield rows
                now, rows = bucket, []
            rows.append((block, payload.as_py()))
    if rows:
        yield rows


def _sum_block(table: pa.Table) -> pa.Table:
    """All ranges' counts of a block -> its documents."""
    head, have, found = b"", 0, 0
    for payload in table.column("payload"):
        h, hv, fd = _parts(payload.as_py())
        head = head or h
        have, found = have + unpack(hv, np.uint32).astype(np.int64), found + unpack(fd, np.uint32).astype(np.int64)
    ids, sizes, signs = _parts(head)
    # have: shingles after the cut to fewer bits, where two of a text may coincide; counts only have to be no lower than the truth
    return pa.table({"rid": unpack(ids, np.int64), "n": unpack(sizes, np.int64), "sign": unpack(signs, np.int64), "shared": found + unpack(sizes, np.int64) - have})


def _exchange(df: DataFrame, kernel, reply, buckets: int, partitions: int) -> DataFrame:
    sent = df.mapInArrow(kernel, "block long, bucket int, payload binary")
    return sent.repartitionById(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(reply, "block long, bucket int, payload binary")


def _text_sets(k: int):
    """(rid, text) -> a row for each non-empty set: its signature, size and sorted shingles."""

    def run(batches):
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for _, part, own in chunks(raw, at):
                h, _, size, sign = _sets(part, own, k)
                edge = np.concatenate([[0], np.cumsum(size)])
                some = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sign[some]), pa.array(size[some].astype(np.int64)), pa.array([h[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary())],
                    names=["sign", "n", "tokens"],
                )

    return run


def _set_blocks(buckets: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        signs, tokens, entries = [], [], 0

        def flush():
            nonlocal number, entries
            n = np.array([len(t) for t in tokens])
            t, d = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), n)
            order = np.argsort(t, kind="stable")
            head = _header(pack(np.array(signs, np.int64)), pack(n.astype(np.int64)))
            out = _batch(_messages(number, len(tokens), t[order], d[order], buckets, head, 64, False))
            number, entries = number + 1, 0
            signs.clear()
            tokens.clear()
            return out

        for batch in batches:
            for sign, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                signs.append(sign)
                tokens.append(np.frombuffer(blob.as_py(), np.uint64))
                entries += n
                if entries >= BLOCK_ENTRIES or len(signs) >= 50_000:
                    yield flush()
        if tokens:
            yield flush()

    return run


def _frequencies(batches):
    """Messages of a column range -> for each block its entries with a document frequency over 1, and it."""
    for bucket in _by_bucket(batches):
        got = [(block, *_parts(payload)) for block, payload in bucket]
        tokens = [unpack_sorted(x[2], np.uint64) for x in got]
        values, counts = np.unique(np.concatenate(tokens), return_counts=True)
        out = []
        for (block, head, _, who, width), t in zip(got, tokens, strict=True):
            df = counts[np.searchsorted(values, t)]
            keep = df > 1
            w = unpack(who, np.uint16 if width == b"\x02" else np.uint32)
            out.append((block, 0, _header(head, pack_sorted(t[keep]), pack(w[keep].astype(np.uint32)), pack(df[keep].astype(np.uint32)))))
        yield _batch(out)


def _postings(num: int, den: int):
    """All replies to a block -> the postings of its documents' rarest shingles."""

    def run(table: pa.Table) -> pa.Table:
        head, tokens, who, df = b"", [], [], []
        for payload in table.column("payload"):
            h, t, w, f = _parts(payload.as_py())
            head = head or h
            tokens.append(unpack_sorted(t, np.uint64))
            who.append(unpack(w, np.uint32).astype(np.int64))
            df.append(unpack(f, np.uint32).astype(np.int64))
        signs, sizes = (unpack(x, np.int64) for x in _parts(head))
        t, w, f = np.concatenate(tokens), np.concatenate(who), np.concatenate(df)
        shared = np.bincount(w, minlength=len(sizes))
        central = (np.bincount(w, weights=f.astype(np.float64), minlength=len(sizes)) + sizes - shared) / np.maximum(sizes, 1)
        least = _own_least(sizes, num, den)
        able = shared >= least
        order = np.lexsort((t, f, w))
        t, w = t[order], w[order]
        first = np.concatenate([[0], np.cumsum(shared)])[:-1]
        place = np.arange(len(w)) - first[w] + (sizes - shared)[w]
        keep = able[w] & (place < (sizes - least + DEPTH)[w])
        t, w = t[keep], w[keep]
        return pa.table({"token": t.view(np.int64), "sign": signs[w], "n": sizes[w], "shared": shared[w], "central": central[w]})

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("lane", pa.int32()), ("payload", pa.binary())])


def _cross_pairs(num: int, den: int):
    """Posting lists (sorted by token, cell and size) -> for each document, those it meets in a list, in another component, of a fitting size.

    A row holds some of the others that a document meets, with the number of
    meetings that a linked pair of their sizes has at least.  A cell holds one
    tile of a list, for the pairs within it, or two, for those between them.
    """

    def lists(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            t, c = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if t[-1] == np.asarray(kept[0].column(0))[0] and c[-1] == np.asarray(kept[0].column(1))[0]:
                continue  # a list that goes on
            table = pa.Table.from_batches(kept)
            t, c = (np.asarray(table.column(k).combine_chunks()) for k in (0, 1))
            end = int(np.flatnonzero((t == t[-1]) & (c == c[-1]))[0])
            yield table.slice(0, end)
            kept = table.slice(end).combine_chunks().to_batches()
        if kept:
            yield pa.Table.from_batches(kept)

    def run(batches):
        a, b, need, held = [], [], [], 0
        for table in lists(batches):
            t, cell, r, s, n, h, c, w = (np.asarray(x.combine_chunks()) for x in table.columns[:8])
            across = table.column(8).combine_chunks().to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(t)]])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                tile, sign, size, shared, comp, weight = r[lo:hi], s[lo:hi], n[lo:hi], h[lo:hi], c[lo:hi], w[lo:hi]
                values, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
                if len(values) < 2:
                    continue
                most = inverse == np.argmax(counts)
                far = np.flatnonzero(~most)
                # the partners' sizes: of one document a range, as the list goes by size
                least, largest = -((-num * size) // den), np.minimum((den * size) // num, ((num + den) * shared) // num - size)
                begin = np.searchsorted(size, least[far])
                count = np.maximum(np.searchsorted(size, largest[far], "right") - begin, 0)
                group = np.cumsum(count) // PAIR_TILE
                for part in np.split(np.arange(len(far)), np.flatnonzero(np.diff(group)) + 1):
                    k = count[part]
                    p = np.repeat(far[part], k)
                    q = np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[part], k)
                    ok = (comp[p] != comp[q]) & (size[p] <= largest[q]) & (most[q] | (sign[p] < sign[q]))  # both ends outside the largest component: once, from the smaller
                    if across[lo]:
                        ok &= tile[p] != tile[q]
                    p, q = p[ok], q[ok]
                    need.append(np.minimum(_least_overlap(size[p], size[q], num, den), DEPTH).astype(np.uint8))
                    # named from the end in the smaller component, so that all lists count a pair together
                    turn = (weight[p] > weight[q]) | ((weight[p] == weight[q]) & (sign[p] > sign[q]))
                    a.append(sign[np.where(turn, q, p)])
                    b.append(sign[np.where(turn, p, q)])
                    held += len(p)
                    if held > PAIR_TILE:
                        yield _grouped(a, b, need)
                        a, b, need, held = [], [], [], 0
        if held:
            yield _grouped(a, b, need)

    return run


def _cells(met: DataFrame) -> DataFrame:
    """Postings with ``rows``, their list's length -> (token, cell, tile, ...): a list of several tiles goes to a cell for each pair of its tiles."""
    tiles = F.ceil(F.col("rows") / LIST_TILE).cast("int")
    tile = F.pmod(F.shiftright("sign", 16), F.col("tiles")).cast("int")  # signatures are mixed hashes
    dealt = met.withColumn("tiles", tiles).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("cell", F.least("tile", "other") * F.col("tiles") + F.greatest("tile", "other"))
    return dealt.select("token", "cell", "tile", "sign", "n", "shared", "component", "weight", (F.col("tile") != F.col("other")).alias("across"))


def _grouped(a: list, b: list, need: list) -> pa.RecordBatch:
    x, y, need = np.concatenate(a), np.concatenate(b), np.concatenate(need)
    lane = (mix(y.view(np.uint64)) & np.uint64(3)).astype(np.int64)
    order = np.lexsort((y, lane, x))
    x, y, lane, need = x[order], y[order], lane[order], need[order]
    cut = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]) | (lane[1:] != lane[:-1])) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    payload = [y[i:j].tobytes() + need[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x[cut[:-1]], pa.int64()), pa.array(lane[cut[:-1]].astype(np.int32), pa.int32()), pa.array(payload, pa.binary())], schema=_PAIRS)


def _block_of(sign: np.ndarray, blocks: int) -> np.ndarray:
    return (sign >> 8) % blocks


def _often(blocks: int):
    """Meetings sorted by document and lane -> those met as often as a linked pair of their sizes must, or DEPTH times, by block of the other."""
    schema = pa.schema([("a", pa.int64()), ("block", pa.int32()), ("others", pa.list_(pa.int64()))])

    def counted(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        cut = cut[np.diff(np.append(cut, len(a))) >= need[cut]]
        a, b = a[cut], b[cut]
        block = _block_of(b, blocks)
        order = np.lexsort((block, a))
        a, b, block = a[order], b[order], block[order]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (block[1:] != block[:-1])])) if len(a) else np.zeros(0, np.int64)
        others = pa.ListArray.from_arrays(pa.array(np.append(cut, len(b)).astype(np.int32)), pa.array(b, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(a[cut], pa.int64()), pa.array(block[cut].astype(np.int32), pa.int32()), others], schema=schema)

    def run(batches):
        held, size, now = ([], [], []), 0, None
        for batch in batches:
            for a, lane, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (a, lane) != now and size > PAIR_TILE:
                    yield counted(*map(np.concatenate, held))
                    held, size = ([], [], []), 0
                now = a, lane
                blob = payload.as_py()
                n = len(blob) // 9
                held[0].append(np.full(n, a, np.int64))
                held[1].append(np.frombuffer(blob, np.int64, n))
                held[2].append(np.frombuffer(blob, np.uint8, n, 8 * n))
                size += n
        if size:
            yield counted(*map(np.concatenate, held))

    return run


def _block_product(num: int, den: int):
    """Each block's sets, then the rows that ask about it: (block, sign or asker, component, tokens, others) -> links (a, b).

    A block is held as its incidence matrix in order of shingles; an asker's set
    times it gives the overlap with every set of the block.  Of an asker's links
    into one component one is returned.
    """

    def answers(a: int, x: np.ndarray, others: np.ndarray, signs, components, sizes, edge, flat, tokens, doc):
        at = np.searchsorted(signs, others)
        at = at[signs[np.minimum(at, len(signs) - 1)] == others]
        if len(at) > 8:
            lo, hi = np.searchsorted(tokens, x), np.searchsorted(tokens, x, "right")
            n = hi - lo
            place = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(doc[place], minlength=len(signs))[at]
        else:
            both = np.array([len(np.intersect1d(x, flat[edge[i] : edge[i + 1]], assume_unique=True)) for i in at], np.int64)
        good = at[den * both >= num * (len(x) + sizes[at] - both)]
        _, first = np.unique(components[good], return_index=True)
        return [(a, int(signs[i])) for i in good[first]]

    def run(batches):
        now, own, ready, out = None, [], None, []
        for batch in batches:
            for k, block in enumerate(batch.column(0).to_pylist()):
                sign, component, blob = batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
                if block != now:
                    now, own, ready = block, [], None
                others = batch.column(4)[k]
                if not others.is_valid:
                    own.append((sign, component, blob))
                    continue
                if ready is None:
                    own.sort(key=lambda r: r[0])
                    signs, components = (np.array([r[j] for r in own], np.int64) for j in (0, 1))
                    sizes = np.array([len(r[2]) for r in own], np.int64)
                    flat = np.concatenate([r[2] for r in own]) if own else np.zeros(0, np.uint64)
                    order = np.argsort(flat, kind="stable")
                    ready = signs, components, sizes, np.concatenate([[0], np.cumsum(sizes)]), flat, flat[order], np.repeat(np.arange(len(own)), sizes)[order]
                if own:
                    out += answers(sign, blob, np.asarray(others.values), *ready)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in (0, 1)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return run


def _links(asked: DataFrame, sets: DataFrame, blocks: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the pairs of ``asked`` (a, block, others), by a product with each block of ``sets`` (sign, component, tokens, block).

    Every set travels once with its block, and an asker's set once to each block that it asks.
    """
    own = sets.select("block", "sign", "component", "tokens", F.lit(None).cast("array<long>").alias("others"))
    askers = asked.join(sets.select(F.col("sign").alias("a"), "component", "tokens"), "a").select("block", F.col("a").alias("sign"), "component", "tokens", "others")
    both = own.unionByName(askers).withColumn("asks", F.col("others").isNotNull())
    both = both.repartitionById(shuffle_partitions(sets.sparkSession), "block").sortWithinPartitions("block", "asks").drop("asks")
    return both.mapInArrow(_block_product(num, den), "a long, b long")


def _placed(docs: DataFrame, k: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """(id, n, sign, group, least) for every row: its id, the size and signature of its set, its component and the least id of that."""
    spark = docs.sparkSession
    text_batches(spark)
    partitions = shuffle_partitions(spark)
    buckets, files = 2 * partitions, max(6, partitions // 8)
    base = numbered(docs).select(F.col(place(docs, doc_id)).cast("long").alias("id"), F.col(place(docs, text)).cast("string").alias("text"))
    base = base.select("id", F.coalesce("id", F.xxhash64("text")).alias("rid"), "text")
    base = spread(base, "rid", "text")
    bits = min(64, int(base.count()).bit_length() + 20)

    counted = _exchange(base.select("rid", "text"), _text_blocks(buckets, bits, k), _shared_counts, buckets, partitions)
    counted = counted.groupBy("block").applyInArrow(_sum_block, "rid long, n long, sign long, shared long")
    counted = written(counted, "shared", files)

    able = counted.where((F.col("n") > 0) & (F.col("shared") * den >= F.col("n") * num))
    chosen = written(able.groupBy("sign").agg(F.min("rid").alias("rid")).select("rid").distinct(), "chosen", files)
    sets = written(base.join(bounded(chosen), "rid", "left_semi").select("rid", "text").mapInArrow(_text_sets(k), "sign long, n long, tokens binary"), "sets")

    posts = _exchange(sets, _set_blocks(buckets), _frequencies, buckets, partitions)
    posts = written(posts.groupBy("block").applyInArrow(_postings(num, den), "token long, sign long, n long, shared long, central double"), "postings")

    # a set's block of about BLOCK_ENTRIES / 2 entries follows from its signature alone
    entries = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * entries // BLOCK_ENTRIES))
    # two sets that link are of like size, and neither has less in common with all others than they have together
    fits = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num
    enough = lambda s, x, y: s * (num + den) >= (x + y) * num
    pivot = posts.groupBy("token").agg(F.max(F.struct("central", "sign", "n", "shared")).alias("p"), F.min("sign").alias("lo"), F.max("sign").alias("hi")).where("lo <> hi")
    pivot = pivot.select("token", F.col("p.sign").alias("a"), F.col("p.n").alias("m"), F.col("p.shared").alias("of"))
    likely = fits(F.col("m"), F.col("n")) & enough(F.least("shared", "of"), F.col("m"), F.col("n"))
    stars = posts.join(pivot, "token").where((F.col("a") != F.col("sign")) & likely).select("a", F.col("sign").alias("b")).distinct()
    block = lambda c: F.pmod(F.shiftright(c, 8), F.lit(blocks)).cast("int")  # noqa: E731  signatures are mixed hashes
    stars = stars.groupBy("a", block("b").alias("block")).agg(F.collect_list("b").alias("others"))
    blocked = sets.select("sign", "tokens", block("sign").alias("block"))
    first = written(_links(stars, blocked.withColumn("component", F.col("sign")), blocks, num, den).repartition(2 * files, "a", "b"), "stars")

    node = components(first, "a", "b")
    node = written(node.join(node.groupBy("component").agg(F.count("*").alias("weight")), "component").select(F.col("node").alias("sign"), "component", "weight"), "nodes", files)
    now = posts.join(node, "sign", "left").select("token", "sign", "n", "shared", F.coalesce("component", "sign").alias("component"), F.coalesce("weight", F.lit(1)).alias("weight"))
    now = written(now, "placed")
    mixed = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("small"), F.count("*").alias("rows")).where("lo <> hi").select("token", "small", "rows")
    met = _cells(now.join(mixed, "token").where(enough(F.col("shared"), F.col("n"), F.col("small"))))
    met = met.repartition(partitions, "token", "cell").sortWithinPartitions("token", "cell", "n")
    met = met.mapInArrow(_cross_pairs(num, den), "a long, lane int, payload binary").repartition(partitions, "a", "lane").sortWithinPartitions("a", "lane")
    met = written(met.mapInArrow(_often(blocks), "a long, block int, others array<long>"), "met")
    blocked = blocked.join(node.select("sign", "component"), "sign", "left").withColumn("component", F.coalesce("component", "sign"))
    links = written(first.unionByName(_links(met, blocked, blocks, num, den)).repartition(2 * files, "a", "b"), "links")

    node = written(components(links, "a", "b"), "components", files)
    placed = counted.join(node.withColumnRenamed("node", "sign"), "sign", "left")
    # a row of an empty set stays by itself
    placed = placed.select("rid", "n", "sign", F.when(F.col("n") > 0, F.coalesce("component", "sign")).alias("group"))
    ids = written(base.select("id", "rid").where("id is null").select("rid").distinct(), "unnamed", files)
    placed = placed.join(bounded(ids).withColumn("lost", F.lit(True)), "rid", "left").select(F.when(F.col("lost").isNull(), F.col("rid")).alias("id"), "n", "sign", "group")
    # a row that is alone in its group needs no join
    groups = placed.where("group is not null").groupBy("group").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    groups = written(groups.select("group", "least"), "groups", files)
    return placed.join(bounded(groups), "group", "left").select("id", "n", "sign", "group", F.coalesce("least", "id").alias("least"))


def ngram_jaccard(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: components of documents whose ``k``-shingle sets have Jaccard similarity num / den or more.

    Null or blank text: an empty set, linked with nothing.  A null doc_id keeps
    its row and never names a component; a component of such rows only has a
    null id.  Rows with equal texts link (unless empty); repeated rows stay.
    Whole texts are read, however long; an empty table gives no rows.  Other
    columns are not read, so their names cannot clash.
    """
    placed = _placed(docs, k, num, den, doc_id, text)
    return placed.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def _signatures(position: int, k: int):
    """Rows -> rows and the signature of their text's set."""

    def run(batches):
        for batch in batches:
            raw, at = buffers(batch.column(position))
            signs = [_sets(part, own, k)[3] for _, part, own in chunks(raw, at)]
            signs = np.concatenate(signs) if signs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.int64())], names=[*batch.schema.names, "sign"])

    return run


def near_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of its smallest doc_id stays (one row of it, if repeated).

    Rows with a null doc_id stay.  Rows that share a doc_id are judged each by
    its own text: one stays for each component that the doc_id is the smallest
    of, and one without words.
    """
    k = 5
    files = max(6, shuffle_partitions(docs.sparkSession) // 8)
    base, at = numbered(docs), place(docs, doc_id)
    key = F.col(at).cast("long")
    many = written(base.groupBy(key.alias("many")).count().where("count > 1 and many is not null").select("many"), "many", 6)
    placed = _placed(docs, k, 8, 10, doc_id, text)
    some = many.limit(1).count()
    if some:
        placed = written(placed, "decided")
    gone = written(placed.where("id <> least").select(F.col("id").alias("gone")).distinct(), "gone", files)
    if not some:
        return named(base.join(bounded(gone), key == F.col("gone"), "left_anti"), docs, [])
    once = base.join(bounded(many), key == F.col("many"), "left_anti").join(bounded(gone), key == F.col("gone"), "left_anti")
    twice = base.join(bounded(many), key == F.col("many"), "left_semi").withColumn("_text", F.col(place(docs, text)).cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in twice.schema) + ", sign long"
    twice = twice.mapInArrow(_signatures(len(base.columns), k), kinds).drop("_text")
    fate = placed.join(bounded(many), F.col("id") == F.col("many"), "left_semi").select(F.col("id").alias("of"), F.col("sign").alias("own"), "group", "least")
    # where several sets of one doc_id are in a component, the least of them stands for it
    stay = fate.where("of = least").groupBy("of", "group").agg(F.min("own").alias("own"))
    twice = twice.join(stay, (key == F.col("of")) & (F.col("sign") == F.col("own")), "left_semi").dropDuplicates([at, "sign"]).drop("sign")
    return named(once.unionByName(twice), docs, [])
