"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 6).

A bounded sample of labelled rows is dealt into folds by a hash of the id.  The
lexicon holds words and word beginnings that toxic texts have far more often;
a training row's features come from the counts of the other folds, so the trees
see entries as they will meet them in new texts.  In the same way the
calibration is fitted on scores of trees that have not seen the row.  The model
is a few hundred kilobytes and goes to the executors with the kernel; every
whole text is scored in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .kernels import _BYTE, _LOWER, SPACE, Words, buffers, chunks, mix
from .store import spread, text_batches, written

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 40_000
#: Toxic documents of the sample that a lexicon entry must occur in; how much more often than in others.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 6.0
#: Byte lengths of the word beginnings that may be entries.
BEGINNINGS = (4, 5, 6, 7)
#: Words between a second-person word and an entry that count as near.
NEAR = 5
THRESHOLD = 0.3
FOLDS = 4
# Second-person words of English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros vuestro".split()
# Look-alikes of letters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_WIDE = _LETTER.copy()
_WIDE[[ord(c) for c in LOOK_ALIKE]] = True
_LEET = _LOWER.copy()
for _a, _b in LOOK_ALIKE.items():
    _LEET[ord(_a)] = _BYTE[ord(_b)]
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
NAMES = (
    "entry_density beginning_density log_entries log_beginnings strongest disguised_density near_second_person second_person_density "
    "capitals all_capitals exclamations questions punctuation obfuscation repeated_letters log_words"
).split()


def _letters(raw, at) -> Words:
    return Words(raw, at, _LETTER)


def _second_person() -> np.ndarray:
    texts = [w.encode() for w in SECOND_PERSON]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return np.sort(_letters(raw, at).hashes(lower=True))


def _among(h: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(h), bool)
    i = np.searchsorted(sorted_values, h)
    return sorted_values[np.minimum(i, len(sorted_values) - 1)] == h


def _grams(words: Words):
    """(kind, word, hash): kind 0 for whole words, else the length of a beginning."""
    yield 0, np.arange(len(words.start)), words.hashes(lower=True)
    for n in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start >= n)
        yield n, long, mix(words.range_hash(words.start[long], words.start[long] + n, lower=True) + np.uint64(n))


def _gram_counts(batches):
    """(fold, toxic, text) -> (gram, beginning, toxic and other documents of each fold), summed within each batch."""
    for batch in batches:
        column = np.asarray(batch.column(0), np.int64) * 2 + (np.asarray(batch.column(1), np.int64) == 0)
        raw, at = buffers(batch.column(2))
        hashes, kinds, columns = [], [], []
        for i, part, own in chunks(raw, at):
            words = _letters(part, own)
            row = words.row
            for kind, which, h in _grams(words):
                order = np.lexsort((h, row[which]))
                h, r = h[order], row[which][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                hashes.append(h[new])
                columns.append(column[r[new] + i])
                kinds.append(np.full(int(new.sum()), kind > 0))
        if not hashes:
            continue
        values, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        counts = np.bincount(inverse * 2 * FOLDS + np.concatenate(columns), minlength=len(values) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(np.concatenate(kinds)[first]), *(pa.array(c.astype(np.int64)) for c in counts.T)], names=["gram", "beginning", *[f"n{i}" for i in range(2 * FOLDS)]]
        )


@dataclass
class Lexicon:
    words: np.ndarray
    word_weights: np.ndarray
    beginnings: np.ndarray
    beginning_weights: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, beginning: np.ndarray, bad: np.ndarray, good: np.ndarray, all_bad: int, all_good: int) -> Lexicon:
        """Entries that enough toxic texts hold, often enough against the others; weights grow with both."""
        ratio = ((bad + 0.5) / (all_bad + 1)) / ((good + 0.5) / (all_good + 1))
        keep = (bad >= LEAST_DOCUMENTS) & (ratio >= LEAST_RATIO)
        weight = np.log(np.maximum(ratio, 1)) * np.log1p(bad)
        halves = []
        for part in (keep & ~beginning, keep & beginning):
            order = np.argsort(gram[part])
            halves += [gram[part][order], weight[part][order]]
        return cls(*halves)


def _measure(raw: np.ndarray, at: np.ndarray, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    words = _letters(raw, at)
    row, count = words.row, np.maximum(words.counts, 1)
    total = len(words.start)
    weight, entry, begin = np.zeros(total), np.zeros(total, bool), np.zeros(total, bool)
    for kind, which, h in _grams(words):
        values, weights = (lexicon.beginnings, lexicon.beginning_weights) if kind else (lexicon.words, lexicon.word_weights)
        hit = _among(h, values)
        at_words = which[hit]
        (begin if kind else entry)[at_words] = True
        if hit.any():
            np.maximum.at(weight, at_words, weights[np.searchsorted(values, h[hit])])
    per_row = lambda flags, r=row: np.bincount(r[flags], minlength=n).astype(float)
    entries, begins = per_row(entry), per_row(begin)
    strongest = np.zeros(n)
    np.maximum.at(strongest, row, weight)

    you = _among(words.hashes(lower=True), second)
    # distance to the nearest second-person word of the same text
    place = np.arange(total)
    before = np.maximum.accumulate(np.where(you, place, -10**9)) if total else place
    after = np.minimum.accumulate(np.where(you, place, 10**9)[::-1])[::-1] if total else place
    own_from, own_to = words.row_at[:-1][row], words.row_at[1:][row]
    close = ((place - before <= NEAR) & (before >= own_from)) | ((after - place <= NEAR) & (after < own_to))
    near = per_row((entry | begin) & close)

    wide = Words(raw, at, _WIDE)
    odd = np.concatenate([[0], np.cumsum(_WIDE[raw] & ~_LETTER[raw])])
    letters_in = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    mixed = ((odd[wide.end] - odd[wide.start]) > 0) & ((letters_in[wide.end] - letters_in[wide.start]) > 0)
    disguised = np.zeros(n)
    if mixed.any():
        h = wide.range_hash(wide.start[mixed], wide.end[mixed], table=_LEET)
        disguised = np.bincount(wide.row[mixed][_among(h, lexicon.words)], minlength=n).astype(float)

    per_byte = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at]).astype(float)
    letters = np.maximum(per_byte(_LETTER[raw]), 1)
    chars = np.maximum(per_byte(~SPACE[raw]), 1)
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    shout = (upper[words.end] - upper[words.start] == words.end - words.start) & (words.end - words.start > 1)
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = _LETTER[raw[:-2]] & _LETTER[raw[2:]] & ~_LETTER[raw[1:-1]] & ~SPACE[raw[1:-1]] & (raw[1:-1] != 39) & (raw[1:-1] != 45)
        triple = np.zeros(len(raw), bool)
        triple[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & _LETTER[raw[2:]]
    else:
        triple = inner
    return np.stack(
        [
            entries / count, begins / count, np.log1p(entries), np.log1p(begins), strongest, disguised / count, near / count, per_row(you) / count,
            per_byte(_UPPER[raw]) / letters, per_row(shout) / count, per_byte(raw == 33) / chars, per_byte(raw == 63) / chars, per_byte(_PUNCTUATION[raw]) / chars,
            per_byte(inner) / chars, per_byte(triple) / letters, np.log1p(words.counts),
        ],
        axis=1,
    )


def _matrix(column, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    raw, at = buffers(column)
    got = [_measure(part, own, lexicon, second) for _, part, own in chunks(raw, at)]
    return np.concatenate(got) if got else np.zeros((0, len(NAMES)))


def _feature_rows(lexicons: list[Lexicon]):
    """(fold, toxic, text) -> features by the fold's lexicon."""

    def run(batches):
        second = _second_person()
        for batch in batches:
            fold = np.asarray(batch.column(0), np.int64)
            for f, lexicon in enumerate(lexicons):
                own = pa.array(np.flatnonzero(fold == f))
                x = _matrix(batch.column(2).take(own), lexicon, second)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), flat], names=["fold", "toxic", "x"])

    return run


@dataclass
class Model:
    """toxic texts' score, and what it was learned with; ``trees`` is None where there was nothing to learn."""

    lexicon: Lexicon
    trees: BoostedTrees | None
    calibration: Isotonic | None
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or self.calibration is None:
            return np.full(len(x), self.base)
        raw = self.trees.raw(x)
        # the calibrated steps, with the trees' order kept within a step
        return np.clip(0.998 * self.calibration(raw) + 0.002 / (1 + np.exp(-raw)), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _sizes(sample: DataFrame) -> np.ndarray:
    """Toxic and other texts of each fold."""
    size = np.zeros((FOLDS, 2), np.int64)
    for r in sample.groupBy("fold", "toxic").count().collect():
        size[r["fold"], 1 - r["toxic"]] = r["count"]
    return size


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``most`` labelled rows that are not held out, those with the smallest hash of their id.

    Rows without a label or text and labels of unknown documents teach nothing;
    of several labels of a document the largest counts.  Folds are dealt by the
    id's hash; a label that this leaves out of a fold is dealt in turn.  With no
    document of a label, or one fold's only, nothing is learned and every text
    gets the same score.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    known = known.withColumn("spot", spot)
    n = known.count()
    cut = 1_000_000 if n <= most else int(1_000_000 * most / n)
    # the sample, and so the broadcast, is of about ``most`` rows at most
    chosen = known.where(F.col("spot") < cut).select("doc_id", "toxic", (F.col("spot") % FOLDS).cast("int").alias("fold"))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").where("text is not null")
    sample = written(sample.select("fold", (F.col("toxic") > 0).cast("long").alias("toxic"), "text", "doc_id"), "labelled")
    size = _sizes(sample)
    rare = [1 - j for j in range(2) if size[:, j].any() and not size[:, j].all()]
    if rare:
        # a label that misses a fold by its hash has few documents
        turn = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
        turns = sample.where(F.col("toxic").isin(rare)).select("toxic", "doc_id").distinct().select("doc_id", ((turn - 1) % FOLDS).alias("turn"))
        sample = sample.join(F.broadcast(turns), "doc_id", "left").select(F.coalesce("turn", "fold").alias("fold"), "toxic", "text", "doc_id")
        sample = written(sample, "dealt")
        size = _sizes(sample)
    bad, good = (int(v) for v in size.sum(axis=0))
    base = bad / (bad + good) if bad + good else 0.0
    none = np.zeros(0, np.uint64), np.zeros(0)
    # what a fold is scored with comes from the others, which must hold both labels
    if (size.sum(axis=0) == size).any():
        return Model(Lexicon(*none, *none), None, None, base)
    columns = [f"n{i}" for i in range(2 * FOLDS)]
    grams = sample.mapInArrow(_gram_counts, "gram long, beginning boolean, " + ", ".join(f"{c} long" for c in columns))
    sums = grams.groupBy("gram").agg(F.first("beginning").alias("beginning"), *[F.sum(c).alias(c) for c in columns])
    all_of = lambda k: sum((F.col(c) for c in columns[k::2]), F.lit(0))
    ratio = ((all_of(0) + 0.5) / (bad + 1)) / ((all_of(1) + 0.5) / (good + 1))
    top = sums.where(all_of(0) >= LEAST_DOCUMENTS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy("gram").toPandas()
    gram, beginning = top.gram.to_numpy().astype(np.int64).view(np.uint64), top.beginning.to_numpy().astype(bool)
    counts = top[columns].to_numpy().astype(np.int64).reshape(-1, FOLDS, 2)
    every = counts.sum(axis=1)
    lexicons = [Lexicon.of(gram, beginning, *(every - counts[:, f]).T, *(size.sum(axis=0) - size[f])) for f in range(FOLDS)]
    rows = sample.mapInArrow(_feature_rows(lexicons), "fold int, toxic long, x array<double>").toPandas()
    x, y, fold = np.array(rows.x.tolist(), float).reshape(-1, len(NAMES)), rows.toxic.to_numpy(float), rows.fold.to_numpy()
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        unseen[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(Lexicon.of(gram, beginning, *every.T, bad, good), BoostedTrees().fit(x, y), Isotonic().fit(unseen, y), base)


def _score(model: Model):
    def run(batches):
        second = _second_person()
        for batch in batches:
            score = model.score(_matrix(batch.column(2), model.lexicon, second))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, from its text alone.

    Null text scores as an empty one; a null id is not held out.  Whole texts are
    scored, however long; repeated rows alike.  An empty table gives no rows.
    Other columns are not read, so their names cannot clash.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = spread(rows, "doc_id", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
