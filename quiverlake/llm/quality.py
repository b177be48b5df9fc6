"""Quality rules (operator 2): fixed base rules, then thresholds that follow the data.

Each document's measures come from one pass over its bytes.  For every language
and source and every measure a quantile sketch is kept: counts in bins whose
edges grow by a fixed factor, so a quantile is exact to that factor.  Sketches
merge by adding counts, in any order with the same result.  A group's quartiles
are drawn towards those of its language, and these towards those of all rows,
by the weight of PRIOR rows: smoothly, whatever a group's size.

The fences of a group follow from its quartiles q1, q2, q3:

* a measure that varies in most documents: ``q2 + SPREAD (q2 - q1)`` and a noise
  term, and ``q2 - SPREAD (q3 - q2)`` less that term.  Each is measured on the
  other side of the median, so odd documents don't move it until they are half
  of their group.  The noise is what ODD words or symbols make of a short
  document (q1 of the group's lengths), or a share of the median;
* a measure that is 0 in most documents (RARE): ``q3 + TAIL (q3 - q1)`` over the
  documents where it isn't.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import SPACE, Words, buffers, chunks, window_hashes
from .store import named, numbered, place, spread, text_batches, written

#: Growth of the sketches' bins, and the value below which all is one bin.
GROWTH, FLOOR = 1.02, 1e-4
#: Rows that the quartiles of the wider group weigh in a group's own.
PRIOR = 100
#: Quartile distances to a fence from the median, and from q3 of a rare measure.
SPREAD, TAIL = 8.0, 3.0
#: Odd words or symbols that a short document may have, and the share of the median that a mean word length may be off.
ODD, OFF = 10.0, 0.1
RATES = ("symbol_rate", "word_length", "duplicate_line_rate", "repeat_rate", "stutter_rate")
RARE = ("duplicate_line_rate", "repeat_rate")
#: What the noise of a rate is relative to.
SIZES = {"symbol_rate": "word_chars", "stutter_rate": "n_words"}
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_stutters long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def _measure(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    n = len(at) - 1
    words = Words(raw, at)
    row, h = words.row, words.hashes()
    per_byte = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    chars = per_byte(~SPACE[raw] & ((raw & 0xC0) != 0x80))
    symbols = per_byte(_SYMBOL[raw])

    # lines: cut at \n and at the ends of texts
    feed = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([at[:-1], feed + 1]))
    begin = begin[begin < len(raw)]
    end = np.minimum(np.append(begin[1:], len(raw)), len(raw))
    end = end - ((end > begin) & (raw[end - 1] == 10)) if len(begin) else end
    holds = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin) if len(begin) else np.zeros(0, bool)
    begin, end = begin[holds], end[holds]
    line_row = np.searchsorted(at, begin, "right") - 1
    line = words.range_hash(begin, end)
    order = np.lexsort((line, line_row))
    again = np.zeros(len(order), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    dup = np.bincount(line_row[order][again], minlength=n)
    lines = np.bincount(line_row, minlength=n)

    # words in 8-word windows that occur again in the text
    win, first = window_hashes(words, h, 8)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(win):
        order = np.lexsort((win, row[first]))
        w, r = win[order], row[first][order]
        same = np.zeros(len(w) + 1, bool)
        same[1:-1] = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
        hit = first[order[same[:-1] | same[1:]]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 8, -1)
    repeat = np.bincount(row[np.cumsum(covered)[:-1] > 0], minlength=n)
    stutter = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(h) else np.zeros(n)
    return [words.counts, chars, symbols, dup, lines, repeat, stutter]


def _features(position: int):
    def run(batches):
        for batch in batches:
            raw, at = buffers(batch.column(position))
            got = [_measure(part, own) for _, part, own in chunks(raw, at)]
            cols = [pa.array(np.concatenate([g[k] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64)) for k in range(len(_NAMES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[f"c{i}" for i in range(batch.num_columns)] + _NAMES)

    return run


def features(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` (with numbered columns) plus the measured counts of the column ``text``.  Null text: all 0."""
    text_batches(docs.sparkSession)
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return docs.mapInArrow(_features(docs.columns.index(text)), f"{kinds}, {FEATURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _rates() -> dict[str, Column]:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_rate": over("n_symbols", "word_chars"),
        "word_length": over("word_chars", "n_words"),
        "duplicate_line_rate": over("n_dup_lines", "n_lines"),
        "repeat_rate": over("n_repeat_words", "n_words"),
        "stutter_rate": over("n_stutters", "n_words"),
    }


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches (lang, source, measure, bin, n) of the rows that pass the base rules: of the rates and of the lengths.

    Every row adds one to one bin of each measure before any shuffle, so a task
    sends at most ``log(max / FLOOR) / log(GROWTH)`` rows for a group and measure.
    """
    values = _rates() | {name: F.col(name).cast("double") for name in SIZES.values()}
    bins = [F.struct(F.lit(name).alias("measure"), F.when(v <= FLOOR, 0).otherwise(F.ceil(F.log(v / FLOOR) / math.log(GROWTH))).cast("int").alias("bin")) for name, v in values.items()]
    flat = measured.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.array(*bins)).alias("b"))
    return flat.groupBy("lang", "source", F.col("b.measure").alias("measure"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(tag_keys, tag_measure, tag_rows, tag_q1, tag_q2, tag_q3) by merging sketches down to ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(group))
    value = F.when(F.col("bin") == 0, 0.0).otherwise(F.lit(FLOOR) * F.pow(F.lit(GROWTH), F.col("bin") - 0.5))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), value))
    found = ranked.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    return found.toDF(*[f"{tag}_{c}" for c in found.columns])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each language and source: lo_ and hi_ fences of every rate (lo_ of the mean word length only)."""
    used = sketch.where(~(F.col("measure").isin(*RARE) & (F.col("bin") == 0)))
    own, lang, every = _quartiles(used, ["lang", "source"], "o"), _quartiles(used, ["lang"], "l"), _quartiles(used, [], "e")
    names = F.array(*[F.lit(m) for m in (*RATES, *SIZES.values())])
    asked = sketch.select("lang", "source").distinct().withColumn("measure", F.explode(names))
    joined = asked.join(own, (F.col("measure") == F.col("o_measure")) & F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source")), "left")
    joined = joined.join(lang, (F.col("measure") == F.col("l_measure")) & F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(every, F.col("measure") == F.col("e_measure"), "left")
    drawn = lambda rows, q, to: F.when(rows.isNull(), to).otherwise((rows * q + to * PRIOR) / (rows + PRIOR))
    quartile = lambda q: drawn(F.col("o_rows"), F.col(f"o_{q}"), drawn(F.col("l_rows"), F.col(f"l_{q}"), F.col(f"e_{q}")))
    flat = joined.select("lang", "source", "measure", *[quartile(q).alias(q) for q in ("q1", "q2", "q3")])
    of = lambda m: F.max(F.when(F.col("measure") == m, F.struct("q1", "q2", "q3")))
    wide = flat.groupBy("lang", "source").agg(*[of(m).alias(m) for m in (*RATES, *SIZES.values())])
    fences = []
    for m in RATES:
        q1, q2, q3 = (F.col(m)[q] for q in ("q1", "q2", "q3"))
        if m in RARE:  # nothing but zeros anywhere: nothing to judge
            fences.append(F.coalesce(q3 + (q3 - q1) * TAIL, F.lit(1.0)).alias(f"hi_{m}"))
            continue
        noise = F.lit(ODD) / F.col(SIZES[m])["q1"] if m in SIZES else q2 * OFF
        fences.append((q2 + (q2 - q1) * SPREAD + noise).alias(f"hi_{m}"))
        if m not in SIZES:
            fences.append((q2 - (q3 - q2) * SPREAD - noise).alias(f"lo_{m}"))
    return wide.select("lang", "source", *fences)


def _judged(docs: DataFrame, text: str, lang: str, source: str, keep_text: bool = True, passing: bool = False) -> DataFrame:
    """With numbered columns: plus the counts, base_failed and kept.  Texts are measured once, and the counts written beside the row."""
    base = numbered(docs)
    text, lang, source = (place(docs, c) for c in (text, lang, source))
    base = spread(base.withColumn(text, F.col(text).cast("string")), text)
    measured = features(base, text)
    if not keep_text:
        measured = measured.withColumn(text, F.lit(None).cast("string"))
    if passing:
        measured = measured.where(~base_failed())
    measured = written(measured, "measured")
    own = measured.withColumns({"_l": F.col(lang).cast("string"), "_s": F.col(source).cast("string")})
    fences = written(thresholds(written(sketches(own, "_l", "_s"), "sketches", 8)), "fences", 1)
    fences = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    # a group whose rows all fail the base rules has no fences, and needs none
    both = own.join(fences, F.col("_l").eqNullSafe(F.col("_lang")) & F.col("_s").eqNullSafe(F.col("_source")), "left")
    fine = ~base_failed()
    for name, rate in _rates().items():
        fine = fine & (rate <= F.col(f"hi_{name}"))
        if f"lo_{name}" in fences.columns:
            fine = fine & (rate >= F.col(f"lo_{name}"))
    return both.withColumn("base_failed", base_failed()).withColumn("kept", F.coalesce(fine, F.lit(False)))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` plus the measured counts, base_failed and kept.

    Null text fails the base rules (no words).  A null language or source is a
    group of its own.  Ties with a fence are kept.  Repeated rows are judged
    alike and each counts in the sketches.  Whole texts are measured, however
    long.  An empty table gives no rows.  An added name that ``docs`` has already
    gets an underscore at its end.  Without ``keep_text`` the text column comes
    back null, and no copy of the texts is written.
    """
    return named(_judged(docs, text, lang, source, keep_text), docs, [*_NAMES, "base_failed", "kept"])


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    return named(_judged(docs, "text", "lang", "source", passing=True).where("kept"), docs, [])
