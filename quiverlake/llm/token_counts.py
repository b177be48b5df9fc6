"""Token counts as delta-maintained rollups (operator 9).

Totals by source, language and tokenizer version are sums of signed deltas: an
insert adds a document and its tokens, a delete takes both away, a revision
adds the difference.  A batch is aggregated, written to a staging folder and
committed by one atomic rename to its id; a batch whose id is committed already
changes nothing, so a batch may be sent again after any failure.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Words, buffers, chunks
from .store import hadoop_path, spread, text_batches
from .tokens import BYTE_BPE, encoder

KEYS = ["source", "lang", "version"]
WORDS = "words"
_DELTA = "source string, lang string, version string, documents long, tokens long"


def _counts(versions: tuple[str, ...]):
    def run(batches):
        encoders = {v: encoder(v) for v in versions if v != WORDS}
        for batch in batches:
            cols = []
            for v in versions:
                if v == WORDS:
                    raw, at = buffers(batch.column(3))
                    cols.append(pa.array([int(c) for _, part, own in chunks(raw, at) for c in Words(part, own).counts], pa.int64()))
                else:
                    cols.append(pa.array([len(encoders[v](t.as_py() or "")) for t in batch.column(3)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["doc_id", "source", "lang", *[f"n{i}" for i in range(len(cols))]])

    return run


def document_counts(docs: DataFrame, versions: tuple[str, ...] = (WORDS, BYTE_BPE)) -> DataFrame:
    """(doc_id, source, lang, version, tokens): a row for each document and tokenizer version.

    Null text: 0 tokens.  Whole texts are counted, however long; repeated rows
    each count.  An empty table gives no rows.  Other columns are not read, so
    their names cannot clash.
    """
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    wide = spread(narrow, "doc_id", "text").mapInArrow(_counts(tuple(versions)), "doc_id long, source string, lang string, " + ", ".join(f"n{i} long" for i in range(len(versions))))
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"n{i}").alias("tokens")) for i, v in enumerate(versions)]))
    return wide.select("doc_id", "source", "lang", each.alias("x")).select("doc_id", "source", "lang", "x.version", "x.tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(counts: DataFrame, now: str = "revised") -> DataFrame:
    """``counts`` with the old number in tokens and the new one in ``now``."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("documents"), (F.col(now) - F.col("tokens")).cast("long").alias("tokens"))


class TokenRollup:
    """Totals in a folder that all machines share.  One writer at a time; readers see whole batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for part in ("batches", "staging", "base"):
            fs, p = hadoop_path(spark, f"{self.root}/{part}")
            fs.mkdirs(p)

    def _names(self, part: str) -> list[str]:
        fs, p = hadoop_path(self.spark, f"{self.root}/{part}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def committed(self) -> set[str]:
        return set(self._names("batches")) | set(self._base()[1])

    def _base(self) -> tuple[str | None, list[str]]:
        """The newest merged totals and the batches in them."""
        names = [n for n in self._names("base") if n.startswith("v")]
        if not names:
            return None, []
        at = f"{self.root}/base/{names[-1]}"
        meta = "".join(r.value for r in self.spark.read.text(f"{at}/batches.json").collect())
        return f"{at}/totals", json.loads(meta)

    def _move(self, source: str, target: str) -> bool:
        """Atomic; False if the target is there already."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        _, a = hadoop_path(self.spark, source)
        fs, b = hadoop_path(self.spark, target)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(a, b, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(b):
                return False
            raise
        return True

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Commits a batch of signed deltas (source, lang, version, documents, tokens); False if it is committed already.

        Null keys are groups of their own; an empty batch commits and adds nothing.
        """
        if not batch_id or "/" in batch_id or batch_id[0] in "._":
            raise ValueError(f"{batch_id!r} can't name a batch")
        if batch_id in self.committed():
            return False
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(staged)
        return self._move(staged, f"{self.root}/batches/{batch_id}")

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens); groups that came to nothing are left out."""
        base, merged = self._base()
        paths = [f"{self.root}/batches/{n}" for n in self._names("batches") if n not in set(merged)] + ([base] if base else [])
        if not paths:
            return self.spark.createDataFrame([], _DELTA)
        sums = self.spark.read.schema(_DELTA).parquet(*paths).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Merges the committed batches, so that totals() reads one table again; ids stay known."""
        names = sorted(self.committed())
        version = f"v{len([n for n in self._names('base') if n.startswith('v')]):08d}"
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.text(f"{staged}/batches.json")
        if self._move(staged, f"{self.root}/base/{version}"):
            for n in self._names("batches"):
                if n in names:
                    fs, p = hadoop_path(self.spark, f"{self.root}/batches/{n}")
                    fs.delete(p, True)
