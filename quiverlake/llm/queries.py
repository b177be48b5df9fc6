"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .ann import neighbours
from .html_text import extracted
from .mixing import rates
from .ngram_jaccard import ngram_jaccard
from .packing import packed
from .quality import judged
from .sql import SQL  # noqa: F401
from .store import new_folder, table, written
from .substring_dedup import deduplicated
from .token_counts import TokenRollup, deletes, document_counts, inserts, revisions
from .toxicity import fit, scored
from .warc import archived


def op1_mix_sources(spark, sf_dir):
    taken = rates(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters", "base_failed", "kept")


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_sentences", "n_removed", "words_removed")


def op5_html_text(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op8_best_fit_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    """All documents are counted and inserted; those labelled of low quality are deleted, those labelled toxic withheld (counted as 0); then a batch comes again."""
    counts = written(document_counts(table(spark, sf_dir, "documents")), "counts")
    # a document with several labels goes by the least of them
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l")).select("doc_id", "l.quality", "l.toxic")
    rollup = TokenRollup(spark, new_folder(spark, "rollup"))
    rollup.apply("inserts", inserts(counts))
    marked = counts.join(labels, "doc_id")
    for _ in range(2):
        rollup.apply("deletes", deletes(marked.where("quality = 0")))
    rollup.apply("revisions", revisions(marked.where("quality = 1 and toxic = 1").withColumn("revised", F.lit(0))))
    return rollup.totals()


def op10_warc(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_ngram_jaccard, op4_substring_dedup, op5_html_text, op6_toxicity, op7_ann, op8_best_fit_packing, op9_token_counts, op10_warc)}
