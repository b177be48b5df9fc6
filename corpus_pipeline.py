"""From raw documents to packed training sequences, by five of the operators.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` writes each stage's rows and reads them again
as the next one's input, so a lost executor never reaches further back.
"""

from __future__ import annotations

from quiverlake.llm.mixing import mix
from quiverlake.llm.ngram_jaccard import near_representatives
from quiverlake.llm.packing import packed
from quiverlake.llm.quality import quality_filter
from quiverlake.llm.store import table, written
from quiverlake.llm.substring_dedup import without_repeats


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rules or their group's fences go."""
    return quality_filter(docs)


def ngram_jaccard_join(spark, docs, sf_dir):
    """Of each group of near copies the document with the smallest id stays."""
    return near_representatives(docs)


def substring_dedup(spark, docs, sf_dir):
    """Sentences of repeated spans go from all texts but the first; a document left without text goes."""
    return without_repeats(docs)


def mix_sources(spark, docs, sf_dir):
    """Rows come as often as the mix takes them."""
    return mix(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Pieces with their sequence and offset, one row each."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Word windows, near copies and byte-pair tokens are beyond SQL; a brute-force version checks the rows in the tests.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
