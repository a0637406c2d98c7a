"""Five stages over a corpus: quality, exact dedup, near dedup, decontamination, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents, and the last adds domain, tokens and epoch. Every stage gives
an empty table for an empty one.
"""

from __future__ import annotations

from chipmeter.llm import decontam, exact_dedup, mixing, quality, simhash
from chipmeter.llm.common import materialise


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go; it learns labels from the rows that are not held out.

    Rows with equal texts stay or go together. Null and empty texts are judged as texts without features.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels, ~quality.held_out()))


def drop_exact_copies(spark, docs, sf_dir):
    """Of texts that are equal without white space the longest stays, then the smallest doc_id (null ids last), then one of equal rows.

    Null texts count as empty.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of each component of near copies (5-word shingles, Jaccard 0.8 or more) the document with the smallest doc_id stays, null ids last.

    Pairs are found by operator 8's fingerprint search and, beyond its radius, by MinHash bands; whole texts decide.
    Null texts count as empty, texts without words are copies of each other, and of repeated rows one stays.
    """
    return simhash.deduplicate(docs, similarity=0.8)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a window of 10 words of a benchmark item go, or all words of a shorter item. Null and empty texts stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    """Documents of each source by weight, some in several epochs or none. Texts without words (null, empty) are never taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, which SQL cannot express; tests/llm compares the rest with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
