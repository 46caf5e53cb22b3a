"""Corpus cleaning in stages, each written as Parquet and reread as the next one's documents.

Null and empty texts fail the quality rules; a stage that meets them leaves them alone otherwise. Repeated rows stay
repeated until near duplicates, where rows with one doc_id stay or go together. Very long texts are judged whole. Empty
tables stay empty. Other columns, whatever their names, pass through as they are, but for n_chars.
"""

from __future__ import annotations

from lumenframe.llm import bpe, decontamination, jaccard_join, line_dedup, quality
from lumenframe.llm.common import Table


def quality_rules(spark, docs, sf_dir):
    """Rejected documents go; the lines that failed go from the others."""
    return quality.clean_documents(docs)


def repeated_lines(spark, docs, sf_dir):
    """Lines found in five documents or more stay only in the one with the largest doc_id."""
    return line_dedup.clean_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of each group linked by five-word shingles at a similarity of 0.8, the smallest doc_id stays."""
    return jaccard_join.one_per_group(docs, n=5, percent=80)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark, docs, sf_dir):
    """The ids of what is left."""
    return bpe.digests(bpe.encode_documents(docs.select("doc_id", "text")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]
#: Similarity, alignment and BPE aren't expressible in SQL; a brute-force version in the tests stands for it.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = Table(docs, f"pipeline-{k}").read()
    return docs
