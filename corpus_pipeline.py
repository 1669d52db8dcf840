"""Corpus pipeline: quality classifier, line dedup, near-duplicate join, secret masking, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the
stage before it kept.  Between stages the documents are written to the shared
checkpoint folder and read back, so a lost executor never reaches further back
than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emporia.llm import best_fit_packing, line_dedup, ngram_join, quality_resampling, secret_scan
from emporia.llm.scratch import stored, table

STAGES = [
    ("quality_classifier", quality_resampling.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("secret_scan", secret_scan.stage),
    ("best_fit_packing", best_fit_packing.stage),
]

#: SQL cannot express the classifier, the randomness battery's masking and the packing; tests/llm compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all kept documents in sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
