"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet under the shared folder
and reads it again as the next stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontaminate, langid, mixing, pii, simhash
from riskframe.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language or with an undecided one."""
    return langid.keep_known(docs, folds=5, min_score=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each SimHash group."""
    return simhash.keep_one(docs, shingle_words=4, max_bits=4)


def benchmark_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a 10-word window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), size=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; no document goes, and n_chars follows a changed text."""
    return pii.redact(docs, length_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream: every chosen document with its pass, block and rank in the block."""
    return mixing.mix_sources(docs, budget_ratio=1.0, target_entropy=0.95, max_epochs=4.0, block_tokens=250_000, seed=7,
                              keep=["doc_id", "text", "lang", "source", "n_chars"])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_windows),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL cannot express the trained language stage; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
