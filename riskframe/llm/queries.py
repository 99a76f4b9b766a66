"""Registered queries of this package: thin bindings of the operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontaminate, lexical, mixing, warc
from .ann import nearest
from .common import table
from .decontaminate import contamination
from .langid import language_report
from .lexical import lexical_search
from .licenses import license_scan
from .lm import lm_scores
from .mixing import mix_sources
from .pages import main_texts
from .pii import pii_report
from .quality import quality_scores
from .simhash import simhash_dedup
from .warc import archived
from .whitening import whitened


def op1_adsampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10, probe_share=0.6)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii_report(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files of a tree: source, thousands and hundreds of the id are the folders, and
    documents of fewer than 60 words stand for the licence files of their folder."""
    docs = table(spark, sf_dir, "documents")
    short = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) < 60
    name = F.concat(F.when(short, F.lit("LICENSE-")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.expr("doc_id div 1000").cast("string"),
                       F.expr("doc_id div 100").cast("string"), name)
    return license_scan(docs.select("doc_id", "text", path.alias("path")), "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: 95 % of the greatest entropy, at most 4 passes, as many tokens as there are."""
    return mix_sources(table(spark, sf_dir, "documents"), budget_ratio=1.0, target_entropy=0.95, max_epochs=4.0,
                       block_tokens=250_000, seed=7)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified Kneser-Ney scores of all whole texts; one tenth of the documents is held out of the training."""
    return lm_scores(table(spark, sf_dir, "documents"), folds=10)


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document, learned from the labels outside one fifth of the documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, threshold=0.3)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned outside one fifth of the documents."""
    return language_report(table(spark, sf_dir, "documents"), folds=5)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-word windows of benchmark items in every whole document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: 4-word shingles, at most 4 differing bits, over all whole documents."""
    return simhash_dedup(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whitened on the 16 strongest components of all distinct vectors."""
    return whitened(table(spark, sf_dir, "embeddings"), components=16)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive on the shared folder and read back."""
    return archived(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), min_revisit_bytes=0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adsampling": op1_adsampling,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_mixing": op4_mixing,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_page_text": op6_page_text,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
