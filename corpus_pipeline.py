"""The corpus pipeline: from raw documents to packed token sequences.

Every stage works on all rows its predecessor kept and returns the columns of
documents; the last one returns packed pieces. Rows are told apart by id and text, so
missing and repeated ids are safe; a row that repeats both is a copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmosaic.llm import decontaminate, jaccard, packing, pii, quality
from fieldmosaic.llm.frames import in_fold, table, written

#: Shingle words and similarity percent of near duplicates.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; learned from this stage's own input."""
    network = quality.train(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 4, 2))
    return quality.accepted(docs, network)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates; ``n_chars`` follows the text."""
    replaced = pii.pseudonymise(docs, pii.DEMO_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else replaced


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", clean_of_benchmarks),
    ("PII", without_personal_data),
    ("packing", packed),
]

# A learned network, graph components and a subword vocabulary have no SQL form;
# tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
    return docs
