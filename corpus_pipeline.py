"""The corpus pipeline: documents through five stages of the training-data operators.

Every stage but the last returns the columns of ``documents`` and works on all
rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.bpe import default_tokenizer, encode_documents
from tesserae.llm.common import materialise, small_batches, table
from tesserae.llm.exact_dedup import drop_exact
from tesserae.llm.jaccard import drop_near
from tesserae.llm.mixing import mix_documents
from tesserae.llm.quality import rate, train


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; it learns from the labels of this input's documents."""
    small_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return rate(docs, model).where("selected").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    small_batches(spark)
    return drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return drop_near(docs, width=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated by epochs, the last one of a source cut to its budget."""
    return mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of the mix."""
    small_batches(spark)
    return encode_documents(docs, default_tokenizer())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mix_stage),
    ("BPE encoding and decoding", bpe_stage),
]
#: A trained classifier, hashes as random keys and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs, f"stage{number}")
    return docs
