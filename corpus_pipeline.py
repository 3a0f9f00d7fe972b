"""From raw documents to token sequences: the training-data pipeline.

Documents that the quality classifier rejects go, then exact copies, then all
but one document of each group of near duplicates, then documents that hold a
benchmark item; what is left is encoded. Every stage reads all that the one
before it kept, and what a stage returns is written and read again before the
next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bpe import encode_documents
from ledgerloom.llm.common import read, stored, tokenizer_file
from ledgerloom.llm.decontaminate import without_contaminated
from ledgerloom.llm.exact_dedup import without_copies
from ledgerloom.llm.ngram_join import one_of_each_group
from ledgerloom.llm.quality import good_rows, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_rows(docs, train(docs, read(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_items),
    ("bpe", tokens),
]

#: The classifier, the edit matching and the tokenizer have no SQL; the tests
#: hold the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
