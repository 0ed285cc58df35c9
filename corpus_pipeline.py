"""Corpus pipeline: quality filter, near-duplicate and repeat removal, decontamination, tokenising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vexel.llm import bpe, common, decontam, quality, simhash, suffix
from vexel.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that documents with smaller ids have, too, go."""
    return suffix.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of what is left."""
    return bpe.encoded(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: The stages are a trained classifier, XXH64 fingerprints, byte strings and a tokenizer, none of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to the documents in turn; each result is stored as Parquet and reread as the next one's input.
    What a stage and the one before it stored for themselves is dropped once its result is stored."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scope():
        for _, stage in STAGES[:-1]:
            path = common.shared_dir(spark)
            docs = common.stored(stage(spark, docs, sf_dir), path)
            common.release(spark, keep=path)
        return STAGES[-1][1](spark, docs, sf_dir)
