"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, sampled pieces.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's docs; all but
the last return the columns of ``documents``.

Every stage takes null and empty texts (as texts without words), very long texts, null and repeated doc_ids, repeated rows, empty tables and further
columns under any name; what it does with them is in its function's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bagminhash, decontaminate, pii, piece_sampling, toxicity
from tessera.llm.common import discard, documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; learns from the labels of the documents it is given. Null and empty texts score as texts without toxic
    passages, so they stay; repeated rows all stay or all go; without labels of both kinds nothing goes."""
    return toxicity.keep_clean(docs, documents(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of least doc_id (null last), then of least digest of the text. Null and empty texts are one
    class; of repeated rows one stays."""
    return bagminhash.keep_one(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out of the texts; documents that are mostly such passages dropped. Texts without words, null ones too, stay as they are."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with [KIND] in place of personal data; null and empty texts as they are, n_chars follows the text."""
    return pii.redact(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A report for each row; null and empty texts have no pieces."""
    return piece_sampling.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("pieces", sample_pieces),
]

#: No stage but the third can be put in SQL; tests/llm/test_pipeline.py holds the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(spark, stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
