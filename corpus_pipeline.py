"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows as Parquet in
the shared folder and gives them to the next. All but the last return the columns of documents.

Rows that a stage returns are made when the caller writes them. So a stage whose last pass is in Python lowers
the session's bound on Arrow batches to BATCH and leaves it there; run() sets it back at its end.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from answerlab.llm import bpe, jaccard, leaks, quality, suffixes
from answerlab.session import BATCH_BYTES, arrow_batches, shared_folder

#: Bytes of an Arrow batch. By 10 000 rows alone a batch is tens of MB, in the executor and in each worker.
BATCH = 4 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by bands learned from the labels where there are any."""
    spark.conf.set(BATCH_BYTES, str(BATCH))
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    try:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return quality.keep_good(docs, vocabulary)
    return quality.keep_good(docs, vocabulary, labels=labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return jaccard.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur elsewhere too; n_chars is renewed."""
    spark.conf.set(BATCH_BYTES, str(BATCH))
    return suffixes.remove_repeats(docs, n_chars="n_chars")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, in the column ids; ids_, ids__, ... where there is one already."""
    spark.conf.set(BATCH_BYTES, str(BATCH))
    name = "ids"
    while name in docs.columns:
        name += "_"
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=list(docs.columns), ids=name)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("encoded", encoded),
]

#: Subword tokens, sampled joins and byte-wise suffixes have no SQL twin; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrow_batches(spark, BATCH):
        for name, stage in STAGES:
            path = f"{shared_folder(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
