"""One query per operator, over whole tables, with the parameters meant for production."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from answerlab.llm import (
    bpe,
    centroids,
    chat,
    jaccard,
    langid,
    leaks,
    lm,
    periods,
    quality,
    rans,
    recompress,
    suffixes,
    urls,
)
from answerlab.session import shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rules of the url query, as given.
URL_RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]


def _fold(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """Adds ``learn``: whether crc32 of the id as text does not leave ``fold``; a null id is learned from."""
    out = F.crc32(F.col("doc_id").cast("string")) % folds == fold
    return docs.withColumn("learn", ~F.coalesce(out, F.lit(False)))


def op1_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_near(_table(spark, folder, "documents"))


def op2_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return lm.score_documents(_fold(docs, 7, 2), "learn")


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = chat.calls_from_turns(_table(spark, folder, "conversations"))
    return chat.link_turns(calls, results, chat.TOOLS)


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    path = f"{shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    rans.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return rans.read_ids(spark, path)


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.predict(_fold(docs, 3, 1), "learn")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return bpe.digest_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, vocabulary = _table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    return quality.score_learned(docs, _table(spark, folder, "labels"), vocabulary)


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), URL_RULES)


def op9_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digest_repeats(_table(spark, folder, "documents"))


def op10_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_recompression(spark: SparkSession, folder: str) -> DataFrame:
    return recompress.digest_copies(_table(spark, folder, "documents"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, folder, "embeddings")).drop("centroid")


def op13_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digest_runs(periods.plant_periods(_table(spark, folder, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_lm": op2_lm,
    "op3_chat": op3_chat,
    "op4_token_files": op4_token_files,
    "op5_language": op5_language,
    "op6_bpe": op6_bpe,
    "op7_quality": op7_quality,
    "op8_urls": op8_urls,
    "op9_suffixes": op9_suffixes,
    "op10_leaks": op10_leaks,
    "op11_recompression": op11_recompression,
    "op12_centroids": op12_centroids,
    "op13_periods": op13_periods,
}

ORACLE: dict[str, str] = {
    "op1_jaccard": jaccard.ORACLE_SQL,
    "op3_chat": chat.ORACLE_SQL,
    "op10_leaks": leaks.ORACLE_SQL,
    "op11_recompression": recompress.ORACLE_SQL,
    "op12_centroids": centroids.ORACLE_SQL,
    "op13_periods": periods.ORACLE_SQL,
}
