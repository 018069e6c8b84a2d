"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm import decontaminate, language_id, near_dup, quality_classifier, quality_rules, sentence_piece, sharding, token_output, toxicity, url_filter
from tarnbeck.llm.oracle import ORACLE_SQL
from tarnbeck.llm.training import remainder

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.MinHash(size=3, percent=85))


def op2_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(remainder("doc_id", 3) != 1), "toxic", at=0.7)
    return _judged(toxicity.score(docs, model), remainder("doc_id", 3) == 1, 0.7)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(remainder("doc_id", 4) != 2))
    return language_id.predict(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.filter(remainder("doc_id", 5) != 0), "quality", at=0.3)
    return _judged(quality_classifier.score(docs, model), remainder("doc_id", 5) == 0, 0.3)


def _judged(scores: DataFrame, held_out, least: float) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_output.read_token_files(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dup, op2_sentence_piece, op3_sharding, op4_toxicity, op5_decontamination, op6_url_filter, op7_quality_rules, op8_language_id, op9_quality_classifier, op10_token_output)
}
__all__ = ["ORACLE_SQL", "QUERIES"]
