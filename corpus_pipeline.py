"""A pipeline from raw documents to token ids: each stage works on what its predecessor kept, and each is written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnbeck.llm import decontaminate, near_dup, quality_classifier, sentence_piece, toxicity
from tarnbeck.llm.store import Store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    This stage and the next three return the columns of documents. Null and empty texts are judged as texts
    without words; very long ones whole; rows with a null doc_id like any other; equal rows go or stay
    together; other columns are handed on, whatever their names; no documents give none.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", at=0.3)
    return quality_classifier.filter_quality(docs, model, 0.3)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic. Null and empty texts have no evidence and stay; the rest as in quality."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", at=0.7)
    return toxicity.filter_toxic(docs, model, 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, similarity 0.8.

    The one with the smallest doc_id stays. Null and empty texts, and rows with a null doc_id, are near
    nothing and stay; rows of one doc_id stay or go together.
    """
    return near_dup.drop_near_duplicates(docs, near_dup.MinHash(size=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or a long part of one. Null and empty texts hold nothing and stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, and decodes them to see that they come back. Null and empty texts have no ids; every row has its own, null doc_ids too."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    return sentence_piece.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=keep)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can express neither the learned models nor the alignments; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
