"""Raw documents to training tokens: five stages, each one operator.

Toxic documents go, one document of each group of near copies stays, personal data is
masked, sources are mixed to their weights (a document stands there as often as it is
taken), and the texts become token ids, checked by decoding them. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trafficlens.llm import byte_bpe, mixing, ngram_jaccard, pii, toxicity
from trafficlens.llm.tables import documents
from trafficlens.session import written


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, "__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.TOXIC).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", harmless),
    ("ngram_jaccard", distinct),
    ("pii", masked),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: A learned model and the merges of a vocabulary are beyond SQL; tests/llm holds the
#: pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
