"""One query per operator: whole tables, production parameters, contract columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trafficlens.llm import byte_bpe, embedding_near_dedup, lm_scoring, mixing, ngram_jaccard, order_minhash, phrases, pii, sharding, token_counts, token_files, toxicity, whitening
from trafficlens.llm.tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_embedding_near_dedup", embedding_near_dedup.ORACLE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup.near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[pii.count_of(F.col("base_spans"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.written_form(F.col("base_spans")), 256).alias("base_sha256"),
        pii.written_form(F.col("spans")).alias("spans"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.round_trip(spark, documents(spark, sf_dir), path, vocabulary=49408)


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


@query("op7_ngram_jaccard", ngram_jaccard.ORACLE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link(documents(spark, sf_dir).select("doc_id", "text"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir).select("doc_id", "text"))


@query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_neighbours(documents(spark, sf_dir))


@query("op10_mixing", mixing.ORACLE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


@query("op13_phrases", phrases.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))
