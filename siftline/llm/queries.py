"""The operators' queries over the tables of a folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, dominance, exact_dedup, graph_search, language_id, packing, pii, secret_scan, sharding, simhash, token_count, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(_table(spark, sf_dir, "documents")).drop("n_chunks")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    words = secret_scan.vocabulary_words(_tokenizer("word_bpe_49k.json")), secret_scan.learned_words(docs)
    return secret_scan.scan(docs, words)


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(_table(spark, sf_dir, "embeddings"))


def above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.sales_above(_table(spark, sf_dir, "sales"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact,
    "op2_token_counts": tokens,
    "op3_toxicity": toxic,
    "op4_packing": packed,
    "op5_simhash": near,
    "op6_sharding": shards,
    "op7_decontamination": leaked,
    "op8_language_id": languages,
    "op9_secret_scan": secrets,
    "op10_pii": personal,
    "op11_divergence": divergences,
    "op12_neighbours": neighbours,
    "op13_dominance": above,
}

#: The others can't be said in SQL; they are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": exact_dedup.ORACLE, "op11_divergence": divergence.ORACLE, "op13_dominance": dominance.ORACLE}
