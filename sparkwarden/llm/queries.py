"""Registered queries of the training-data operators, with production parameters, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import conversations, embeddings, languages, manifest, mixing, packing, quality, scoring, simhash, substrings, token_counts, token_store, urls
from sparkwarden.llm.common import scratch_path
from sparkwarden.llm.oracles import ORACLES

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the vocabulary file lies, on every machine."""
    return public_tokenizers.path(TOKENIZER)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to a store and found again through its index."""
    return token_store.stored_ids(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urls.judged(_table(spark, sf_dir, "pages"))


def op3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    return languages.predicted(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and weak-supervision verdict of every document."""
    found = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of every vector."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    found = mixing.copies(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated strings of 100 bytes takes from every document."""
    found = substrings.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, most=4)


def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model log-probability of every document, learned from nine tenths of them."""
    docs = _table(spark, sf_dir, "documents")
    return scoring.scored(docs.select("doc_id", languages.held_out(F.col("doc_id"), 10, 0).alias("held_out"), "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, from a cache that starts empty: every different text is encoded once."""
    return token_counts.counted(_table(spark, sf_dir, "documents"), tokenizer_path(), scratch_path(spark, "token-cache"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, half of them checked with a text that lost its line feeds."""
    docs = _table(spark, sf_dir, "documents")
    return manifest.verified(docs, manifest.even(F.col("doc_id")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage of the contract."""
    conversation = _table(spark, sf_dir, "conversations")
    return conversations.assessed(conversations.damaged(conversation), conversation)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_url_filters": op2_url_filters,
    "op3_languages": op3_languages,
    "op4_quality_rules": op4_quality_rules,
    "op5_embeddings": op5_embeddings,
    "op6_mixing": op6_mixing,
    "op7_substrings": op7_substrings,
    "op8_simhash": op8_simhash,
    "op9_scoring": op9_scoring,
    "op10_packing": op10_packing,
    "op11_token_counts": op11_token_counts,
    "op12_manifest": op12_manifest,
    "op13_conversations": op13_conversations,
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
