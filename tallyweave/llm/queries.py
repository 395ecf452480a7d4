"""The queries opN_<name> and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import alignment, conversations, embeddings, exact, jaccard, media, mixing, packing, quality, repeats, secrets, sharding, token_counts
from tallyweave.llm.common import table

#: The folder of the tokenizer files is a parameter of the operators; the queries take the installed one.
WORD_BPE, PIECE_BPE, BYTE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op1(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.texts_as_images(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_dedup(table(spark, sf_dir, "embeddings"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(PIECE_BPE)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op11(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op12(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_media_columns, op3_substring_dedup, op4_packing, op5_quality_knn, op6_hash_tree_sharding, op7_embedding_near_dedup, op8_poisson_mixing, op9_ngram_jaccard_join, op10_token_counts, op11_tokenizer_alignment, op12_conversation_repair, op13_exact_dedup)
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.op1_sql(),
    "op6_hash_tree_sharding": sharding.op6_sql(),
    "op8_poisson_mixing": mixing.op8_sql(),
    "op12_conversation_repair": conversations.op12_sql(),
    "op13_exact_dedup": exact.op13_sql(),
}
