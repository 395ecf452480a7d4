"""A corpus pipeline: stages that each apply one operator to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from tallyweave.llm import jaccard, mixing, packing, quality, secrets
from tallyweave.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more, so none without words; the model is trained on ``labels``."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="quality_score").where("quality_score >= 0.5").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows without an id stay, as they link with nothing. Of rows that repeat an id,
    one row stays (the least text).
    """
    found = jaccard.jaccard_components(docs.select("doc_id", "text"))
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    held = docs.join(first, "doc_id", "left_semi")  # the one shuffle of texts: rows of an id then stand together
    least = held.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return least.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by a mark; n_chars is counted anew where that happened."""
    found = secrets.scan(docs.select(*COLUMNS))
    clean = found.withColumn("clean", secrets.redact(found)).withColumn("hit", F.size("secret_spans") > 0)
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source",
                        F.when(F.col("hit"), F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in a global random order."""
    return mixing.mix(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, in the order that mixing left."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("secret scans", redacted),
    ("mixing", mixed),
    ("packing", packed),
]

#: Packing runs a tokenizer, which SQL cannot express; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
