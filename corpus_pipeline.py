"""The corpus pipeline over the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. Their decisions take effect: rejected documents and copies are
gone, secrets are masked, rows are repeated as often as the mix takes them.
Stages read every column of ``docs`` by name and pass the others on as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, rule_ensemble, secrets_crf, sentencepiece_codec, simhash
from palimpsest.llm._shared import fresh_name, materialize, ship, table

#: Score from which the classifier takes a document for good.
ACCEPT = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A null or empty text gets the score
    of an empty text; with no labels of both kinds the share of good ones decides."""
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh_name(docs.columns, "score")
    scored = rule_ensemble.score_documents(docs, model, into=score)
    return scored.filter(F.col(score) >= ACCEPT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    ship(spark)
    return simhash.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars set anew; clean texts as they were."""
    ship(spark)
    return secrets_crf.redact(docs, length_col="n_chars")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources near their targets."""
    ship(spark)
    return mixing.mixed(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    ship(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", "lang", "source", sentencepiece_codec.checked_column(F.col("text"), path).alias("x"))
    return rows.select("doc_id", "lang", "source", F.size("x.ids").cast("long").alias("n_tokens"), "x.ids", "x.round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: SQL cannot express the trained stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
