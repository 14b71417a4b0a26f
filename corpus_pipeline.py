"""From raw documents to token ids, in five stages.

Every stage takes all rows its predecessor kept and hands on documents with the
same columns; the last one returns the token ids of the texts with their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import importance_resampling, line_dedup, minhash_dedup, piece_bpe, source_mixing
from lectern.llm.models import PIECE_MODEL
from lectern.llm.shared import documents, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws."""
    return importance_resampling.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines of any length out of the texts."""
    return line_dedup.without_boilerplate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near copies: similarity 0.8 or more."""
    return minhash_dedup.deduplicated(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the sources' target weights ask for."""
    return source_mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids to train on."""
    return piece_bpe.encode_documents(docs, PIECE_MODEL, ("ids",))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixing", mixing), ("tokens", tokens)]

#: Word hashing, Gumbel noise, near copies, hashed orders and subword ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over documents, with a written table between stages."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
