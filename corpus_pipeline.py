"""The corpus pipeline: five operators of the llm subpackage, one after the other, over `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, exact_dedup, jaccard_join, piece_codec, toxicity
from quire.llm.shared import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labels of documents that are still there."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity from 0.8 on) the document with the smallest doc_id stays."""
    return jaccard_join.drop_near_copies(docs, words=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items, and short items as a whole, go from the texts, and documents that are mostly such passages; n_chars follows the text."""
    out = decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), short_items=True)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return piece_codec.encode_decode(docs, "piece_bpe_32k.model", output=("ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("SentencePiece encoding", encode),
]

#: SQL can't express the trained classifier of the first stage; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written as Parquet to the shared folder and read again as the next one's documents."""
    docs, at = table(spark, sf_dir, "documents").select(*COLUMNS), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return made
        made.write.parquet(f"{at}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{at}/{k}")
    return docs
