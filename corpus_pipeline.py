"""The corpus pipeline: language, toxicity, repeated lines, near duplicates, packing.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before
kept, and all but the last return the columns of documents, whatever further ones
there are. ``run`` writes each stage as Parquet to the session's shared checkpoint
folder and rereads it. An empty table, or one that a stage left empty, gives an
empty table of the same columns. A model lives as long as its stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import language_id, line_dedup, packing, simhash, toxicity
from siftline.llm.common import cut, shared_checkpoints, table, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without letters and those in none of them go.

    Null and empty texts go. Repeated rows stay or go alike, and rows without doc_id
    are judged like others. Without any labelled text no language is known and all go.
    """
    return language_id.known_language(docs, language_id.fit(language_id.learnable(docs)))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity.

    Null and empty texts score as texts without letters; repeated rows stay or go
    alike. Without labels of both kinds nothing can be learned and all stay.
    """
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.harmless(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each repeated multi-line chunk or pair of lines in one of them only; n_chars follows the text.

    Null texts stay null (n_chars too), empty ones empty. Rows that share a doc_id are
    one document; rows without one keep what stands in others and lose their own
    later repeats.
    """
    # pairs first: a chunk that goes would leave the rest of its passage as lone lines
    out = line_dedup.dedup_lines(cut(line_dedup.dedup_pairs(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by op10's figures (three words, three bits).

    Null and empty texts are near duplicates of each other. Rows of one doc_id are told
    apart by their texts; rows without doc_id stay.
    """
    return simhash.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 1024 tokens.

    Null and empty texts are the end id alone; repeated rows are documents of their own.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", known_language),
    ("toxicity", harmless),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("packing", packed),
]

#: The models, the fingerprints' hash and the packing are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
