"""An index that follows a folder or a stream of listings."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.segments import StoredIndex
from siftline.sources.corpus import Corpus
from siftline.sources.datasource import register


def bring_up_to_date(spark: SparkSession, path: str, corpus: Corpus) -> int:
    """Add what a corpus has new, changed or removed to the index in ``path``, then merge if that is due; how many files differed.

    Without an index one is built. What is written grows with the changes, and searches
    of the version before go on undisturbed.
    """
    try:
        index = StoredIndex.open(spark, path)
    except ValueError:
        return StoredIndex.build(corpus, path).live_files
    diff = index.reconcile(corpus.files).persist()
    try:
        n = diff.count()
        if n:
            index.apply(diff, corpus).merged()
        return n
    finally:
        diff.unpersist()


def follow(listings: DataFrame, index_path: str, corpus_of: Callable[[SparkSession], Corpus], checkpoint: str, seconds: float = 0.3) -> StreamingQuery:
    """Run ``bring_up_to_date`` after every batch of a stream of listings.

    Only the latest state counts, so late and repeated batches do no harm: each
    batch compares the corpus as it is now with the stored index.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            bring_up_to_date(batch.sparkSession, index_path, corpus_of(batch.sparkSession))

    return listings.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def folder_listings(spark: SparkSession, root: str, hidden: bool = False, no_ignore: bool = False) -> DataFrame:
    """A stream of a folder's listings."""
    register(spark)
    return spark.readStream.format("siftline_listing").options(path=os.path.abspath(root), hidden=str(hidden).lower(), noIgnore=str(no_ignore).lower()).load()


def matches_of_stream(documents: DataFrame, java_pattern: str, id: str, text: str) -> DataFrame:
    """(file_id, line_no, line) of a stream of documents: a stateless search that any sink can take."""
    lines = documents.select(F.col(id).alias("file_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return lines.filter(F.col("line").rlike(java_pattern)).select("file_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
