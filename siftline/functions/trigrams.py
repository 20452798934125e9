"""Byte trigrams of texts: the numpy extraction of the index and the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.batches import small_batches

#: Bytes at the head of a file in which a NUL makes it binary.
BINARY_WINDOW = 1024


def distinct(raw: bytes) -> np.ndarray:
    """The distinct trigrams of a byte string, sorted."""
    b = np.frombuffer(raw, np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


def postings(files: DataFrame) -> DataFrame:
    """(tri, file_id) for every distinct trigram of every file that is not binary; ``files`` has file_id, text, is_binary."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column(1), batch.column(0).to_numpy()
            found = [distinct(x.as_py() or b"") for x in column]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            tri = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tri, pa.int32()), pa.array(np.repeat(ids, counts), pa.int64())], ["tri", "file_id"])

    small_batches(files.sparkSession)
    return files.filter(~F.col("is_binary")).select("file_id", F.col("text").cast("binary").alias("raw")).mapInArrow(extract, "tri int, file_id long")


def trigrams(text: Column) -> Column:
    """All trigrams of a text in order, as an array<int>, by built-in functions."""
    raw = F.hex(text.cast("binary"))
    n = F.octet_length(text) - 2
    each = lambda i: F.conv(F.substr(raw, i * 2 - 1, F.lit(6)), 16, 10).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), each)).otherwise(F.array().cast("array<int>"))


def is_binary(text: Column) -> Column:
    """Whether a NUL stands in the first bytes."""
    return F.coalesce(F.instr(F.substring(text.cast("binary"), 1, BINARY_WINDOW).cast("string"), "\0") > 0, F.lit(False))
