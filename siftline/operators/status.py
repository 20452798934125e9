"""What an index holds, as one row, and how far its build is."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.formats import human_bytes, human_count
from siftline.operators.index import Index


def status(index: Index, root: str = "", state: str = "ready") -> DataFrame:
    """root, state, files, trigrams, postings, bytes and their short forms."""
    size = index.files.filter("live").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    return index.stats().withColumn("bytes", F.lit(size).cast("long")).select(
        F.lit(root).alias("root"), F.lit(state).alias("state"), "files", "trigrams", "postings", "bytes",
        human_count(F.col("files")).alias("files_short"), human_count(F.col("trigrams")).alias("trigrams_short"), human_bytes(F.col("bytes")).alias("bytes_short"),
    )


class Progress:
    """Files of a corpus that a build has read, counted by an accumulator as tasks end.

    A task that runs again counts again, so the count is held at the total.
    """

    def __init__(self, files: DataFrame):
        self.files, self.total = files, files.count()
        self.done = files.sparkSession.sparkContext.accumulator(0)

    def counted(self) -> DataFrame:
        """The files, counted as they are read."""
        done = self.done

        def count(batches):
            for batch in batches:
                done.add(batch.num_rows)
                yield batch

        return self.files.mapInArrow(count, self.files.schema)

    def told(self) -> tuple[int, int]:
        """Files read so far, and all."""
        return min(self.done.value, self.total), self.total


def follow(told: Callable[[], object], seconds: float = 0.25, until: Callable[[], bool] = lambda: False, clock=time.sleep) -> Iterator[object]:
    """What ``told`` tells, at once and then whenever it has changed, asked every so many seconds until ``until`` holds."""
    last = object()
    while True:
        ends = until()
        now = told()
        if now != last:
            yield now
            last = now
        if ends:
            return
        clock(seconds)
