"""Arrow batches of bounded size on their way to and from Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let no Arrow batch that goes to a Python worker hold much more than ``most`` bytes, however long its texts are.

    The session's own limit is lowered, never raised.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def _bytes(setting: str) -> int:
    unit = setting[-1].lower()
    return int(setting[:-1]) * {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit] if unit.isalpha() else int(setting)


def stretches(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of rows of about ``most`` bytes in all; a larger row is alone in its slice."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(start, end)
        start = end
