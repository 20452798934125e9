"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.batches import BATCH_BYTES, small_batches  # noqa: F401

#: Characters of text that a Python worker splits into words at a time.
CHARS_AT_ONCE = 3_000_000
#: Entries of a Python worker's memo of words; it is emptied when full.
MEMO_ENTRIES = 400_000
#: Short rows of a file of a checkpoint.
FILE_ROWS = 500_000
#: Classes of a sample that are broadcast.
CLASSES_AT_ONCE = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; set a folder only where none is set, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="siftline-"))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    If it has ``rows`` short rows at most, these are dealt out, after the work that makes
    them, into a file for each FILE_ROWS: a checkpoint writes a file for every partition,
    empty ones too.
    """
    shared_checkpoints(df.sparkSession)
    return (df if rows is None else df.repartition(rows // FILE_ROWS + 1)).checkpoint(eager=True)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the column's decimal text, modulo ``m``; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def runs(texts: list, most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Half-open ranges of ``texts`` of about ``most`` characters; a longer text is alone in its range."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def hash_unit(column: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the column's value and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 53)) / F.lit(float(1 << 53))


#: Rows of one key that a join leaves in one part, and keys of more rows that are broadcast at most.
PART_ROWS, HOT_KEYS = 100_000, 10_000


def join_split(left: DataFrame, right: DataFrame, on: list[str], times: str, total: int, how: str = "inner", written: bool = False) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique, so that no key of many rows of ``left`` meets in one task.

    Column ``times`` of ``right`` tells how many rows of ``left`` have a key, ``total`` how
    many there are in all. A key of more than PART_ROWS rows, or of a HOT_KEYS-th of
    all if that is more, is dealt into parts; of such keys there are HOT_KEYS at most,
    so they can be broadcast. A row's part follows from a hash of the row, so that a task
    that runs again deals alike; of a ``written`` table, from its place, so that equal
    rows are dealt out too.
    """
    each = max(PART_ROWS, total // HOT_KEYS + 1)
    parts = F.ceil(F.col(times) / F.lit(each)).cast("int")
    hot = right.filter(F.col(times) > each).select(*on, parts.alias("__parts"))
    if not hot.limit(1).count():
        return left.join(right, on, how)
    row = F.monotonically_increasing_id() if written else F.xxhash64(*left.columns)
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("__part", F.coalesce(F.pmod(row, F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    spread = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(spread, [*on, "__part"], how).drop("__part")


def sample_per_class(df: DataFrame, label: str, each: int, seed: int = 0) -> DataFrame:
    """About ``each`` distinct rows of every value of ``label``, chosen by a hash of the whole row.

    A class of n rows keeps those whose hash is below each / n, so no class has to
    meet in one task; equal rows count once. Counts come from all rows. The classes
    are broadcast only if there are few of them.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    if counts.limit(CLASSES_AT_ONCE + 1).count() <= CLASSES_AT_ONCE:
        counts = F.broadcast(counts)
    u = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return df.join(counts, label).filter(u * F.col("__n") < F.lit(float(each))).select(df.columns).distinct()


_kinds = np.full(0x110000, -1, np.int8)
_LINE_ENDS, _ENDS = "\n\r\x0b\x0c\x85\u2028\u2029", ".!?…。！？؟।"


def kinds(points: np.ndarray) -> np.ndarray:
    """Of code points: 0 other, 1 letter, 2 white space, 3 sentence end, 4 line end, 5 combining mark."""
    got = _kinds[points]
    if (got < 0).any():
        for p in np.unique(points[got < 0]).tolist():
            c = chr(p)
            if c.isalpha():
                kind = 1
            elif c in _LINE_ENDS:
                kind = 4
            elif c in _ENDS:
                kind = 3
            else:
                kind = 2 if c.isspace() else 5 if unicodedata.category(c)[0] == "M" else 0
            _kinds[p] = kind
        got = _kinds[points]
    return got


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a line feed after it, and the number of the text of each."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if low else np.zeros(0, np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    return points, np.repeat(np.arange(len(low), dtype=np.int32), sizes)
