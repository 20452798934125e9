"""Importance resampling: documents drawn in proportion to how much they resemble a target text.

A document's features are its runs of one to three words, hashed by CRC-32 into
buckets. No run is ever spelled out: a word's CRC is computed once, and the CRC
of "a b" follows from those of "a" and " b", since appending n bytes multiplies
a CRC by a fixed matrix over GF(2) that depends on n alone. Buckets are counted
over the whole corpus and the whole target; a bucket's gain is the logarithm of
its smoothed frequency ratio. A document's weight is the sum of its gains, and
Gumbel noise that follows from its id turns the highest scores into a draw
without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, longs, runs, shared_checkpoints, small_batches

BUCKETS, ORDER = 10_000, 3
#: Lengths in bytes that have a shift table of their own; longer shifts take one table for each bit of the length.
DIRECT = 48
#: Bytes of text whose words are taken at a time.
BYTES_AT_ONCE = 2_000_000
#: Share of ranks, and its inverse the accuracy, by which the draw's lower bound is set too low on purpose.
SLACK = 0.002

_POLYNOMIAL = 0xEDB88320
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 32 × 32 matrix over GF(2), given by its columns, times each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Shift tables by length below DIRECT and by powers of two: the image of each value of each byte of a CRC."""
    one_bit = np.array([_POLYNOMIAL] + [1 << (k - 1) for k in range(1, 32)], np.uint32)
    byte = np.array([1 << k for k in range(32)], np.uint32)
    for _ in range(8):
        byte = _apply(one_bit, byte)
    points = np.arange(256, dtype=np.uint32)
    table_of = lambda m: np.stack([_apply(m, points << np.uint32(8 * k)) for k in range(4)])
    direct, matrix = [], np.array([1 << k for k in range(32)], np.uint32)
    for _ in range(DIRECT):
        direct.append(table_of(matrix))
        matrix = _apply(byte, matrix)
    powers, matrix = [], byte
    for _ in range(40):
        powers.append(table_of(matrix))
        matrix = _apply(matrix, matrix)
    return np.stack(direct), np.stack(powers)


def _look(table: np.ndarray, row: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    parts = [(crc >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
    return table[row, 0, parts[0]] ^ table[row, 1, parts[1]] ^ table[row, 2, parts[2]] ^ table[row, 3, parts[3]]


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after as many zero bytes as ``length`` says, without their constants: M^length times each CRC."""
    direct, powers = _shifts()
    out = _look(direct, np.minimum(length, DIRECT - 1), crc)
    far = np.flatnonzero(length >= DIRECT)
    if len(far):
        value, left = crc[far], length[far].astype(np.int64)
        for k in range(int(left.max()).bit_length()):
            on = (left >> k & 1).astype(bool)
            value[on] = _look(powers, k, value[on])
        out[far] = value
    return out


def word_crcs(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of the words at ``starts`` of a byte array.

    The CRC is linear: every byte adds its own CRC, shifted by the bytes after it in the word.
    """
    direct, _ = _shifts()
    short = sizes < DIRECT
    out = np.zeros(len(starts), np.uint32)
    s, n = starts[short], sizes[short].astype(np.int64)
    if len(s):
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        after = np.repeat(n, n) - within - 1
        of_byte = _look(direct, 1, np.arange(256, dtype=np.uint32))  # a byte's own CRC without constants
        table = np.stack([_look(direct, k, of_byte) for k in range(DIRECT)])
        each = table[after, raw[np.repeat(s, n) + within]]
        # the constants: all ones before the word, and after it
        ones = _look(direct, np.arange(DIRECT), np.full(DIRECT, 0xFFFFFFFF, np.uint32))
        out[short] = np.bitwise_xor.reduceat(each, first) ^ ones[n] ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(~short).tolist():
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + sizes[i]])
    return out


def features(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, then the CRC of every feature and the number of its text."""
    encoded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    inside = np.concatenate([[False], _WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    borders = np.cumsum([len(t) + 1 for t in encoded])
    owner = np.searchsorted(borders, starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    if not len(starts):
        return counts, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    crc = word_crcs(raw, starts, sizes)
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    tail = shift(space, sizes) ^ crc  # of " word"
    last, crcs, owners = crc, [crc], [owner]
    for k in range(1, order):
        last = shift(last[:-1], sizes[k:] + 1) ^ tail[k:]
        same = owner[k:] == owner[: len(owner) - k]
        crcs.append(last[same])
        owners.append(owner[k:][same])
        if not len(last):
            break
    return counts, np.concatenate(crcs), np.concatenate(owners)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of a column's texts with their first row's number; null is empty."""
    texts = [t or "" for t in column.to_pylist()]
    for start, end in runs(texts, BYTES_AT_ONCE):
        yield start, texts[start:end]


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any.

    A task adds its texts up before anything is shuffled, so no more than a row a
    bucket and task meet. Null and empty texts have no features; repeated rows count each.
    """
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                total += np.bincount(features(texts, order)[1] % np.uint32(buckets), minlength=buckets)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), longs(total[at])], ["bucket", "n"])

    return df.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed frequency ratio of every bucket, of two tables (bucket, n)."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    joined = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    rows = joined.select("bucket", s.alias("s"), t.alias("t")).orderBy("bucket").toArrow()  # a row a bucket
    s, t = rows["s"].to_numpy(), rows["t"].to_numpy()
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(df: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row; a text without words weighs 0."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, n, weight = [], [], []
            for _, texts in _texts(batch.column(1)):
                count, crcs, owner = features(texts, order)
                words.append(count)
                n.append(np.bincount(owner, minlength=len(texts)))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, owner, gain[crcs % np.uint32(len(gain))])
                weight.append(total)
            columns = [longs(np.concatenate(x) if x else []) for x in (words, n, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """floor(-1000 ln(-ln u)), where u follows from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``df``; rank is null for what isn't drawn.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded
    down) are drawn, by score and then by smaller doc_id; rows without doc_id come
    last among equals and draw the noise of an empty id. Null and empty texts have no
    features, weight 0 and are never drawn. Repeated rows are rows of their own. An empty
    target leaves every weight to what the corpus has, an empty table gives none.
    """
    gain = gains(bucket_counts(df, text), bucket_counts(target, target_text))
    scored = weights(df, gain, doc_id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    return draw(cut(scored), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` (doc_id, n_words, score and others; written) with ``rank`` of the rows drawn.

    Only rows that may be drawn are sorted: an approximate quantile of known accuracy,
    set lower by twice that, bounds them from below. They are dealt by range, so equal
    scores part by id, and a row's rank is its place in its part and the sizes of the
    parts before.
    """
    shared_checkpoints(scored.sparkSession)
    fit = F.col("n_words") >= least_words
    quantile = F.percentile_approx("score", F.lit(max(0.0, 1 - percent / 100 - 2 * SLACK)), F.lit(int(1 / SLACK)))
    total, least = scored.filter(fit).agg(F.count("*"), quantile).first()
    wanted = percent * total // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    among = fit & (F.col("score") >= least)
    if scored.filter(among).count() < wanted:
        among = fit
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = cut(scored.filter(among).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()))
    sizes = {r["__part"]: (r["n"], r["low"]) for r in parts.groupBy("__part").agg(F.count("*").alias("n"), F.min("__place").alias("low")).collect()}  # a row a part
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before + 1 - sizes[part][1]))
        before += sizes[part][0]
    offsets = scored.sparkSession.createDataFrame(rows, "__part int, __offset long")
    rank = F.col("__place") + F.col("__offset")
    ranked = parts.join(F.broadcast(offsets), "__part").withColumn("rank", F.when(rank <= wanted, rank)).drop("__part", "__place", "__offset")
    rest = scored.filter(~F.coalesce(among, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
