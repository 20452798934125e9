"""A corpus: a table of files with their text, from any DataFrame or a folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.trigrams import is_binary


@dataclass(frozen=True)
class Corpus:
    """``files``: file_id, path, text, size, mtime_ns, digest, live, is_binary. Ids and paths are unique.

    A table without times tells an edited row by a digest of its text, which is only computed
    where states are compared; a table with times and a folder tell it by size and time.

    Paths of a folder are relative to ``root``, so globs, scopes and what is printed are too.
    """

    files: DataFrame
    root: str = ""

    @classmethod
    def from_df(cls, df: DataFrame, id: str, text: str, path: str | Column | None = None, mtime_ns: str | Column | None = None) -> Corpus:
        """A corpus of a table's rows; without a path the id is the path, without times the text's digest tells edits."""
        named = F.col(id).cast("string") if path is None else F.col(path) if isinstance(path, str) else path
        time = F.lit(0) if mtime_ns is None else F.col(mtime_ns) if isinstance(mtime_ns, str) else mtime_ns
        content = F.col(text)
        digest = F.xxhash64(content) if mtime_ns is None else F.lit(None).cast("long")
        return cls(
            df.select(
                F.col(id).cast("long").alias("file_id"), named.alias("path"), content.alias("text"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("size"),
                time.cast("long").alias("mtime_ns"), digest.alias("digest"), F.lit(True).alias("live"), is_binary(content).alias("is_binary"),
            )
        )

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, hidden: bool = False, no_ignore: bool = False, digests: bool = False, frontier: bool = False) -> Corpus:
        """The files under a folder that the ignore rules leave, read and decoded on the executors.

        With ``digests`` an edit that keeps size and time is seen too, at the price of reading every file.
        The driver walks the folder when the corpus is read; with ``frontier`` tasks do, now and in rounds,
        for trees that one machine would walk for long.
        """
        import os

        from siftline.sources.datasource import register

        register(spark)
        root = os.path.abspath(root)  # workers stand in other folders
        options = {"path": root, "hidden": str(hidden).lower(), "noIgnore": str(no_ignore).lower()}
        if frontier:
            from siftline.sources import frontier as rounds

            found = rounds.read(rounds.listing(spark, root, hidden, no_ignore), root)
        else:
            found = spark.read.format("siftline_corpus").options(**options).load()
        digest = F.xxhash64("text") if digests else F.lit(None).cast("long")
        return cls(found.withColumn("digest", digest).withColumn("live", F.lit(True)).withColumn("is_binary", is_binary(F.col("text"))), root)

    def lines(self) -> DataFrame:
        """file_id, path, line_no (from 1), line. A file ends at its first NUL; a binary file has no lines."""
        return explode_lines(self.files)


def line_array(text: Column) -> Column:
    """The lines of a text up to its first NUL; the empty rest after a last line feed is none."""
    parts = F.split(F.substring_index(text, "\0", 1), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(files: DataFrame) -> DataFrame:
    """The lines of the live text files of a table like ``Corpus.files``."""
    text = files.filter(F.col("live") & ~F.col("is_binary"))
    return text.select("file_id", "path", F.posexplode(line_array(F.col("text"))).alias("pos", "line")).select("file_id", "path", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def decode(raw: Column) -> Column:
    """Text of file bytes: UTF-16 after its byte order mark, with U+FFFD for what is malformed; a UTF-8 mark falls away."""

    @F.pandas_udf("string")
    def wide(values):
        return values.map(lambda b: bytes(b[2:]).decode("utf-16-le" if b[:1] == b"\xff" else "utf-16-be", errors="replace") if b is not None else None)

    mark = F.hex(F.substring(raw, 1, 3))
    plain = F.when(mark == "EFBBBF", F.substring(raw, 4, 2**31 - 1)).otherwise(raw)
    return F.when(mark.startswith("FFFE") | mark.startswith("FEFF"), wide(raw)).otherwise(plain.cast("string"))


def decode_bytes(raw: bytes) -> str:
    """The same of one file's bytes."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[2:].decode(name, errors="replace")
    return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", errors="replace")
