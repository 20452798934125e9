"""Search by file name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.segments import StoredIndex
from siftline.plans.query import for_pattern
from siftline.plans.regex import escape
from siftline.sources.corpus import Corpus

#: Paths of a page.
LIMIT = 1000


@dataclass
class FindPage:
    """Paths (a DataFrame), how many there are in all, how many stand before these, and the key to go on."""

    paths: DataFrame
    total: int
    start: int
    next_after: str | None


def find(files: DataFrame, needle: str, relative_to: str = "") -> DataFrame:
    """(path) of live files whose whole path contains the needle, in the case given; optionally only below a root."""
    path = F.col("path")
    inside = F.substr(path, F.lit(len(relative_to) + 1)) if relative_to else path
    return files.filter(F.col("live") & F.contains(inside, F.lit(needle))).select("path")


def find_page(files: DataFrame, needle: str, limit: int = LIMIT, after: str | None = None) -> FindPage:
    """The next ``limit`` paths in byte order."""
    found = find(files, needle)
    told = found.agg(F.count("*").alias("total"), F.count_if(F.col("path") <= (after or "")).alias("start")).first()
    rest = found.filter(F.col("path") > after) if after is not None else found
    got = [r["path"] for r in rest.orderBy("path").limit(max(1, limit)).collect()]  # a page
    start = told["start"] if after is not None else 0
    more = start + len(got) < told["total"]
    return FindPage(files.sparkSession.createDataFrame([(p,) for p in got], "path string"), told["total"], start, got[-1] if more and got else None)


class NameIndex:
    """A stored trigram index over the paths themselves, so that a name is looked up and not scanned for.

    It is a log of segments like that of texts, and follows the same changes.
    """

    def __init__(self, index: StoredIndex):
        self.index = index

    @staticmethod
    def _corpus(files: DataFrame) -> Corpus:
        none = F.lit(None).cast("long")
        return Corpus(files.select("file_id", "path", F.col("path").alias("text"), F.octet_length("path").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), none.alias("digest"), "live", F.lit(False).alias("is_binary")))

    @classmethod
    def build(cls, files: DataFrame, place: str) -> NameIndex:
        """The index of a file table (file_id, path, live) in a folder."""
        return cls(StoredIndex.build(cls._corpus(files), place))

    @classmethod
    def open(cls, spark: SparkSession, place: str) -> NameIndex:
        return cls(StoredIndex.open(spark, place))

    def apply(self, diff: DataFrame, files: DataFrame) -> NameIndex:
        """The index after a diff (path, kind) of file tables; a changed file keeps its name and costs nothing."""
        return NameIndex(self.index.apply(diff.filter("kind <> 'changed'"), self._corpus(files)).merged())

    def find(self, needle: str) -> DataFrame:
        """(path) of live files whose path contains the needle; one below three bytes is looked for in all paths."""
        return self.index.candidates(for_pattern(escape(needle))).filter(F.contains("path", F.lit(needle))).select("path")


def git_scoped(files: DataFrame, paths: DataFrame) -> DataFrame:
    """``files`` restricted to a list of paths (an extension)."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")
