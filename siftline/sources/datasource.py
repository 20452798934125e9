"""Python data source ``siftline_corpus``: walk on the driver, read and decode on the executors.

It is for folders that every executor sees under the same path (a shared mount, or one
machine); corpora in a store that only Spark reads are tables. Paths are relative to
the folder, and a file's id is a hash of its path, so that it outlives other files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file_id long, path string, text string, size long, mtime_ns long, atime_ns long, ctime_ns long"
LISTING = "path string, size long, mtime_ns long, listed_at long"
#: Files of one partition, and bytes after which a partition is closed earlier.
FILES_EACH, BYTES_EACH = 512, 64 << 20


def path_id(path: str) -> int:
    """63 bits of a relative path's hash."""
    import xxhash

    return xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass")) >> 1


class Files(InputPartition):
    """Some files, and a number that tells listings apart."""

    def __init__(self, number: int, paths: list[str]):
        self.number, self.paths = number, paths


class CorpusSource(DataSource):
    """Options: path, hidden, noIgnore; prefix restricts the files by the beginning of their paths."""

    @classmethod
    def name(cls) -> str:
        return "siftline_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CorpusReader(self.options)


class CorpusReader(DataSourceReader):
    """No filters are pushed down: Spark keeps a pushed filter for later queries of the same table, which then lose files."""

    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}  # Spark doesn't keep their case

    def partitions(self) -> list[Files]:
        from siftline.sources.walk import walk

        flag = lambda n: str(self.options.get(n.lower(), "false")).lower() == "true"
        out: list[Files] = []
        size, root = 0, os.path.abspath(self.options["path"])
        for full in walk(root, flag("hidden"), flag("noIgnore")):
            path = os.path.relpath(full, root)
            if not path.startswith(self.options.get("prefix", "")):
                continue
            if not out or len(out[-1].paths) >= FILES_EACH or size > BYTES_EACH:
                out.append(Files(len(out), []))
                size = 0
            out[-1].paths.append(path)
            size += _size(full)
        return out or [Files(0, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from siftline.sources.corpus import decode_bytes
        from siftline.sources.walk import stat

        root = os.path.abspath(self.options["path"])
        for path in partition.paths:
            full = os.path.join(root, path)
            told = stat(full)  # before the read, so that a change in between is seen later
            try:
                with open(full, "rb") as f:
                    text = decode_bytes(f.read())
            except OSError:
                text = None
            yield (path_id(path), path, text, *told)


def _size(path: str) -> int:
    from siftline.sources.walk import stat

    return stat(path)[0]


class ListingSource(DataSource):
    """``siftline_listing``: a stream of whole listings of a folder, a new one when something changed."""

    @classmethod
    def name(cls) -> str:
        return "siftline_listing"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingReader(self.options)


class ListingReader(DataSourceStreamReader):
    """An offset is a digest of the listing, so unchanged folders make no batch."""

    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}  # Spark doesn't keep their case

    def _listing(self) -> list[tuple[str, int, int]]:
        from siftline.sources.walk import stat, walk

        flag = lambda n: str(self.options.get(n.lower(), "false")).lower() == "true"
        root = os.path.abspath(self.options["path"])
        return [(os.path.relpath(p, root), *stat(p)[:2]) for p in walk(root, flag("hidden"), flag("noIgnore"))]

    def initialOffset(self) -> dict:
        return {"digest": -1}

    def latestOffset(self) -> dict:
        return {"digest": zlib.crc32(repr(self._listing()).encode())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Files(end["digest"], [])] if start != end else []

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size, mtime in self._listing():
            yield (path, size, mtime, partition.number)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    spark.dataSource.register(CorpusSource)
    spark.dataSource.register(ListingSource)
