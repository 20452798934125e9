"""A folder's files by rounds of tasks: each task walks some folders and gives back those that it didn't get to.

For trees of many folders on a mount that driver and executors share. The driver
looks at FIRST entries; what is left is a frontier of folders, dealt out anew in
every round, so a deep or uneven tree is split where it is large and no machine
holds the list of all files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.datasource import SCHEMA, path_id
from siftline.sources.walk import stat, walk_some

#: Entries that the driver looks at itself, and those after which a task gives its other folders back.
FIRST, EACH = 5_000, 50_000
#: Bytes of text that a task hands on at a time, and bytes of files that a partition is made for.
BATCH_BYTES, PART_BYTES = 8 << 20, 64 << 20
LISTING = "path string, folder boolean, size long, mtime_ns long, atime_ns long, ctime_ns long"


def _told(root: str, files: list[str], rest: list[str]) -> list[tuple]:
    return [(os.path.relpath(p, root), False, *stat(p)) for p in files] + [(os.path.relpath(p, root), True, 0, 0, 0, 0) for p in rest]


def listing(spark: SparkSession, root: str, hidden: bool = False, no_ignore: bool = False, first: int = FIRST, each: int = EACH) -> DataFrame:
    """(path, size and times) of the files below a folder that the ignore rules leave, in no order; rounds are written to the checkpoint folder."""
    from siftline.operators.page import written

    root = os.path.abspath(root)
    files, rest = walk_some([root], root, hidden, no_ignore, first)
    found = spark.createDataFrame(_told(root, files, rest), LISTING)
    out, frontier, open_ = found.filter("not folder"), found.filter("folder"), len(rest)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in LISTING.split(", ")]
        for batch in batches:
            folders = [os.path.join(root, p) for p in batch.column(0).to_pylist()]
            for at in range(0, len(folders), 64):  # what is found is handed on, not held
                rows = _told(root, *walk_some(folders[at : at + 64], root, hidden, no_ignore, each))
                kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

    while open_:
        parts = min(open_, 4 * spark.sparkContext.defaultParallelism)
        walked = written(frontier.repartition(parts).mapInArrow(step, LISTING))
        out, frontier = out.unionByName(walked.filter("not folder")), walked.filter("folder")
        open_ = frontier.count()
    return out.drop("folder")


def read(listed: DataFrame, root: str) -> DataFrame:
    """The files of a listing with their decoded texts, as the corpus source gives them; files are dealt out by bytes.

    A file that can't be read any more has a null text.
    """
    from siftline.sources.corpus import decode_bytes

    root = os.path.abspath(root)
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string() if n in ("path", "text") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                full = os.path.join(root, path)
                told = stat(full)  # before the read, so that a change in between is seen later
                try:
                    with open(full, "rb") as f:
                        text = decode_bytes(f.read())
                except OSError:
                    text = None
                rows.append((path_id(path), path, text, *told))
                held += told[0]
                if held > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    return listed.select("path").repartition(max(1, total // PART_BYTES + 1)).mapInArrow(load, SCHEMA)
