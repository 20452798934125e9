"""Lines of files of any size: a file is read in ranges of bytes by many tasks, its lines numbered by sums over ranges.

A range's lines are those that begin in it; a task reads on to the end of its
last one. The first pass counts line feeds and looks for NULs and byte order
marks, the second gives the lines with their numbers. A file in UTF-16 is one range.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.trigrams import BINARY_WINDOW
from siftline.sources.corpus import decode_bytes

#: Bytes of a range, and bytes that a task reads and hands on at a time.
RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: Bytes that a task reads at least, and numbers whose texts are written one after another.
LEAST_BYTES, RUN = 1 << 12, 4096
COUNTED = "path string, start long, size long, feeds long, nul long, wide boolean"
LINES = "path string, line_no long, line string"


def ranges(listed: DataFrame, each: int = RANGE_BYTES) -> DataFrame:
    """(path, start, size) of the ranges of the files of a listing (path, size)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(each).cast("long"))
    return listed.select("path", F.explode(starts).alias("start"), "size")


def _chunks(full: str, start: int, end: int | None, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    with open(full, "rb") as f:
        f.seek(start)
        while end is None or start < end:
            raw = f.read(most if end is None else min(most, end - start))
            if not raw:
                return
            start += len(raw)
            yield raw


def _counted(parts: DataFrame, root: str, each: int) -> DataFrame:
    """The ranges with their line feeds, the place of their first NUL, and whether the file is in UTF-16."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                feeds, nul, at, wide = 0, None, start, False
                full = os.path.join(root, path)
                try:
                    wide = start == 0 and next(_chunks(full, 0, 2), b"") in (b"\xff\xfe", b"\xfe\xff")
                    for raw in _chunks(full, start, start + each):
                        feeds += raw.count(b"\n")
                        if nul is None and (k := raw.find(b"\0")) >= 0:
                            nul = at + k
                        at += len(raw)
                except OSError:
                    pass
                rows.append((path, start, size, feeds, nul, wide))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], [x.split()[0] for x in COUNTED.split(", ")])

    return parts.mapInArrow(count, COUNTED)


def lines(listed: DataFrame, root: str, each: int = RANGE_BYTES) -> DataFrame:
    """(path, line_no, line) of the files of a listing (path, size) below a folder.

    As elsewhere a file with a NUL in its first bytes has no lines, any other ends at its
    first NUL, and the empty rest after a last line feed is no line. A file that can't be read has none.
    """
    root = os.path.abspath(root)
    count, total = listed.agg(F.coalesce(F.sum(F.ceil((F.col("size") + 1) / each)), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(count, total // RANGE_BYTES + listed.sparkSession.sparkContext.defaultParallelism))
    counted = _counted(ranges(listed, each).repartition(tasks), root, each).persist()
    of_file = Window.partitionBy("path")  # a row a range
    told = counted.withColumn("nul", F.min("nul").over(of_file)).withColumn("wide", F.max("wide").over(of_file))
    before = F.sum("feeds").over(of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("before", F.coalesce(before, F.lit(0)))
    text = told.filter((~F.col("wide") & (F.col("nul").isNull() | (F.col("nul") >= BINARY_WINDOW) & (F.col("start") < F.col("nul")))) | (F.col("wide") & (F.col("start") == 0)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        shown = pa.array([r[2] for r in rows], pa.binary())
        try:
            shown = shown.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8 throughout
            shown = pa.array([r[2].decode("utf-8", "replace") for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), shown], ["path", "line_no", "line"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, _, nul, wide, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from map(batch_of, _range_lines(os.path.join(root, path), path, start, start + each, nul, wide, number))

    return text.select("path", "start", "size", "nul", "wide", "before").repartition(tasks).mapInArrow(split, LINES)


def _range_lines(full: str, path: str, start: int, end: int, nul: int | None, wide: bool, number: int) -> Iterator[list[tuple]]:
    """Some rows of a range at a time; ``number`` line feeds stand before it."""
    if wide:
        with open(full, "rb") as f:
            text = decode_bytes(f.read())
        if "\0" not in text[:BINARY_WINDOW]:
            parts = text.partition("\0")[0].split("\n")
            yield [(path, k, x.encode()) for k, x in enumerate(parts[:-1] if parts[-1] == "" else parts, 1)]
        return
    inside = True
    if start:
        with open(full, "rb") as f:
            f.seek(start - 1)
            inside = f.read(1) == b"\n"  # a line begins right here
    rest, begins, mark = b"", start, 0  # of the line that is being read: what is known, its place, and bytes that don't belong to it
    first = start == 0
    for raw in _chunks(full, start, nul, min(CHUNK_BYTES, max(end - start, LEAST_BYTES))):  # of a small range not much more than its own
        if first and raw.startswith(b"\xef\xbb\xbf"):
            raw, mark = raw[3:], 3
        first = False
        if not inside:  # the line that the range before began
            k = raw.find(b"\n")
            begins += len(raw) if k < 0 else k + 1
            if begins >= end:
                return
            if k < 0:
                continue
            raw, inside, number = raw[k + 1 :], True, number + 1
        rows = []
        *whole, rest = (rest + raw).split(b"\n")
        for x in whole:
            number += 1
            rows.append((path, number, x))
            begins, mark = begins + len(x) + 1 + mark, 0
            if begins >= end:
                break
        yield rows
        if begins >= end:
            return
    if rest:
        yield [(path, number + 1, rest)]


def write_files(texts: DataFrame, root: str) -> DataFrame:
    """(path, size) of files below a folder, each made of the texts (path, at, text) of its path by ``at``, a line feed after each.

    Every text's place follows from sums over runs of RUN numbers, so a file is written by many tasks,
    each at its places, and a task that runs again writes the same. Null texts are left out,
    texts of one number stand in any order. Folder and files must be seen by all tasks.
    """
    root = os.path.abspath(root)
    rows = texts.filter("text is not null").select("path", F.col("at").cast("long").alias("at"), F.col("text").cast("binary").alias("raw"))
    rows = rows.withColumn("run", F.floor(F.col("at") / RUN)).withColumn("bytes", F.octet_length("raw").cast("long") + 1)
    earlier = Window.orderBy("run").partitionBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    runs = rows.groupBy("path", "run").agg(F.sum("bytes").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(earlier), F.lit(0))).persist()
    files = runs.groupBy("path").agg(F.max(F.col("before") + F.col("all")).alias("size"))
    os.makedirs(root, exist_ok=True)
    for r in files.select("path").toLocalIterator():
        full = os.path.join(root, r["path"])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        open(full, "wb").close()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for batch in batches:
            for path, place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if path != name:
                    if file:
                        file.close()
                    file, name = open(os.path.join(root, path), "r+b"), path
                if file.tell() != place:
                    file.seek(place)
                file.write(raw.as_py() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
        if file:
            file.close()

    within = Window.partitionBy("path", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(runs.select("path", "run", "before"), ["path", "run"])
    placed.select("path", (F.col("before") + F.col("inside")).alias("place"), "raw").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one row
    return files


def with_context(found: DataFrame, all_lines: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """(path, line_no, line, is_match, begins): found lines and their neighbours, joined by number, so that no task sees a whole file.

    ``found`` has path and line_no; ``begins`` tells that the line before isn't shown.
    """
    near = F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after))
    shown = found.select("path", near.alias("shown"), "line_no").groupBy("path", "shown").agg(F.max(F.col("shown") == F.col("line_no")).alias("is_match"))
    shown = shown.withColumnRenamed("shown", "line_no")
    # lines that come of a listing are taken for as few as its rows, and would be broadcast, every one of them
    shown = shown.hint("merge")
    rows = all_lines.join(shown, ["path", "line_no"])
    earlier = shown.select("path", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("__earlier"))
    return rows.join(earlier.hint("merge"), ["path", "line_no"], "left").select("path", "line_no", "line", "is_match", (F.col("__earlier").isNull() | (F.col("line_no") == 1)).alias("begins"))
