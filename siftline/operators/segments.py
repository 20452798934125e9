"""The stored trigram index: a log of sorted segments with bitmap postings, tombstones and merges.

A segment holds some files and is never changed. Its table ``files`` has a row a
file with its state and its trigrams (sorted, as differences), so a merge needs
no text; ``postings`` has a row for each trigram and bucket of files, with the
places in the bucket as an array, a bitmap or runs, whichever is shortest;
``grams`` tells how many files hold a trigram. A batch of changes writes one small
segment and one table of tombstones, bitmaps of the files that are no longer as
a segment has them. When FAN segments of one size stand in the log, they are
merged into one without the dead. A version of the log is one small file that
names its segments and tombstones; readers of an older version go on undisturbed.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.batches import small_batches
from siftline.functions.trigrams import distinct
from siftline.operators.index import FILE_COLUMNS, Index
from siftline.plans.query import Query
from siftline.sources.corpus import Corpus

FORMAT = 2
#: Bits of a place in a bucket, of a file's place in its segment (28 of them in its partition), and files of a bucket.
PLACE_BITS, ROW_BITS, SEGMENT_SHIFT = 12, 28, 48
BUCKET = 1 << PLACE_BITS
#: Postings of a bucket that a task holds before it writes containers.
PAIRS_AT_ONCE = 4_000_000
#: Containers that are decoded at a time.
DECODED = 64
#: Segments of one size that are merged, and files of a segment of the smallest size.
FAN, SMALLEST = 4, 64
#: Files a partition of postings is made for.
FILES_EACH = 50_000
#: Bytes of postings up to which a lookup reads them itself, ids that become a list, and rows that are broadcast.
READ_BYTES, LISTED, BROADCAST = 8 << 20, 1_000, 200_000
#: A trigram in fewer than one in so many files counts as rare, and its number of files is not kept at hand.
COMMON = 1_000
ARRAY, BITS, RUNS = 0, 1, 2
DEAD = -1

STAGED = "id long, path string, size long, mtime_ns long, digest long, is_binary boolean, grams array<int>"
CONTAINERS = "tri int, bucket long, kind tinyint, n int, data binary"


# containers -------------------------------------------------------------------------


def encode(places: np.ndarray) -> tuple[int, bytes]:
    """Kind and bytes of some sorted places of a bucket, in the shortest of three forms."""
    n = len(places)
    breaks = np.flatnonzero(np.diff(places) != 1)
    runs = len(breaks) + 1
    if 4 * runs < min(2 * n, BUCKET // 8):
        starts, ends = places[np.r_[0, breaks + 1]], places[np.r_[breaks, n - 1]]
        return RUNS, np.stack([starts, ends - starts], 1).astype("<u2").tobytes()
    if 2 * n <= BUCKET // 8:
        return ARRAY, places.astype("<u2").tobytes()
    mark = np.zeros(BUCKET, np.uint8)
    mark[places] = 1
    return BITS, np.packbits(mark, bitorder="little").tobytes()


def decode(kind: int, data: bytes) -> np.ndarray:
    """The bucket as one truth value a place."""
    if kind == BITS:
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool)
    out = np.zeros(BUCKET, bool)
    if kind == ARRAY:
        out[np.frombuffer(data, "<u2")] = True
    else:
        for start, more in np.frombuffer(data, "<u2").reshape(-1, 2).tolist():
            out[start : start + more + 1] = True
    return out


def _containers(bucket: int, tri: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """The containers of a bucket's postings."""
    order = np.lexsort((place, tri))
    tri, place = tri[order], place[order]
    starts = np.flatnonzero(np.r_[True, tri[1:] != tri[:-1]]) if len(tri) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(tri)]
    raw = place.astype("<u2").tobytes()
    kinds, data = np.zeros(len(starts), np.int8), []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a < 3:  # an array is shortest
            data.append(raw[2 * a : 2 * b])
        else:
            kinds[k], encoded = encode(place[a:b])
            data.append(encoded)
    columns = [pa.array(tri[starts].astype(np.int32)), pa.array(np.full(len(starts), bucket, np.int64)), pa.array(kinds), pa.array((ends - starts).astype(np.int32)), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["tri", "bucket", "kind", "n", "data"])


def staged(files: DataFrame) -> DataFrame:
    """One row a file with its place in the segment and its trigrams' differences; binary files have none.

    Files of a partition stand next to each other, so a bucket belongs to one partition.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            texts, binary = batch.column(5), batch.column(4).to_pylist()
            grams = [np.diff(distinct(t.as_py() or b""), prepend=0) if not b else np.zeros(0, np.int32) for t, b in zip(texts, binary, strict=True)]
            borders = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate([*grams, np.zeros(0, np.int32)]).astype(np.int32)))
            ids = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, *(batch.column(k) for k in range(5)), lists], ["id", "path", "size", "mtime_ns", "digest", "is_binary", "grams"])

    small_batches(files.sparkSession)
    return files.select("path", "size", "mtime_ns", "digest", "is_binary", F.col("text").cast("binary").alias("raw")).mapInArrow(extract, STAGED)


def renumbered(rows: DataFrame) -> DataFrame:
    """Rows like those of ``staged`` from several segments, with places in a new one."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            ids = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, *batch.columns[1:]], batch.schema.names)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(number, STAGED)


def containers(rows: DataFrame) -> DataFrame:
    """(tri, bucket, kind, n, data) of rows like those of ``staged``; a bucket of very many postings has several rows a trigram.

    Buckets are packed where their files are read, so only containers are ever shuffled.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tri, place, held = None, [], [], 0
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            for i, grams in zip(ids.tolist(), lists, strict=True):
                if i >> PLACE_BITS != bucket or held > PAIRS_AT_ONCE:
                    if held:
                        yield _containers(bucket, np.concatenate(tri), np.concatenate(place))
                    bucket, tri, place, held = i >> PLACE_BITS, [], [], 0
                own = np.cumsum(grams.values.to_numpy(), dtype=np.int32)
                tri.append(own)
                place.append(np.full(len(own), i & (BUCKET - 1), np.int16))
                held += len(own)
        if held:
            yield _containers(bucket, np.concatenate(tri), np.concatenate(place))

    small_batches(rows.sparkSession)
    return rows.select("id", "grams").mapInArrow(pack, CONTAINERS)


def dead_containers(ids: DataFrame) -> DataFrame:
    """The containers of some files (file_id), under the trigram DEAD."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, places = None, []
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if i >> PLACE_BITS != bucket and places:
                    yield _containers(bucket, np.full(len(places), DEAD), np.array(places))
                    places = []
                bucket = i >> PLACE_BITS
                places.append(i & (BUCKET - 1))
        if places:
            yield _containers(bucket, np.full(len(places), DEAD), np.array(places))

    bucket = F.shiftright("file_id", PLACE_BITS)
    return ids.select("file_id").distinct().repartition(bucket).sortWithinPartitions("file_id").mapInArrow(pack, CONTAINERS)


def _held(query: Query, rows: dict[int, list[tuple[int, int, bytes]]]) -> np.ndarray | None:
    """The places of a bucket that fulfil a condition; None for no place. ``rows`` has n, kind and data by trigram."""
    if query.kind == "tri":
        found = rows.get(query.tri)
        if not found:
            return None
        out = decode(*found[0][1:])
        for _, kind, data in found[1:]:
            out |= decode(kind, data)
        return out
    if query.kind == "or":
        parts = [x for q in query.items if (x := _held(q, rows)) is not None]
        return np.logical_or.reduce(parts) if parts else None
    # the rarest trigrams first; where one is missing or nothing is left, the rest isn't read
    plain = [q for q in query.items if q.kind == "tri"]
    if any(q.tri not in rows for q in plain):
        return None
    out = None
    for q in [*sorted(plain, key=lambda q: sum(x[0] for x in rows[q.tri])), *(q for q in query.items if q.kind != "tri")]:
        held = _held(q, rows)
        if held is None:
            return None
        out = held if out is None else out & held
        if not out.any():
            return None
    return out


def _evaluate(query: Query, bucket: int, rows: dict[int, list[tuple[int, int, bytes]]]) -> np.ndarray:
    """The ids of a bucket's live files that fulfil a condition."""
    out = _held(query, rows)
    if out is None:
        return np.zeros(0, np.int64)
    for _, kind, data in rows.get(DEAD, ()):
        out = out & ~decode(kind, data)
    return np.flatnonzero(out) + (bucket << PLACE_BITS)


def evaluated(query: Query, hits: DataFrame) -> DataFrame:
    """(file_id) that fulfil a condition, from the containers of its trigrams and the tombstones, a bucket at a time."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, {}
        for batch in batches:
            found = []
            for tri, b, kind, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if rows:
                        found.append(_evaluate(query, bucket, rows))
                    bucket, rows = b, {}
                rows.setdefault(tri, []).append((n, kind, data))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))], ["file_id"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(_evaluate(query, bucket, rows))], ["file_id"])

    return hits.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "file_id long")


# the log ------------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Another writer made this version first."""


class Store:
    """Small files and folders of a log through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []

    def write_new(self, name: str, text: str) -> None:
        """A file that isn't there yet; raises Conflict if it is."""
        from py4j.protocol import Py4JJavaError

        made = self._path(f"_{name}-{uuid.uuid4().hex}")
        out = self.fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.exists(self._path(name)) or not self.fs.rename(made, self._path(name)):
                raise Conflict(name)
        except Py4JJavaError as e:
            raise Conflict(name) from e
        finally:
            if self.fs.exists(made):
                self.fs.delete(made, False)

    def read(self, name: str) -> str:
        source = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _version(name: str) -> int:
    return int(name[2:]) if name.startswith("v-") and name[2:].isdigit() else 0


@dataclass(frozen=True)
class StoredIndex(Index):
    """One version of a stored index; it is an Index whose lookups read containers.

    ``log`` names the segments (number, name, files, live, bytes of a posting's mean) and the
    tombstones. A file's id is its segment's number, then its place there.
    """

    path: str = ""
    log: dict = field(default_factory=dict, compare=False)

    # making and opening

    @classmethod
    def build(cls, corpus: Corpus, path: str, keep: int = 2) -> StoredIndex:
        """Index a corpus anew in a folder; versions that stood there before are replaced."""
        spark = corpus.files.sparkSession
        store = Store(spark, path)
        version = max(map(_version, store.names()), default=0)
        segment = _write_segment(spark, store, staged(corpus.files.filter("live")), 0)
        log = {"format": FORMAT, "version": version + 1, "segments": [segment] if segment else [], "dead": []}
        store.write_new(f"v-{version + 1}", json.dumps(log))
        _clear(store, keep)
        return cls._of(spark, path, log, None if corpus.root else corpus)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredIndex:
        """The latest version; raises ValueError for none, another format or missing segments."""
        store = Store(spark, path)
        names = store.names()
        version = max(map(_version, names), default=0)
        if not version:
            raise ValueError(f"no index in {path}")
        log = json.loads(store.read(f"v-{version}"))
        if log.get("format") != FORMAT:
            raise ValueError(f"index format {log.get('format')} is not {FORMAT}")
        missing = {x["name"] for x in log["segments"] + log["dead"]} - set(names)
        if missing:
            raise ValueError(f"index is damaged: {', '.join(sorted(missing))} is missing")
        return cls._of(spark, path, log)

    @classmethod
    def _of(cls, spark: SparkSession, path: str, log: dict, of: Corpus | None = None) -> StoredIndex:
        out = cls(spark.createDataFrame([], "file_id long"), spark.createDataFrame([], "tri int"), of, None, path.rstrip("/"), log)
        object.__setattr__(out, "files", out._files())
        object.__setattr__(out, "postings", out._postings())
        return out

    @property
    def _spark(self) -> SparkSession:
        return self.files.sparkSession

    def _table(self, name: str, kind: str) -> DataFrame:
        schema = {"files": STAGED, "postings": CONTAINERS, "grams": "tri int, files long", "dead": CONTAINERS}[kind]
        return self._spark.read.schema(schema).parquet(f"{self.path}/{name}" + (f"/{kind}" if kind != "dead" else ""))

    def _union(self, frames: list[DataFrame], schema: str) -> DataFrame:
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out if out is not None else self._spark.createDataFrame([], schema)

    def _rows(self, segment: dict) -> DataFrame:
        return self._table(segment["name"], "files").withColumn("file_id", F.col("id") + F.lit(segment["number"] << SEGMENT_SHIFT))

    def _dead_ids(self, only: set[str] | None = None) -> DataFrame | None:
        """(file_id) of files that are no longer as their segment has them, of some segments or all."""
        dead = [d for d in self.log["dead"] if only is None or only & set(d["of"])]
        if not dead:
            return None

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, DECODED):
                    bucket, kind, data = (c.to_pylist() for c in batch.slice(at, DECODED).columns)
                    ids = [np.flatnonzero(decode(k, x)) + (b << PLACE_BITS) for b, k, x in zip(bucket, kind, data, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).astype(np.int64))], ["file_id"])

        rows = self._union([self._table(d["name"], "dead") for d in dead], CONTAINERS)
        out = rows.select("bucket", "kind", "data").mapInArrow(places, "file_id long").distinct()
        return F.broadcast(out) if sum(d["n"] for d in dead) <= BROADCAST else out

    def _files(self) -> DataFrame:
        """FILE_COLUMNS of all files, dead ones as not live."""
        columns = [c for c in FILE_COLUMNS if c != "live"]
        rows = self._union([self._rows(s).select(columns) for s in self.log["segments"]], "file_id long, path string, size long, mtime_ns long, digest long, is_binary boolean")
        dead = self._dead_ids()
        if dead is None:
            return rows.withColumn("live", F.lit(True)).select(FILE_COLUMNS)
        return rows.join(dead.withColumn("__dead", F.lit(True)), "file_id", "left").withColumn("live", F.col("__dead").isNull()).select(FILE_COLUMNS)

    def _postings(self) -> DataFrame:
        """(tri, file_id) of live files, spelled out from the files' own trigrams."""
        rows = self._union([self._rows(s).select("file_id", "grams") for s in self.log["segments"]], "file_id long, grams array<int>")
        dead = self._dead_ids()
        rows = rows if dead is None else rows.join(dead, "file_id", "left_anti")

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = [np.cumsum(g.values.to_numpy(), dtype=np.int32) for g in batch.column(1)]
                ids = np.repeat(batch.column(0).to_numpy(), [len(g) for g in grams])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*grams, np.zeros(0, np.int32)]).astype(np.int32)), pa.array(ids)], ["tri", "file_id"])

        small_batches(self._spark)
        return rows.mapInArrow(spell, "tri int, file_id long")

    # lookups

    @cached_property
    def live_files(self) -> int:
        return sum(s["files"] for s in self.log["segments"]) - sum(d["n"] for d in self.log["dead"])

    @cached_property
    def common(self) -> dict[int, int]:
        """How many files hold each common trigram; there are at most COMMON times as many of these as a file has trigrams."""
        total = sum(s["files"] for s in self.log["segments"])
        grams = self._union([self._table(s["name"], "grams") for s in self.log["segments"]], "tri int, files long").groupBy("tri").agg(F.sum("files").alias("files"))
        return {r["tri"]: r["files"] for r in grams.filter(F.col("files") * COMMON >= total).collect()}

    def share(self, query: Query) -> float:
        """The share of files that a condition is thought to leave: the rarest part of a conjunction, the sum of a disjunction."""
        if query.is_all:
            return 1.0
        if query.kind == "tri":
            return min(1.0, self.common.get(query.tri, 0) / max(1, self.live_files)) or 0.5 / COMMON
        parts = [self.share(q) for q in query.items]
        return min(parts) if query.kind == "and" else min(1.0, sum(parts))

    @cached_property
    def _held_containers(self) -> DataFrame:
        """All postings and tombstones, buckets numbered through all segments."""
        postings = [self._table(s["name"], "postings").withColumn("bucket", F.col("bucket") + F.lit(s["number"] << (SEGMENT_SHIFT - PLACE_BITS))) for s in self.log["segments"]]
        return self._union(postings + [self._table(d["name"], "dead") for d in self.log["dead"]], CONTAINERS)

    @cached_property
    def _paths(self) -> DataFrame:
        return self._union([self._rows(s).select("file_id", "path") for s in self.log["segments"]], "file_id long, path string")

    def resident(self) -> StoredIndex:
        """This version with postings and paths kept in the executors' memory, for many searches."""
        self._held_containers.persist().count()
        self._paths.persist().count()
        self.common  # noqa: B018
        return self

    def _read(self, query: Query) -> np.ndarray | None:
        """Ids that fulfil a condition, if its postings are few enough for the driver to read; else None."""
        leaves = sorted(query.leaves())
        most = 2 * sum(min(self.common.get(t, self.live_files // COMMON), self.live_files) for t in leaves) + 2 * sum(d["n"] for d in self.log["dead"])
        if most > READ_BYTES:
            return None
        buckets: dict[int, dict] = {}
        for tri, bucket, kind, n, data in zip(*(c.to_pylist() for c in self._containers_of(leaves).toArrow().columns), strict=True):
            buckets.setdefault(bucket, {}).setdefault(tri, []).append((n, kind, data))
        return np.concatenate([*(_evaluate(query, b, rows) for b, rows in buckets.items()), np.zeros(0, np.int64)]).astype(np.int64)

    def _containers_of(self, leaves: list[int]) -> DataFrame:
        return self._held_containers.filter(F.col("tri").isin([*leaves, DEAD] if self.log["dead"] else leaves))

    def matching_ids(self, query: Query) -> DataFrame:
        """(file_id) of live files whose trigrams fulfil a condition that is not ``all``.

        Few postings are read by the driver, as a list of bounded size; more meet bucket by bucket.
        """
        ids = self._read(query)
        if ids is None:
            return evaluated(query, self._containers_of(sorted(query.leaves())))
        return self._spark.createDataFrame(pa.table({"file_id": ids}))

    def candidates(self, query: Query, keep: Column | None = None) -> DataFrame:
        """(file_id, path) of live files that may match; ``keep`` is a condition over paths."""
        if not self.narrows(query):
            live = self.files.filter("live")
            return (live if keep is None else live.filter(keep)).select("file_id", "path")
        found, _ = self._found(query)
        return found if keep is None else found.filter(keep)

    def _found(self, query: Query) -> tuple[DataFrame, bool]:
        """(file_id, path) of live files that may match, and whether they are few enough to broadcast."""
        ids = self._read(query)
        if ids is not None and len(ids) <= LISTED:
            return self._paths.filter(F.col("file_id").isin(ids.tolist())), True
        few = ids is not None and len(ids) <= BROADCAST
        met = evaluated(query, self._containers_of(sorted(query.leaves()))) if ids is None else self._spark.createDataFrame(pa.table({"file_id": ids}))
        return self._paths.join(F.broadcast(met) if few else met, "file_id", "left_semi"), few

    def candidate_paths(self, query: Query) -> tuple[DataFrame, bool]:
        if not self.narrows(query):
            return super().candidate_paths(query)
        found, few = self._found(query)
        return found.select("path"), few

    # changes

    def stats(self) -> DataFrame:
        """One row: live files, distinct trigrams, postings."""
        if self.log["dead"]:
            return super().stats()
        grams = self._union([self._table(s["name"], "grams") for s in self.log["segments"]], "tri int, files long").groupBy("tri").agg(F.sum("files").alias("files"))
        zero = F.lit(0).cast("long")
        return grams.agg(F.lit(self.live_files).cast("long").alias("files"), F.count("*").alias("trigrams"), F.coalesce(F.sum("files"), zero).alias("postings"))

    def apply(self, diff: DataFrame, corpus: Corpus) -> StoredIndex:
        """The version after ``diff`` (path, kind): a segment of the new and changed files, and tombstones of what they and the removed ones were.

        What is written grows with the changes alone. Raises Conflict if another writer was faster.
        """
        spark, store = self._spark, Store(self._spark, self.path)
        diff = diff.select("path", "kind").distinct().persist()
        try:
            few = diff.limit(BROADCAST + 1).count() <= BROADCAST
            meet = F.broadcast if few else (lambda x: x)
            fresh = corpus.files.filter("live").join(meet(diff.filter("kind <> 'removed'").select("path")), "path", "left_semi")
            number = min(set(range(len(self.log["segments"]) + 1)) - {s["number"] for s in self.log["segments"]})
            segment = _write_segment(spark, store, staged(fresh.coalesce(max(1, spark.sparkContext.defaultParallelism)) if few else fresh), number)
            old = self.files.filter("live").join(meet(diff.filter("kind <> 'new'").select("path")), "path", "left_semi").select("file_id")
            dead = _write_dead(spark, store, old)
        finally:
            diff.unpersist()
        log = {**self.log, "version": self.log["version"] + 1, "segments": self.log["segments"] + ([segment] if segment else []), "dead": self.log["dead"] + ([dead] if dead else [])}
        _commit(store, log, segment, dead)
        return StoredIndex._of(spark, self.path, log, None if corpus.root else corpus)

    def due(self) -> list[dict]:
        """The segments of the smallest size of which FAN stand in the log; or one of which half is dead."""
        sizes: dict[int, list[dict]] = {}
        for s in self.log["segments"]:
            sizes.setdefault(_size(s["files"]), []).append(s)
        full = next((sizes[k] for k in sorted(sizes) if len(sizes[k]) >= FAN), [])
        gone = {n: sum(d["of"].get(str(n), 0) for d in self.log["dead"]) for n in [s["number"] for s in self.log["segments"]]}
        return full or [s for s in self.log["segments"] if 2 * gone[s["number"]] > s["files"]][:1]

    def merged(self, keep: int = 2) -> StoredIndex:
        """The version after one merge that is due, or this one. Raises Conflict if the log has changed meanwhile; then nothing is lost."""
        due = self.due()
        if not due:
            return self
        spark, store = self._spark, Store(self._spark, self.path)
        numbers = {s["number"] for s in due}
        rows = self._union([self._rows(s) for s in due], STAGED + ", file_id long")
        dead = self._dead_ids({str(n) for n in numbers})
        rows = rows if dead is None else rows.join(dead, "file_id", "left_anti")
        number = min(set(range(len(self.log["segments"]) + 1)) - {s["number"] for s in self.log["segments"]})
        parts = max(1, sum(s["files"] for s in due) // FILES_EACH)
        segment = _write_segment(spark, store, renumbered(rows.select([c.split()[0] for c in STAGED.split(", ")]).coalesce(parts)), number)
        left = []
        for d in self.log["dead"]:  # tombstones of other segments stay
            of = {n: c for n, c in d["of"].items() if int(n) not in numbers}
            if not of:
                continue
            if len(of) < len(d["of"]):
                other = F.shiftright("bucket", SEGMENT_SHIFT - PLACE_BITS).isin([int(n) for n in of])
                name = f"d-{uuid.uuid4().hex}"
                self._table(d["name"], "dead").filter(other).coalesce(1).write.parquet(f"{self.path}/{name}")
                d = {"name": name, "n": sum(of.values()), "of": of}
            left.append(d)
        segments = [s for s in self.log["segments"] if s["number"] not in numbers] + ([segment] if segment else [])
        log = {**self.log, "version": self.log["version"] + 1, "segments": segments, "dead": left}
        _commit(store, log, segment, *(d for d in left if d not in self.log["dead"]))
        _clear(store, keep)
        return StoredIndex._of(spark, self.path, log, self.of)

    def merge_in_background(self, keep: int = 2) -> threading.Thread:
        """Merges until none is due, in a thread of its own; a writer that is faster ends it, and the next call goes on."""

        def run() -> None:
            index = self
            try:
                while index.due():
                    index = index.merged(keep)
            except Conflict:
                pass

        thread = threading.Thread(target=run, name="siftline-merge", daemon=True)
        thread.start()
        return thread


def _commit(store: Store, log: dict, *made: dict | None) -> None:
    """Make a version; if another writer was faster, what was ``made`` for it goes."""
    try:
        store.write_new(f"v-{log['version']}", json.dumps(log))
    except Conflict:
        for x in filter(None, made):
            store.remove(x["name"])
        raise


def _size(files: int) -> int:
    """The size class of a segment: a class spans FAN times the files of the one below."""
    size, most = 0, SMALLEST
    while files > most:
        size, most = size + 1, most * FAN
    return size


def _write_segment(spark: SparkSession, store: Store, rows: DataFrame, number: int) -> dict | None:
    """Write a segment of rows like those of ``staged``; None if there are none."""
    name = f"s-{uuid.uuid4().hex}"
    place = f"{store.root}/{name}"
    rows.write.option("compression", "zstd").parquet(f"{place}/files")
    written = spark.read.schema(STAGED).parquet(f"{place}/files")
    files = written.count()
    if not files:
        store.remove(name)
        return None
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), files // FILES_EACH + 1)
    packed = containers(written)
    packed = packed.coalesce(1) if parts == 1 else packed.repartition(parts, "tri")
    packed.sortWithinPartitions("tri", "bucket").write.parquet(f"{place}/postings")
    grams = spark.read.schema(CONTAINERS).parquet(f"{place}/postings").groupBy("tri").agg(F.sum("n").cast("long").alias("files"))
    grams.coalesce(parts).write.parquet(f"{place}/grams")
    return {"name": name, "number": number, "files": files}


def _write_dead(spark: SparkSession, store: Store, ids: DataFrame) -> dict | None:
    """Write the tombstones of some files; None if there are none."""
    name = f"d-{uuid.uuid4().hex}"
    dead_containers(ids).coalesce(1).write.parquet(f"{store.root}/{name}")
    segment = F.shiftright("bucket", SEGMENT_SHIFT - PLACE_BITS)
    of = {str(r["s"]): r["n"] for r in spark.read.schema(CONTAINERS).parquet(f"{store.root}/{name}").groupBy(segment.alias("s")).agg(F.sum("n").alias("n")).collect()}
    if not of:
        store.remove(name)
        return None
    return {"name": name, "n": sum(of.values()), "of": of}


def _clear(store: Store, keep: int) -> None:
    """Remove versions before the last ``keep``, and what none of these names; unfinished work of others is at most a version old and stays."""
    names = store.names()
    versions = sorted(filter(None, map(_version, names)))
    kept = versions[-keep:]
    used = {x["name"] for v in kept for part in ("segments", "dead") for x in json.loads(store.read(f"v-{v}"))[part]}
    for v in versions[:-keep]:
        told = json.loads(store.read(f"v-{v}"))
        for name in {x["name"] for part in ("segments", "dead") for x in told[part]} - used:
            store.remove(name)
        store.remove(f"v-{v}")
