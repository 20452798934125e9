"""The trigram index as tables: build, look up, and bring up to date; ``segments`` stores one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.trigrams import postings as extract
from siftline.plans.query import Query
from siftline.sources.corpus import Corpus

#: Trigrams of a condition beyond which the lookup isn't worth it and everything is a candidate.
MOST_LEAVES = 600
FILE_COLUMNS = ["file_id", "path", "size", "mtime_ns", "digest", "live", "is_binary"]
#: What tells a file's state: a digest of its content where the corpus has one, else size and time.
STATE = ["size", "mtime_ns", "digest"]


@dataclass(frozen=True)
class Index:
    """``files`` (FILE_COLUMNS) and ``postings`` (tri, file_id); immutable, an update makes a new one.

    ``file_id`` ties the two tables together and means nothing outside; an index and a
    corpus meet by path. ``of`` is the corpus that the index is known to be up to date with,
    ``numbered`` one whose own ids it has, so that these may meet by id. A folder's files
    are read anew by every search and may have changed, so both are for tables only.
    """

    files: DataFrame
    postings: DataFrame
    of: Corpus | None = field(default=None, compare=False)
    numbered: Corpus | None = field(default=None, compare=False)

    @classmethod
    def build(cls, corpus: Corpus) -> Index:
        """Index of a corpus; binary files have no postings."""
        return cls(corpus.files.select(FILE_COLUMNS), extract(corpus.files), *[None if corpus.root else corpus] * 2)

    def matching_ids(self, query: Query) -> DataFrame:
        """(file_id) of files whose trigrams fulfil a condition that is not ``all``: one pass over its postings."""
        leaves = sorted(query.leaves())
        hit = self.postings.filter(F.col("tri").isin(leaves))
        if query.kind == "tri":
            return hit.select("file_id").distinct()
        if query.kind == "or" and all(q.kind == "tri" for q in query.items):
            return hit.select("file_id").distinct()
        # one bit a trigram, 60 to a word, so the aggregate stays in fixed-size buffers
        bit = {t: i for i, t in enumerate(leaves)}
        words = range(-(-len(leaves) // 60))

        def mask(w: int) -> Column:
            """The bits of word ``w`` that a posting sets, found by halving the sorted trigrams."""

            def pick(part: list[int]) -> Column:
                if len(part) == 1:
                    return F.when(F.col("tri") == part[0], F.lit(1 << bit[part[0]] % 60)).otherwise(F.lit(0).cast("long"))
                half = len(part) // 2
                return F.when(F.col("tri") < part[half], pick(part[:half])).otherwise(pick(part[half:]))

            return pick(leaves[60 * w : 60 * (w + 1)])

        met = hit.groupBy("file_id").agg(*[F.bit_or(mask(w)).alias(f"m{w}") for w in words])

        def holds(q: Query) -> Column:
            if q.kind == "tri":
                w, b = divmod(bit[q.tri], 60)
                return F.col(f"m{w}").bitwiseAND(F.lit(1 << b)) != 0
            plain = [x for x in q.items if x.kind == "tri"]
            parts = [holds(x) for x in q.items if x.kind != "tri"]
            for w in words:  # all trigrams of one word of bits at once
                of = sum(1 << bit[x.tri] % 60 for x in plain if bit[x.tri] // 60 == w)
                if of:
                    both = F.col(f"m{w}").bitwiseAND(F.lit(of))
                    parts.append(both == of if q.kind == "and" else both != 0)
            out = parts[0]
            for p in parts[1:]:
                out = out & p if q.kind == "and" else out | p
            return out

        return met.filter(holds(query)).select("file_id")

    def candidates(self, query: Query, keep: Column | None = None) -> DataFrame:
        """(file_id, path) of live files that may match; ``keep`` is a condition over paths, applied first."""
        live = self.files.filter("live")
        if keep is not None:
            live = live.filter(keep)
        if not self.narrows(query):
            return live.select("file_id", "path")
        return live.select("file_id", "path").join(self.matching_ids(query), "file_id", "left_semi")

    def candidate_paths(self, query: Query) -> tuple[DataFrame, bool]:
        """(path) of candidates, and whether they are known to be few enough to broadcast."""
        return self.candidates(query).select("path"), False

    def narrows(self, query: Query) -> bool:
        """Whether a lookup is worth it."""
        return not query.is_all and len(query.leaves()) <= MOST_LEAVES

    def may_match(self, query: Query, files: DataFrame) -> DataFrame:
        """(path) of those of ``files`` that may match: candidates, and what the index doesn't know in its present state.

        ``files`` has path and STATE; a file that is new, changed or taken back
        in since the index was built is searched whatever the index says of it.
        """
        strange = state(files, "s").join(state(self.files.filter("live"), "s"), ["path", "s"], "left_anti").select("path")
        return self.candidates(query).select("path").unionByName(strange).distinct()

    def share(self, query: Query) -> float:
        """The share of files that a condition is thought to leave; an index that keeps no counts hopes for the best."""
        return 1.0 if query.is_all else 0.0

    def freshness(self, rows: DataFrame, corpus: Corpus) -> DataFrame:
        """``rows`` (path) with ``changed``: whether the file is another than the index knows; an extension."""
        now = state(corpus.files, "is").join(state(self.files.filter("live"), "was"), "path", "left")
        same = F.coalesce(F.col("is") == F.col("was"), F.lit(False))
        return rows.join(now.select("path", (~same).alias("changed")), "path", "left")

    def with_delta(self, query: Query, toggled: DataFrame, keep: Column | None = None) -> DataFrame:
        """(path): candidates, and of a wider listing ``toggled`` (path) what the index does not hold live."""
        inside = self.candidates(query, keep).select("path")
        outside = toggled.select("path").join(self.files.filter("live"), "path", "left_anti")
        return inside.unionByName(outside if keep is None else outside.filter(keep)).distinct()

    def stats(self) -> DataFrame:
        """One row: live files, distinct trigrams, postings."""
        zero = F.lit(0).cast("long")
        files = self.files.agg(F.count_if("live").alias("files"), zero.alias("trigrams"), zero.alias("postings"))
        tri = self.postings.groupBy("tri").count().agg(zero.alias("files"), F.count("*").alias("trigrams"), F.coalesce(F.sum("count"), zero).alias("postings"))
        return files.unionByName(tri).agg(*[F.sum(c).alias(c) for c in ("files", "trigrams", "postings")])  # of two rows

    def reconcile(self, listing: DataFrame, by: str = "stat") -> DataFrame:
        """(path, kind) of what a listing (path, size, mtime_ns[, digest]) has new, changed or removed.

        Files are the same if size and time are, and the digest where both sides have
        it; with ``by="digest"`` if that is.
        """
        return changes(self.files.filter("live"), listing, by)

    def apply(self, diff: DataFrame, corpus: Corpus) -> Index:
        """The index after ``diff``: postings of new and changed files from ``corpus``, removed ones kept as not live.

        Paths keep their ids; a new path gets a hash of itself, so ids are right whatever
        the corpus calls its files.
        """
        fresh = corpus.files.join(diff.filter("kind <> 'removed'").select("path"), "path", "left_semi")
        gone = diff.filter("kind = 'removed'").select("path", F.lit(True).alias("gone"))
        old = self.files.select("path", F.col("file_id").alias("old_id"))
        # the path's hash and not the corpus's id: a folder or table of another day may number its files anew
        new_id = F.xxhash64(F.lit(17), "path").bitwiseAND(F.lit((1 << 63) - 1))
        placed = fresh.join(old, "path", "left").withColumn("file_id", F.coalesce("old_id", new_id)).drop("old_id")
        kept = self.files.join(fresh.select("path"), "path", "left_anti").join(gone, "path", "left")
        kept = kept.withColumn("live", F.col("live") & F.col("gone").isNull()).select(FILE_COLUMNS)
        files = kept.unionByName(placed.select(FILE_COLUMNS))
        touched = placed.select("file_id").unionByName(kept.filter("not live").select("file_id"))
        return Index(files, self.postings.join(touched, "file_id", "left_anti").unionByName(extract(placed)), None if corpus.root else corpus)


def changes(old: DataFrame, new: DataFrame, by: str = "stat") -> DataFrame:
    """(path, kind) between two listings by a full outer join; kind is new, changed or removed."""
    if by == "digest":
        a, b = (x.select("path", F.struct("digest").alias(n)) for x, n in ((old, "was"), (new, "is")))
    else:
        both = "digest" in old.columns and "digest" in new.columns
        a, b = state(old, "was", both), state(new, "is", both)
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind")).filter("kind is not null")


def _folder() -> Column:
    return F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("")).alias("folder")


def folder_digests(files: DataFrame) -> DataFrame:
    """(folder, n, digest): how many files stand right in a folder, and a digest of their names and states in any order."""
    each = state(files, "s").select(_folder(), F.xxhash64("path", "s").alias("h"))
    return each.groupBy("folder").agg(F.count("*").alias("n"), F.struct(F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y")).alias("digest"))


def changes_by_folder(old: DataFrame, new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, kind) as by ``changes``; only files of folders whose digests differ are compared.

    ``known`` are the digests of ``old`` where they were kept, so that what is unchanged is read on one side only.
    """
    a = (folder_digests(old) if known is None else known).select("folder", F.struct("n", "digest").alias("was"))
    b = folder_digests(new).select("folder", F.struct("n", "digest").alias("is"))
    differ = a.join(b, "folder", "full_outer").filter(~F.col("was").eqNullSafe(F.col("is"))).select("folder")
    inside = lambda files: files.select("*", _folder()).join(differ, "folder", "left_semi").drop("folder")
    return changes(inside(old), inside(new))


def tombstone(files: DataFrame, paths: DataFrame) -> DataFrame:
    """``files`` with those of ``paths`` not live."""
    gone = paths.select("path", F.lit(True).alias("gone")).distinct()
    return files.join(gone, "path", "left").withColumn("live", F.col("live") & F.col("gone").isNull()).select(files.columns)


def bitmaps(postings: DataFrame) -> DataFrame:
    """(tri, bucket, bits): the postings as bitmaps of 32,768 file ids each."""
    return postings.groupBy("tri", F.bitmap_bucket_number("file_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("file_id")).alias("bits"))


def bitmap_ids(maps: DataFrame, leaves: list[int], every: bool) -> DataFrame:
    """(bucket, count) of files that hold all (or any) of some trigrams, by set algebra on bitmaps."""
    hit = maps.filter(F.col("tri").isin(leaves))
    if every:
        met = hit.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).filter(F.col("n") == len(set(leaves)))
    else:
        met = hit.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return met.select("bucket", F.bitmap_count("bits").alias("count"))


def state(files: DataFrame, name: str, digests: bool = True) -> DataFrame:
    """(path, ``name``): what tells the state of each file, as one value that can be compared."""
    known = [F.coalesce(c, F.lit(0)).cast("long") for c in STATE if c in files.columns and (digests or c != "digest")]
    return files.select("path", F.struct(*known).alias(name))
