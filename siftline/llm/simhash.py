"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

Distinct fingerprints are cut into blocks of bits. Two fingerprints that differ
in at most d bits agree on all but d blocks, so each is filed once for every
choice of ``BLOCKS - d`` blocks under the bits of these. Within a file the
fingerprints stand in the order of their Gray rank, and a tree of groups stands
above them: each node holds the mask of bits that all its members share and the
shared pattern. Two nodes whose shared bits already differ in more than d places
are pruned with all below them; a node whose members differ in at most d bits in
all is linked as a whole, without looking at pairs. A task emits a forest, not
its pairs: one edge at most for each fingerprint. Components of the edges come
from alternating large-star and small-star rounds over tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, join_split, small_batches, strings

#: Blocks of bits; with d differing bits each fingerprint is filed C(BLOCKS, d) times.
BLOCKS = 5
#: Members of a leaf of the tree, and children of a node.
LEAF, FANOUT = 8, 8
#: Pairs of nodes or fingerprints that are compared at a time.
AT_ONCE = 1 << 21
#: Fingerprints that a task links at a time; a file is never parted, so a larger one is linked by itself.
FILED_AT_ONCE = 1 << 20
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text: bit b is set where over half the shingle hashes have it.

    A-Z are lower-cased; words stand between ASCII white space; a text of fewer
    words is one shingle, and one without words has fingerprint 0.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[: n - 1]].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 18):
        part = hashes[at : at + (1 << 18)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * count > n).tolist()))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, keep: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and column ``keep`` of every row; null texts count as empty."""
    small_batches(df.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *more])

    more = [keep] if keep else []
    kind = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in more)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *more).mapInArrow(of, "doc_id long, fp long" + kind)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in the reflected Gray order."""
    out = values.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> np.uint64(shift))
    return out


class _Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _level(starts: np.ndarray, masks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared mask and pattern of runs of nodes that begin at ``starts``."""
    first = np.repeat(values[starts], np.diff(np.r_[starts, len(values)]))
    differs = np.bitwise_or.reduceat((values ^ first) | ~masks, starts)
    return ~differs, values[starts] & ~differs


def link(fps: np.ndarray, files: np.ndarray, most: int) -> _Forest:
    """Forest over positions: all pairs of one file at up to ``most`` differing bits are connected.

    ``fps`` are uint64, sorted by (file, Gray rank); equal fingerprints do not occur in a file.
    """
    forest = _Forest(len(fps))
    if len(fps) < 2:
        return forest
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    # levels[0] are single fingerprints; above, runs of nodes of one file
    levels = [(np.arange(len(fps)), files, np.full(len(fps), ones), fps)]
    size = LEAF
    while True:
        starts, file, mask, value = levels[-1]
        head = np.r_[True, file[1:] != file[:-1]]
        if head.all():
            break
        within = np.arange(len(file)) - np.maximum.accumulate(np.where(head, np.arange(len(file)), 0))
        runs_ = np.flatnonzero(within % size == 0)
        shared, pattern = _level(runs_, mask, value)
        levels.append((runs_, file[runs_], shared, pattern))
        size = FANOUT
    top = len(levels) - 1
    stack = [(top, np.arange(len(levels[top][0])), np.arange(len(levels[top][0])))]
    while stack:
        depth, a, b = stack.pop()
        _, _, mask, value = levels[depth]
        if depth == 0:
            near = (a != b) & (np.bitwise_count(value[a] ^ value[b]) <= most)
            for x, y in zip(a[near].tolist(), b[near].tolist()):
                forest.join(x, y)
            continue
        far = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) > most
        a, b = a[~far], b[~far]
        below = levels[depth][0]
        bounds = np.r_[below, len(levels[depth - 1][0])]
        tight = (a == b) & (np.bitwise_count(~mask[a]) <= most)
        if tight.any():
            lo, hi = bounds[a[tight]], bounds[a[tight] + 1]
            for d in range(depth - 1, 0, -1):
                inner = np.r_[levels[d][0], len(levels[d - 1][0])]
                lo, hi = inner[lo], inner[hi]
            for x, y in zip(lo.tolist(), hi.tolist()):
                for z in range(x + 1, y):
                    forest.join(x, z)
            a, b = a[~tight], b[~tight]
        if not len(a):
            continue
        wide = (bounds[a + 1] - bounds[a]) * (bounds[b + 1] - bounds[b])
        cuts = np.flatnonzero(np.diff(np.cumsum(wide) // AT_ONCE)) + 1
        for aa, bb in zip(np.split(a, cuts), np.split(b, cuts)):
            na, nb = bounds[aa + 1] - bounds[aa], bounds[bb + 1] - bounds[bb]
            total = na * nb
            pair = np.repeat(np.arange(len(aa)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            x = bounds[aa][pair] + k // nb[pair]
            y = bounds[bb][pair] + k % nb[pair]
            keep = x <= y
            stack.append((depth - 1, x[keep], y[keep]))
    return forest


def edges(classes: DataFrame, most: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect just what links within ``most`` bits connect."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - most):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    filed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])).alias("f"))
    # sorted by Spark, which can spill, so that a task holds some files at a time and not all of its own
    dealt = filed.select("fp", "f.choice", "f.bits").repartition("choice", "bits").sortWithinPartitions("choice", "bits")

    def linked(fps: np.ndarray, file: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fps), file))
        fps, file = fps[order], file[order]
        forest = link(fps, file, most)
        roots = np.array([forest.find(i) for i in range(len(fps))], np.int64) if len(fps) else np.zeros(0, np.int64)
        child = np.flatnonzero(roots != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[child].view(np.int64)), pa.array(fps[roots[child]].view(np.int64))], ["a", "b"])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # fingerprints and files, numbered in order
        last, number, size = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fps, choice, bits = (batch.column(k).to_numpy() for k in range(3))
            new = np.r_[last != (choice[0], bits[0]), (bits[1:] != bits[:-1]) | (choice[1:] != choice[:-1])]
            file = number + np.cumsum(new)
            last, number, size = (choice[-1], bits[-1]), int(file[-1]), size + len(fps)
            held.append((fps.view(np.uint64), file))
            if size >= FILED_AT_ONCE:
                fps, file = (np.concatenate(x) for x in zip(*held))
                whole = file < number  # the last file may go on
                yield linked(*_shared(fps[whole], file[whole]))
                held, size = [(fps[~whole], file[~whole])], int((~whole).sum())
        if held:
            yield linked(*_shared(*(np.concatenate(x) for x in zip(*held))))

    return dealt.mapInArrow(connect, "a long, b long").distinct()


def _shared(fps: np.ndarray, file: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without files of one fingerprint, which link nothing; ``file`` ascends."""
    new = np.r_[True, file[1:] != file[:-1]][: len(file)]
    some = np.flatnonzero(~new | np.r_[~new[1:], False][: len(file)])
    return fps[some], file[some]


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes of ``links`` (a, b).

    Large-star rounds tie every node's larger neighbours to its smallest one,
    small-star rounds its smaller ones; stars are left after few rounds. The
    smallest neighbour is an aggregate, and a node of many edges meets it in parts.
    ``rows`` is a bound of the number of links, if one is known.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, mark = cut(links, rows), None
    while True:
        # the count of rows and their hashes tell whether a round changed them; stars never have more rows
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == now:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark, total = now, now[0]
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("times")).filter("times > 0")
        large = join_split(both.filter("b > a"), least, ["a"], "times", total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times"))
        tied = join_split(large, small, ["a"], "times", total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = cut(tied.filter("a != b").distinct(), total)


def _classes(rows: DataFrame, total: int, most: int, first) -> DataFrame:
    """(fp, times, and by component the least ``first`` as ``chosen``) of the distinct fingerprints of ``total`` rows."""
    classes = cut(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("times")), total)
    roots = components(edges(classes.select("fp"), most), total).withColumnRenamed("node", "fp")
    placed = cut(classes.join(roots, "fp", "left").select("fp", "times", "first", F.coalesce("root", "fp").alias("root")), total)
    chosen = placed.groupBy("root").agg(F.min("first").alias("chosen"), F.count("*").alias("members"))
    return join_split(placed, chosen, ["root"], "members", total).select("fp", "times", "chosen")


def near_duplicates(df: DataFrame, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Rows link where fingerprints differ in at most ``most`` bits; null and empty
    texts have fingerprint 0 and link like any other. Repeated rows stay; a null
    doc_id is never a component_id unless its group has no other id. Other
    columns are not read.
    """
    rows = cut(fingerprints(df, doc_id, text))
    total = rows.count()
    named = _classes(rows, total, most, F.min("doc_id"))
    return join_split(rows, named, ["fp"], "times", total, written=True).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("chosen").alias("component_id"))


def keep_first(df: DataFrame, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of near duplicates: that of the smallest doc_id, there the text of the least hash.

    Rows that share a doc_id are told apart by their texts, so each group keeps one of
    its own; rows with the same doc_id and the same text are one. Null and empty texts
    are near duplicates of each other. Rows without a doc_id cannot be named and stay.
    An empty table gives none; all columns stay.
    """
    told = F.struct(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("x"), F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit(""))).alias("y"))
    rows = cut(_with_key(fingerprints(df.filter(F.col(doc_id).isNotNull()).withColumn("__key", told), doc_id, text, keep="__key")))
    kept = _classes(rows, rows.count(), most, F.min(F.struct("doc_id", "x", "y"))).select("chosen.*").distinct()
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    marked = df.withColumns({"__x": told["x"], "__y": told["y"]})
    named = marked.join(kept, (F.col(doc_id).cast("long") == F.col("__id")) & marked["__x"].eqNullSafe(kept["__x"]) & marked["__y"].eqNullSafe(kept["__y"]), "left_semi")
    named = named.dropDuplicates([doc_id, "__x", "__y"])
    return named.select(df.columns).unionByName(df.filter(F.col(doc_id).isNull()))


def _with_key(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "fp", "__key.x", "__key.y")
