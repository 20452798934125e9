"""Best-fit packing of tokenised documents, certified by lower bounds.

Every document becomes token ids and an end id; only documents longer than a
sequence are cut. Short pieces are dealt into partitions by a hash and each is
packed by best-fit decreasing. Dual-feasible functions give a lower bound of the
bins that a partition's sizes need: where the packing meets it, the partition is
certified and stays. A partition with a gap gives up its emptiest bins; the
documents of all such bins are exchanged (dealt anew over fewer partitions) and
packed again, until the whole is certified, one partition was left, or a round
gains nothing. A round that would need more sequences than before is not taken.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import MEMO_ENTRIES, cut, longs, runs, small_batches, strings

#: Short pieces in a partition that one task packs.
ITEMS = 100_000
#: Bins that a partition releases for each bin above its bound, and besides.
RELEASE, RELEASE_LEAST = 8, 32

_PART = re.compile("[ \n][^ \n]*|[^ \n]+")
_TIGHT = re.compile(r"\s[ \n](?:\s|\Z)")
_BORDER = re.compile(r"(?=(?<=\S)[ \n])|(?=[ \n]\S)")
_PLAIN = re.compile("[\x00-ɏ]*")


class ByteBpe:
    """Ids of a ``tokenizers`` byte-level BPE file, each distinct part of text encoded once.

    Parts begin at a space or line feed that stands beside a visible character,
    where the byte-level pattern always begins a new word too. Parts of Latin
    letters are encoded together by tiktoken with the file's own vocabulary;
    all others by the tokenizers library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", ())}
        # as in the library, the text of a special token is that token, and text ends before it and begins anew after it
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        ranks = {_bytes(token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.memo: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after another, are the text's ids."""
        if self.special and self.special.search(text):
            return [p for i, x in enumerate(self.special.split(text)) if x for p in ([x] if i % 2 else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return [x for x in _BORDER.split(text) if x] if _TIGHT.search(text) else _PART.findall(text)

    def learn(self, parts: set[str]) -> None:
        new = parts - self.memo.keys()
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            new = parts
        plain = [p for p in new if p[0] in " \n" and len(p) > 1 and not p[-1].isspace() and not p[1].isspace() and _PLAIN.fullmatch(p)]
        if plain:
            ids = np.array(self.fast.encode_ordinary("".join(plain)), np.uint32)
            ends = np.cumsum(self.width[ids])
            at = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in plain]), side="left") + 1
            raw, start = ids.astype("<u4").tobytes(), 0
            for p, end in zip(plain, at.tolist()):
                self.memo[p] = raw[4 * start : 4 * end]
                start = end
        for p in new.difference(plain):
            self.memo[p] = np.array(self.exact.encode(p, add_special_tokens=False).ids, "<u4").tobytes()

    def raw(self, parts: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids of learnt parts."""
        return b"".join(map(self.memo.__getitem__, parts))


def _bytes(token: str) -> bytes:
    """The bytes that a byte-level vocabulary entry stands for."""
    global _byte_of
    if not _byte_of:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        _byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return bytes(_byte_of[c] for c in token)


_byte_of: dict[str, int] = {}
_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Token pieces of all rows: key (unique), doc_id, piece, start, length, ids_crc32 (and ids, binary).

    Null and empty texts are the end id alone, a text of any length is cut into pieces of
    ``capacity``, repeated rows are documents of their own, and an empty table has no piece.
    """
    small_batches(df.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, row = byte_bpe(path), TaskContext.get().partitionId() << 36
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = strings(batch.column(1))
            out = [[] for _ in range(6)]
            origin = []
            for begin, end in runs(texts):
                split = [bpe.parts(t) for t in texts[begin:end]]
                bpe.learn(set().union(*split))
                for k, parts in enumerate(split, begin):
                    raw = memoryview(bpe.raw(parts) + tail)
                    total = len(raw) // 4
                    start, length = 0, total % capacity or capacity
                    piece = 0
                    while start < total:
                        part = raw[4 * start : 4 * (start + length)]
                        for values, x in zip(out, (row, piece, start, length, zlib.crc32(part), part.tobytes() if ids else None)):
                            values.append(x)
                        origin.append(k)
                        row, piece, start, length = row + 1, piece + 1, start + length, capacity
            columns = [longs(out[0]), batch.column(0).take(pa.array(origin, pa.int64())), pa.array(out[1], pa.int32()), *map(longs, out[2:5])]
            names = ["key", "doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(out[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(cut_up, "key long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that sizes need at least; ``counts[s]`` is the number of items of size s.

    The largest of the plain sum, the threshold functions (items above
    ``capacity - e`` count as whole bins and items below e as nothing, for every
    e) and the rounding functions u(k) for k up to 32; each is dual feasible.
    """
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    below = np.cumsum(counts * size)
    above = counts[::-1].cumsum()[::-1]
    e = np.arange(1, capacity // 2 + 1)
    whole = above[capacity - e + 1]
    middle = below[capacity - e] - below[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.

    Bins stand in lists by free space; a bit mask of the spaces in use finds the
    tightest that fits. Equal sizes keep their order.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    order = np.argsort(-sizes, kind="stable")
    put, places = [], []
    for s in sizes[order].tolist():
        fits = mask >> s
        if fits:
            space = (fits & -fits).bit_length() - 1 + s
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            space, b, n = capacity, n, n + 1
        put.append(b)
        places.append(capacity - space)
        if left := space - s:
            free[left].append(b)
            mask |= 1 << left
    bins[order], offsets[order] = put, places
    return bins, offsets, n


_STATE = "key long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _packed(pool: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """Pack each of ``parts`` partitions of the pool; ``open`` marks what it releases."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        sizes = table["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        gap = n - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        released = np.zeros(n, bool)
        if gap > 0:
            space = capacity - np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
            released[np.argsort(-space, kind="stable")[: RELEASE * gap + RELEASE_LEAST]] = True
        part = table["part"][0].as_py()
        ids = (round_ << 52) | (part << 26) | bins
        kept = table.select(["key", "doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("open", pa.array(released[bins]))

    dealt = pool.withColumn("part", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(pack, _STATE)


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", items: int = ITEMS) -> DataFrame:
    """Pack the documents of ``df`` into sequences of at most ``capacity`` tokens.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are the end id alone. Repeated rows and rows without a
    doc_id are documents of their own. An empty table gives no rows; further
    columns are not read.
    """
    all_pieces = cut(pieces(df, path, capacity, end_id, doc_id, text))
    full = all_pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")})
    pool = all_pieces.filter(F.col("length") < capacity)
    done, before, round_ = [full], None, 0
    while True:  # each round but the last saves a sequence
        round_ += 1
        count = pool.count()
        parts = max(1, math.ceil(count / items))
        state = cut(_packed(pool, parts, round_, capacity), count)
        bins = state.agg(F.count_distinct("sequence_id")).first()[0]
        if before is not None and bins > before[1]:
            done.append(before[0])
            break
        if before is not None and bins == before[1]:
            done.append(state)
            break
        opened = state.filter("open")
        left = opened.agg(F.count_distinct("sequence_id")).first()[0]
        if not left or parts == 1 and round_ > 1:
            done.append(state)
            break
        done.append(state.filter("not open"))
        before, pool = (opened, left), opened
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = done[0].select(columns)
    for x in done[1:]:
        out = out.unionByName(x.select(columns))
    return out
