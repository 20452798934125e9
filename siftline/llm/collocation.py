"""Collocations: phrases of neighbouring words, mined by growing frequent prefixes to the right.

An occurrence is a pointer into a window of a word and the words after it. What
can't be frequent is cut off first: windows end before a word, or a pair, that
is too rare, which a bit table of fixed size tells (it may keep too much, never
too little). Equal windows of a stretch of text are added up and projected to the
frequent prefix they begin with: all pointers of a prefix meet in one task, which
extends it depth first, word by word, as long as a phrase is frequent. A word, or a pair,
that is too frequent for one task gives way to its extensions, each a prefix with a task
of its own. Counts are exact; scores are whole numbers from decimals.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import cut, join_split, longs, small_batches

LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
#: Bytes of a language's text that are split into words at a time, and words whose counts a task holds.
BYTES_AT_ONCE, WORDS_AT_ONCE = 4_000_000, 400_000
#: Bits of the tables of frequent words and pairs: so many for each entry, between two powers of two.
BITS_EACH, FEWEST, MOST = 32, 20, 27
#: Occurrences of a prefix that meet in a task; a prefix of more gives way to its extensions. PREFIXES bounds how many do.
PREFIX_WINDOWS, PREFIXES = 200_000, 10_000
#: Bits of a pair's hash, and words of all text for which pairs are counted in a part of their own.
PAIR_BITS, PART_WORDS = 40, 2_000_000
#: Phrases of a language that are ranked at a time.
RANKED = 200_000

_BORDERS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(raw: bytes) -> list[bytes]:
    """Words and borders; a border is a full stop, which no word holds."""
    return raw.replace(b".", b" . ").split()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch (lang, text) by language, some at a time; texts and their parts end at borders."""
    of: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        of[lang].append((text or "").encode("utf-8", "surrogatepass").lower().translate(_BORDERS))
    for lang, parts in of.items():
        raw = b".".join(parts)
        at = 0
        while at < len(raw):
            end = raw.find(b".", at + BYTES_AT_ONCE)
            end = len(raw) if end < 0 else end
            yield lang, raw[at:end]
            at = end


def _strings(values: Sequence[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f): how often each word stands, and under a null phrase how many words a language has."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            columns = [pa.array([lang] * (len(c) + 1)), pa.concat_arrays([_strings(list(c)), pa.nulls(1, pa.string())]), longs([*c.values(), c.total()])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, raw in _texts(batch):
                counts[lang].update(_words(raw))
                del counts[lang][b"."]
            if sum(map(len, counts.values())) > WORDS_AT_ONCE:
                yield from rows(counts)
                counts.clear()
        yield from rows(counts)

    return texts.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """A table of 2^bits bits, those of the rows' ``slot`` set; it has a fixed size however many rows there are."""
    size = 1 << 15
    parts = slots.groupBy(F.floor(F.col("slot") / size).alias("k")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(size))).alias("b"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        out[r["k"] * size // 8 : (r["k"] + 1) * size // 8] = np.frombuffer(r["b"], np.uint8)
    return out


def _bits(entries: int) -> int:
    return min(MOST, max(FEWEST, (entries * BITS_EACH).bit_length()))


def _is_set(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1


class _Numbers(dict):
    """Numbers of a language's words by word, made when first asked for; -1 for borders and rare words."""

    def __init__(self, lang: str, table: np.ndarray):
        super().__init__({b".": -1})
        self.start, self.table, self.down = zlib.crc32(lang.encode() + b" "), table, 32 - (len(table) * 8).bit_length() + 1
        self.words: list[bytes] = []
        self.seed = zlib.crc32(lang.encode(), 7)

    def __missing__(self, word: bytes) -> int:
        slot = zlib.crc32(word, self.start) >> self.down
        number = -1
        if self.table[slot >> 3] >> (slot & 7) & 1:
            number = len(self.words)
            self.words.append(word)
        self[word] = number
        return number

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in self.words), np.uint64, len(self.words))


def _numbered(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """Of some text at a time: its language, its frequent words, the word's number at each place or -1, and the hash of each pair of places."""
    for batch in batches:
        for lang, raw in _texts(batch):
            words, numbers = _words(raw), _Numbers(lang, table)
            at = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            h = numbers.hashes()
            if len(at) > 1 and len(h):
                a, b = h[at[:-1]], h[at[1:]]  # of a rare word any hash; such pairs are not asked for
                pair = (a * _MIX ^ (a >> np.uint64(31))) + b
                pair = (pair ^ (pair >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                yield lang, numbers.words, at, pair ^ (pair >> np.uint64(27))


def pair_counts(texts: DataFrame, table: np.ndarray, words: int, least: int) -> DataFrame:
    """(h, f): the pairs of neighbouring frequent words that stand ``least`` times, by a hash; colliding pairs count together.

    A stretch of text sends its pairs sorted, as differences in planes of bytes, a row for
    each part of the hashes; there are as many parts as ``words`` (of all text) asks for.
    """
    shared = texts.sparkSession.sparkContext.broadcast(table)
    bits = min(30, max(4, (words // PART_WORDS).bit_length()))
    planes = lambda x: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    plain = lambda b: np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, at, pair in _numbered(batches, shared.value):
            h, n = np.unique(pair[(at[:-1] >= 0) & (at[1:] >= 0)] >> np.uint64(64 - PAIR_BITS), return_counts=True)
            part = (h >> np.uint64(PAIR_BITS - bits)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(h) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(h)]
            rows = [(planes(np.diff(h[a:b], prepend=np.uint64(0))), planes(n[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["part", "h", "n"])

    def added(h: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate(h), return_inverse=True) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys[total >= least].astype(np.int64)), longs(total[total >= least])], ["h", "f"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n = None, [], []
        for batch in batches:
            for part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and h:
                    yield added(h, n)
                    h, n = [], []
                now = part
                h.append(np.cumsum(plain(keys)))
                n.append(plain(counts))
        yield added(h, n)

    dealt = texts.mapInArrow(count, "part int, h binary, n binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, "h long, f long")


def windows(texts: DataFrame, words: np.ndarray, pairs: np.ndarray, hot: set[tuple[str, bytes]] = frozenset(), hot_pairs: Sequence[int] = (), longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f, depth): a word and the words after it, up to ``longest`` in all, as often as they stand in a stretch of text.

    A window ends before the first pair that is too rare; a word whose own pair is has none.
    ``depth`` tells how many of its words are the prefix whose task extends it: one, two if
    the word is ``hot``, all if the pair is too.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words, pairs, hot, np.array(sorted(hot_pairs), np.uint64)))
    down, short = np.uint64(64 - (len(pairs) * 8).bit_length() + 1), np.uint64(64 - PAIR_BITS)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, hot, hot_pairs = shared.value
        for lang, known, at, pair in _numbered(batches, words):
            fine = (at[:-1] >= 0) & (at[1:] >= 0) & _is_set(pairs, (pair >> down).astype(np.int64))
            (start,) = np.nonzero(fine)
            far = np.r_[at, np.full(longest, -1, np.int32)]
            fine = np.r_[fine, np.zeros(longest, bool)]
            key, on = np.zeros(len(start), np.int64), np.ones(len(start), bool)
            places = [at[start]]
            for k in range(1, longest):
                on = on & fine[start + k - 1]
                places.append(np.where(on, far[start + k], -1))
            for p in places:  # exact: a window's rank is built from that of its head
                _, key = np.unique(key * (len(known) + 1) + p + 1, return_inverse=True)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            grid = np.stack(places, 1)[first]
            depth = np.ones(len(first), np.int8)
            if hot:
                often = np.array([(lang, w) in hot for w in known], bool)[grid[:, 0]]
                depth[often] = np.where(np.isin(pair[start[first]] >> short, hot_pairs), longest, 2)[often]
            phrases = [b" ".join([known[x] for x in row if x >= 0]) for row in grid.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), _strings(phrases), longs(n), pa.array(depth)], ["lang", "phrase", "f", "depth"])

    return texts.mapInArrow(project, "lang string, phrase string, f long, depth byte")


def grow(rows: list[list[str]], counts: list[int], pointers: Sequence[int], depth: int, least: int, longest: int) -> Iterator[tuple[list[str], int]]:
    """The frequent extensions of a prefix of ``depth`` words, depth first, from the pointers to its windows."""
    after: dict[str, list[int]] = defaultdict(list)
    for p in pointers:
        if len(rows[p]) > depth:
            after[rows[p][depth]].append(p)
    for at in after.values():
        f = sum(counts[p] for p in at)
        if f >= least:
            yield rows[at[0]][: depth + 1], f
            if depth + 1 < longest:
                yield from grow(rows, counts, at, depth + 1, least, longest)


def mined(found: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f) of all frequent phrases of two words or more, from their windows.

    A prefix whose task doesn't see all windows of a shorter one sends its share of that one's count.
    """

    def one(lang: str, depth: int, told: list[list[str]], counts: list[int], out: list) -> None:
        seed = told[0][:depth]
        total = sum(counts)
        # only a whole window is a prefix of more than two words; of the shorter ones it is a part
        out += [(lang, " ".join(seed[:k]), total) for k in range(2, len(seed) + 1) if k < depth or total >= least]
        out += [(lang, " ".join(w), f) for w, f in grow(told, counts, range(len(told)), len(seed), least, longest)]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, told, counts, out = None, [], [], []
        for batch in batches:
            for lang, phrase, f, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = phrase.split(" ")
                if key != (lang, words[:depth]):
                    if told:
                        one(key[0], held, told, counts, out)
                    key, held, told, counts = (lang, words[:depth]), depth, [], []
                told.append(words)
                counts.append(f)
            yield _phrases(out)
            out = []
        if told:
            one(key[0], held, told, counts, out)
        yield _phrases(out)

    seed = F.expr("substring_index(phrase, ' ', depth)")
    dealt = found.select("lang", "phrase", "f", "depth").repartition("lang", seed).sortWithinPartitions("lang", seed)
    return dealt.mapInArrow(extend, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _phrases(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "f"])


def scored(phrases: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r and score of every phrase, by its worst cut (the first of equals).

    A cut's parts are frequent themselves, so their counts are among the mined ones; they are
    joined in parts where many phrases share a part.
    """
    size = F.size(F.split("phrase", " "))
    of = phrases.select("lang", "phrase", F.col("f").alias("a"), size.alias("__size"))
    parts = [
        F.when(F.col("__size") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), text.alias("part")))
        for k in range(1, longest)
        for side, text in (("l", F.substring_index("phrase", " ", k)), ("r", F.expr(f"substring_index(phrase, ' ', {k} - __size)")))
    ]
    asked = cut(of.select("lang", "phrase", "a", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("c")).select("lang", "phrase", "a", "c.*"))
    times = asked.groupBy("lang", "part").agg(F.count("*").alias("__times"))
    known = phrases.unionByName(words).withColumnRenamed("phrase", "part").join(times, ["lang", "part"])
    told = join_split(asked, known, ["lang", "part"], "__times", asked.count(), written=True)
    cell = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = told.groupBy("lang", "phrase", "a").agg(*[cell(k, side) for k in range(1, longest) for side in ("l", "r")])
    score = lambda k: F.expr(f"cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0))) as bigint)")
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    return wide.withColumn("c", F.array_min(F.array(*cuts))).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def covered(phrases: DataFrame, percent: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase) of phrases whose words stand in a longer phrase that is nearly as frequent."""
    words = F.split("phrase", " ")
    spans = [(start, n) for n in range(2, longest) for start in range(1, longest - n + 2)]
    inner = [F.when((F.size(words) > n) & (F.size(words) >= start + n - 1), F.array_join(F.slice(words, start, n), " ")) for start, n in spans]
    inside = phrases.select("lang", F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull())).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("__most"))
    enough = F.expr(f"cast(100 as decimal(3,0)) * cast(__most as decimal(19,0)) >= cast({percent} as decimal(3,0)) * cast(f as decimal(19,0))")
    return phrases.join(inside, ["lang", "phrase"]).filter(enough).select("lang", "phrase")


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language with their rank; many phrases of a language are ranked in parts first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = rows.count() // RANKED + 1
    if parts > 1:
        some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    ``a`` counts a phrase, ``l`` and ``r`` the parts of its worst cut, ``n`` the language's
    words. Phrases that a longer one covers are left out. A null language is ``und``, null
    and empty texts have no words, repeated rows count each, and ties go to the more frequent
    phrase, then to the smaller one. An empty table, or one without frequent phrases, gives none.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = cut(word_counts(texts).filter((F.col("f") >= least) | F.col("phrase").isNull()))
    words = counts.filter("phrase is not null")
    bits = _bits(words.count())
    key = F.crc32(F.concat("lang", F.lit(" "), "phrase").cast("binary"))
    frequent = bit_table(words.select(F.shiftrightunsigned(key, 32 - bits).alias("slot")), bits)
    total = counts.filter("phrase is null").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    each = max(PREFIX_WINDOWS, total // PREFIXES + 1)  # so at most PREFIXES words, and pairs, are more frequent
    pairs = cut(pair_counts(texts, frequent, total, least))
    bits = _bits(pairs.count())
    fine = bit_table(pairs.select(F.shiftrightunsigned("h", PAIR_BITS - bits).alias("slot")), bits)
    hot = {(r["lang"], r["phrase"].encode()) for r in words.filter(F.col("f") > each).collect()}
    hot_pairs = [r["h"] for r in pairs.filter(F.col("f") > each).collect()] if hot else []
    phrases = cut(mined(windows(texts, frequent, fine, hot, hot_pairs, longest), least, longest))
    chosen = best(cut(scored(phrases, words, longest).join(covered(phrases, longest=longest), ["lang", "phrase"], "left_anti")), top)
    totals = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    return chosen.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
