"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of a vocabulary accepted here holds a space mark after another
character, so a merge never crosses from a word into the next space mark, nor
across a line feed that no piece holds. Each distinct word is therefore encoded
once: its characters lie in flat numpy arrays beside those of all other new
words, every round finds each word's best pair by a segmented minimum, merges
the leftmost such pair of every word at the same time, and compacts the arrays,
until no word has a pair left. Words that are longer than ``LONG_WORD``
characters (runs without spaces) merge all places of their best pair in a round,
wherever that is the same as one after another: no pair that arises may come before
those that are left. So one huge run does not cost a round a character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import MEMO_ENTRIES, longs, runs, small_batches, strings

MARK = "▁"
LONG_WORD = 400
_NONE = np.int64(1) << 40
_WORD = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class Codec:
    """Encoder and decoder for one BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        scores = {}
        for i, piece in enumerate(self.pieces):
            if not (i in self.byte_of or i in self.silent or i == self.unknown):
                scores.setdefault(piece, (model.get_score(i), i))
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in scores):
            raise ValueError("pieces of this model cross word borders")
        self.digits = [f"{i}," for i in range(size)]
        self.plain = [p.replace(MARK, " ") for p in self.pieces]
        self.memo: dict[str, tuple[int, str, str]] = {}
        self._tables(scores)

    def _tables(self, scores: dict[str, tuple[float, int]]) -> None:
        """Symbols: ids of pieces, then characters that are no pieces. Pairs: an open hash table."""
        order = {s: r for r, s in enumerate(sorted({s for s, _ in scores.values()}, reverse=True))}
        symbol = {p: i for p, (_, i) in scores.items()}
        extra = sorted({c for p in scores for c in p} - symbol.keys())
        symbol |= {c: len(self.pieces) + k for k, c in enumerate(extra)}
        self.char_symbol = {c: i for c, i in symbol.items() if len(c) == 1}
        self.char_of = {i: c for c, i in self.char_symbol.items()}
        self.base = len(self.pieces) + len(extra)
        pairs = {}
        for piece, (score, made) in scores.items():
            for k in range(1, len(piece)):
                left, right = symbol.get(piece[:k]), symbol.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[score], made)
        self.bits = max(10, int(len(pairs) * 6).bit_length())
        slots = 1 << self.bits
        self.key, self.value = np.full(slots, -1, np.int64), np.full(slots, _NONE, np.int64)
        self.probes = 1
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, at in zip(keys.tolist(), self._slot(keys).tolist()):
            n = 1
            while self.key[at] >= 0:
                at, n = (at + 1) & (slots - 1), n + 1
            rank, made = pairs[key]
            self.key[at], self.value[at] = key, rank << 20 | made
            self.probes = max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank << 20 | merged symbol`` of each pair, or ``_NONE``."""
        keys = left << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int64)
        for _ in range(self.probes):
            hit = self.key[at] == keys
            out[hit] = self.value[at[hit]]
            at = (at + 1) & (len(self.key) - 1)
        return out

    def merge(self, words: list[str], every: bool = False) -> list[list[int]]:
        """Symbols of every word when no pair is left; unknown characters are ``base + code point``.

        With ``every`` a round merges all places of a word's best pair where it may.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = "".join(words)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        unique, inverse = np.unique(points, return_inverse=True)
        of = np.array([self.char_symbol.get(chr(c), self.base + int(c)) for c in unique], np.int64)
        symbols = of[inverse] if len(points) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        found: list[list[int]] = [[] for _ in words]
        self._rounds(symbols, word, found, every)
        return found

    def _every(self, symbols: np.ndarray, word: np.ndarray, pair: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Places that a round merges: of overlapping hits the leftmost ones; only a word's first where a new pair would come before its others."""
        run = np.r_[True, (np.diff(hits) > 1) | (word[hits[1:]] != word[hits[:-1]])]
        nth = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
        chosen = hits[nth % 2 == 0]
        rank, made = pair[chosen] >> 20, pair[chosen] & 0xFFFFF
        merged = symbols.copy()
        merged[chosen] = made
        taken = np.zeros(len(symbols) + 2, bool)
        taken[chosen + 1] = True  # second symbols, which go
        least = np.full(len(chosen), _NONE >> 20)
        # the symbol before, as merges further left leave it, and the one behind, as it stands
        before = np.maximum(chosen - 1 - taken[np.maximum(chosen - 1, 0)], 0)
        some = np.flatnonzero((chosen > 0) & (word[before] == word[chosen]))
        least[some] = self._look(merged[before[some]], made[some]) >> 20
        behind = np.minimum(chosen + 2, len(symbols) - 1)
        some = np.flatnonzero((chosen + 2 < len(symbols)) & (word[behind] == word[chosen]))
        least[some] = np.minimum(least[some], self._look(made[some], symbols[behind[some]]) >> 20)
        first = np.r_[True, word[chosen][1:] != word[chosen][:-1]]
        alone = np.zeros(int(word.max()) + 1, bool)
        alone[word[chosen[least <= rank]]] = True
        return chosen[first | ~alone[word[chosen]]]

    def _rounds(self, symbols: np.ndarray, word: np.ndarray, found: list[list[int]], every: bool) -> None:
        pair = np.full(len(symbols), _NONE, np.int64)
        same = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        pair[same] = self._look(symbols[same], symbols[same + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            rank = pair >> 20
            best = np.minimum.reduceat(rank, starts)
            done = best >= (_NONE >> 20)
            if done.any():
                out = np.repeat(done, sizes)
                values, ends = symbols[out].tolist(), np.cumsum(sizes[done]).tolist()
                at = 0
                for w, end in zip(word[starts[done]].tolist(), ends):
                    found[w] = values[at:end]
                    at = end
                symbols, word, pair, rank = symbols[~out], word[~out], pair[~out], rank[~out]
                best, sizes = best[~done], sizes[~done]
                if not len(symbols):
                    return
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            first = self._every(symbols, word, pair, hits) if every else hits[np.r_[True, word[hits][1:] != word[hits][:-1]]]
            symbols[first] = pair[first] & 0xFFFFF
            keep = np.ones(len(symbols), bool)
            keep[first + 1] = False
            moved = first - np.arange(len(first))
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            for at in (moved, moved[moved > 0] - 1):
                inner = at[at + 1 < len(symbols)]
                inner = inner[word[inner] == word[inner + 1]]
                pair[at[(at + 1 >= len(symbols)) | (word[at] != word[np.minimum(at + 1, len(symbols) - 1)])]] = _NONE
                pair[inner] = self._look(symbols[inner], symbols[inner + 1])

    def _ids(self, symbols: list[int]) -> list[int]:
        if max(symbols, default=0) < len(self.pieces):
            return symbols
        out = []
        for s in symbols:
            if s < len(self.pieces):
                out.append(s)
            else:
                char = self.char_of[s] if s < self.base else chr(s - self.base)
                out += [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]
        return out

    def words(self, text: str) -> list[str]:
        """The parts of the marked text that are encoded on their own."""
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: set[str]) -> None:
        """Encode new words and keep (number of ids, decimal ids with commas, surface)."""
        new = list(words - self.memo.keys())
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            new = list(words)
        short = [w for w in new if len(w) <= LONG_WORD]
        for w, symbols in zip(short, self.merge(short)):
            self.memo[w] = self._kept(symbols)
        for w in new:
            if len(w) > LONG_WORD:
                self.memo[w] = self._kept(self.merge([w], every=True)[0])

    def _kept(self, symbols: list[int]) -> tuple[int, str, str]:
        if max(symbols) < len(self.pieces):  # whole pieces only: each decodes by itself
            return len(symbols), "".join([self.digits[i] for i in symbols]), "".join([self.plain[i] for i in symbols])
        ids = self._ids(symbols)
        return len(ids), "".join([self.digits[i] for i in ids]), self.surface(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        words = self.words(text)
        self.learn(set(words))
        joined = "".join(self.memo[w][1] for w in words)
        return [int(x) for x in joined[:-1].split(",")] if joined else []

    def surface(self, ids: list[int]) -> str:
        """The ids' text before the first space is taken off."""
        out, run = [], bytearray()

        def flush() -> None:
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                del run[:n]

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            flush()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one space of a leading mark is taken off."""
        text = self.surface(ids)
        spoken = next((i for i in ids if i not in self.silent), None)
        return text[1:] if spoken is not None and self.pieces[spoken].startswith(MARK) else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec of a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids`` (array<int>): the ids of ``text``; a null or empty text has none.

    Texts are taken whole, however long, and repeated rows are encoded each; other columns stay.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def of(texts):
        c = codec(path)
        return texts.fillna("").map(c.encode)

    return df.withColumn(ids, of(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give an empty text."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def of(values):
        c = codec(path)
        return values.map(lambda x: c.decode([int(i) for i in x]) if x is not None else "")

    return df.withColumn(text, of(F.col(ids)))


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text; return one digest row for each input row.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256. A null text counts as empty: no ids, and the digests of empty
    strings. Rows are neither joined nor dropped, so ties and repeated rows stay;
    a null doc_id stays null. Other columns are not read.
    """
    small_batches(df.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = strings(batch.column(1))
            n, ids, decoded = [], [], []
            for start, end in runs(texts):
                split = [c.words(t) for t in texts[start:end]]
                c.learn(set().union(*split))
                for words in split:
                    got = list(map(c.memo.__getitem__, words))
                    n.append(sum(x[0] for x in got))
                    ids.append(hashlib.sha256("".join([x[1] for x in got])[:-1].encode()).hexdigest())
                    decoded.append(hashlib.sha256("".join([x[2] for x in got])[1:].encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), longs(n), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
