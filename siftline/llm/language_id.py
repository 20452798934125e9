"""Language identification by cross-parsing with suffix automata.

A suffix automaton of each language's labelled text tells the longest prefix of
a string that occurs anywhere in that text. Parsing a new text greedily into
such longest matches takes few phrases under its own language and many under
others; a phrase of a language costs the logarithm of its labelled text's size
in bits. A text is its words, lower-cased, with one space around each, so matches
run on across words. All texts of a batch are parsed side by side: they are cut
into lanes of ``LANE`` symbols, at whose ends a phrase ends under every language,
and one step takes the next symbol of all lanes through all automata, whose edges
lie in one open hash table.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import code_points, crc_mod, kinds, runs, sample_per_class, small_batches, strings

#: Labelled documents sampled for each language, and characters of its automaton, shared out among all of them.
DOCS_EACH, CHARS_EACH = 120, 40_000
#: A sampled document that is longer than its share gives stretches of so many characters from its whole length.
STRETCH = 200
#: Unknown text costs this many times the bits a letter that QUANTILE of its language's held-out labelled texts stay below.
STRANGE, QUANTILE = 1.5, 0.95
#: Phrases that any text may take beyond that: a name or a number among few words makes no language strange.
SLACK = 6
#: Of each so many sampled documents one stays out of the automaton, to tell the costs of unseen text.
HELD_OF = 4
#: Symbols of a lane.
LANE = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.uint32(32)


def automaton(text: str) -> dict[int, int]:
    """Transitions ``state << 21 | code point`` -> state of the suffix automaton of ``text``."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in map(ord, text):
        here = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = here
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return {s << 21 | c: t for s, out in enumerate(edges) for c, t in out.items()}


def phrases(moves: dict[int, int], text: str) -> int:
    """Longest-match phrases that a greedy parse of one lane takes, symbol by symbol; an unknown character is one."""
    n = state = 0
    for c in map(ord, text):
        to = moves.get(state << 21 | c)
        if to is None:
            n += state > 0
            to = moves.get(c)
            if to is None:
                n, to = n + 1, 0
        state = to
    return n + (state > 0)


def words_only(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts: letters with their combining marks, a space around each word; then the text of each symbol and the letters of each text."""
    points, text = code_points(texts)
    kind = kinds(points)
    # a mark belongs to a word only if a letter stands before it
    at = np.flatnonzero((kind == 1) | (kind == 5))
    if len(at):
        first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        lead = np.repeat(at[first], np.diff(np.r_[first, len(at)]))
        bare = np.maximum.accumulate(np.where(kind[at] == 1, at, -1)) < lead
        at = at[~bare]
    letters = np.bincount(text[at[kind[at] == 1]], minlength=len(texts))
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int32), letters
    new = np.r_[True, np.diff(at) > 1]
    last = np.r_[text[at[1:]] != text[at[:-1]], True]
    size = 1 + new + last
    place = np.cumsum(size) - 1 - last
    out = np.full(int(size.sum()), _SPACE, np.uint32)
    out[place] = points[at]
    return out, np.repeat(text[at], size), letters


def excerpt(text: str, most: int) -> str:
    """``text`` if it is short enough, else stretches evenly spaced over its whole length."""
    if len(text) <= most:
        return text
    n = max(1, most // STRETCH)
    size = most // n
    return "".join(text[start : start + size] for start in (np.arange(n) * ((len(text) - size) / max(1, n - 1))).astype(int).tolist())


def shares(sizes: list[int], total: int) -> list[int]:
    """What each of some texts may give so that they give ``total`` together: all of the short ones, the rest alike."""
    out, left = [0] * len(sizes), total
    for rank, i in enumerate(sorted(range(len(sizes)), key=lambda i: (sizes[i], i))):
        out[i] = min(sizes[i], left // (len(sizes) - rank))
        left -= out[i]
    return out


@dataclass
class Model:
    """Edges of all automata and costs of a phrase by language, and the bits a letter above which text of it is strange.

    ``edges`` are ``state << 21 | code point`` with the states of all languages
    numbered through, from each language's root on; ``targets`` are states too.
    """

    langs: list[str]
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    targets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    costs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    strange: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def ready(self) -> None:
        """Build the hash table of a worker once."""
        if hasattr(self, "key"):
            return
        self.shift = np.uint64(64 - max(4, int(3 * len(self.edges)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.key, self.value = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        left, at = np.arange(len(self.edges)), self._slot(self.edges)
        while len(left):
            free = self.key[at] < 0
            put, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.key[put], self.value[put] = self.edges[chosen], self.targets[chosen]
            waits = ~np.isin(left, chosen)
            left, at = left[waits], (at[waits] + 1) & (slots - 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("key", "value", "shift")}

    def _slot(self, edges: np.ndarray) -> np.ndarray:
        return ((edges.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def _follow(self, states: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States after a symbol; -1 where there is no edge."""
        edge = (states << 21) | symbol
        at = self._slot(edge)
        found = self.key[at]
        out = np.where(found == edge, self.value[at], -1)
        open_ = np.flatnonzero((found != edge) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.key) - 1)
            found = self.key[at[open_]]
            hit = found == edge[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def parse(self, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of texts whose symbols stand one after another: bits (languages x texts), and bits if every lane takes its cheapest language."""
        out, mixed = np.zeros((len(self.langs), n)), np.zeros(n)
        if not len(codes) or not len(self.langs):
            return out, mixed
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[begin, len(codes)])
        lanes = -(-size // LANE)
        nth = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(begin, lanes) + nth * LANE
        length = np.minimum(LANE, np.repeat(begin + size, lanes) - start)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        wide, least = codes.astype(np.int64), np.full(len(start), np.inf)
        for k, root in enumerate(self.roots.tolist()):
            state, count = np.full(len(start), root), np.zeros(len(start))
            for step in range(int(length[0])):
                alive = int(np.searchsorted(-length, -step, side="left"))
                symbol = wide[start[:alive] + step]
                to = self._follow(state[:alive], symbol)
                miss = np.flatnonzero(to < 0)
                if len(miss):
                    inner = state[miss] != root
                    again = np.full(len(miss), -1)
                    again[inner] = self._follow(np.full(int(inner.sum()), root), symbol[miss[inner]])
                    unknown = again < 0
                    count[miss] += inner * 1.0 + unknown
                    to[miss] = np.where(unknown, root, again)
                state[:alive] = to
            bits = (count + (state != root)) * self.costs[k]
            least = np.minimum(least, bits)
            out[k] = np.bincount(owner[start], weights=bits, minlength=n)
        return out, np.bincount(owner[start], weights=least, minlength=n)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and strangeness of each text; ``und`` without letters or languages."""
        names, score, strange = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a, b in runs(texts, 500_000):
            codes, owner, letters = words_only(texts[a:b])
            if not self.langs:
                names += ["und"] * (b - a)
                continue
            words = np.maximum(np.bincount(owner[codes == _SPACE], minlength=b - a) - 1, 1)
            bits, mixed = self.parse(codes, owner, b - a)
            best = bits.argmin(axis=0)
            least = bits[best, np.arange(b - a)]
            share = 1 / np.exp2(np.maximum((least - bits) / words, -1000)).sum(axis=0)
            some = letters > 0
            score[a:b] = np.where(some, share, 0)
            strange[a:b] = some & (mixed > self.strange[best] * letters + SLACK * self.costs[best])
            names += [self.langs[k] if has else "und" for k, has in zip(best.tolist(), some.tolist())]
        return names, score, strange


def of_language(texts: list[str], chars_each: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Edges, targets, cost of a phrase and strangeness limit of one language, from its sampled texts.

    The texts share ``chars_each`` characters; where there are enough of them some stay
    out and tell what unseen text costs.
    """
    plain = []
    for a, b in runs(texts, 500_000):
        codes, owner, letters = words_only(texts[a:b])
        bounds = np.searchsorted(owner, np.arange(b - a + 1))
        whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        plain += [(whole[bounds[i] : bounds[i + 1]], int(letters[i])) for i in range(b - a) if letters[i]]
    held = plain[HELD_OF - 1 :: HELD_OF] if len(plain) >= 2 * HELD_OF else []
    taught = [p for i, p in enumerate(plain) if not held or i % HELD_OF != HELD_OF - 1]
    parts = shares([len(t) for t, _ in taught], chars_each)
    text = " ".join(excerpt(t, share) for (t, _), share in zip(taught, parts) if share)
    moves = automaton(text)
    edges, targets = (np.fromiter(x, np.int64, len(moves)) for x in (moves, moves.values()))
    cost = math.log2(len(text) + 1)
    one = Model([""], edges, targets, np.zeros(1, np.int64), np.array([cost]), np.array([math.inf]))
    one.ready()
    rates = []
    for t, n in held or taught:
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        rates.append(float(one.parse(codes, np.zeros(len(codes), np.int32), 1)[1][0]) / n)
    # without the worst ones, so that no single document sets the limit
    limit = STRANGE * float(np.quantile(rates, QUANTILE, method="lower")) if rates else math.inf
    return edges, targets, cost, limit


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_each: int = DOCS_EACH, chars_each: int = CHARS_EACH) -> Model:
    """Learn from a bounded sample of rows with letters and a lang: about ``docs_each`` rows and ``chars_each`` characters of every language.

    Rows are chosen by a hash of text and lang, equal rows count once, and all chosen
    ones share the characters. Every language is built by a task of its own; its size
    is bounded, so the model grows with the number of languages only.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # no text may give more than the whole budget, so the next task is bounded too
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([excerpt(t, chars_each) for t in strings(batch.column(1))], pa.string())], ["lang", "text"])

    def build(table: pa.Table) -> pa.Table:
        texts = sorted(table["text"].to_pylist())
        return pa.table({"lang": table["lang"][:1], "built": pa.array([pickle.dumps(of_language(texts, chars_each))], pa.binary())})

    sampled = sample_per_class(rows, "lang", docs_each, seed=6).mapInArrow(short, "lang string, text string")
    got = {r["lang"]: pickle.loads(r["built"]) for r in sampled.groupBy("lang").applyInArrow(build, "lang string, built binary").collect()}  # of bounded size a language
    model, edges, targets, roots, base = Model(sorted(got)), [], [], [], 0
    for name in model.langs:
        e, t, _, _ = got[name]
        roots.append(base)
        edges.append(e + (base << 21))
        targets.append(t + base)
        base += int(t.max(initial=0)) + 1
    if got:
        model.edges, model.targets, model.roots = np.concatenate(edges), np.concatenate(targets), np.array(roots, np.int64)
        model.costs, model.strange = (np.array([got[x][k] for x in model.langs]) for k in (2, 3))
    return model


def identify(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and strange of every row, from its whole text alone.

    Null texts and texts without letters are ``und`` with score 0. ``strange``
    marks text that needs far more phrases than labelled text of its language, even
    if each of its lanes may take another of the languages.
    Rows stay as often as they stand; an empty table gives none.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of bounded size: languages x chars_each

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.ready()
        for batch in batches:
            names, score, strange = m.predict(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(strange)], ["doc_id", "lang_pred", "score", "strange"])

    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(of, "doc_id long, lang_pred string, score double, strange boolean")


def known_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is in one of the model's languages; all columns stay.

    Null texts, texts without letters and strange ones go; repeated rows stay or go
    alike. A model without languages knows none, and an empty table gives none.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        m = shared.value
        m.ready()
        names, _, strange = m.predict(texts.fillna("").tolist())
        return pd.Series((np.array(names) != "und") & ~strange)

    return df.filter(known(F.col(text)))


def learnable(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows outside the held-out fold: crc32(doc_id as text) mod 4 is not 2."""
    return df.filter(crc_mod(doc_id, 4) != 2)
