"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model.

Features of a text are the distinct runs of one to three characters, of one and
two words, and of one to six marks that tell which words repeat the word before
them. An n-gram is known by a 64-bit hash. Of a bounded sample of labelled
rows the tasks count, for either label, the rows that hold an n-gram; the
logarithm of the smoothed ratio scales the n-gram's indicator, rows are scaled to
length one, and dual coordinate descent fits the hinge loss. A logistic curve
over rows that the fit has not seen turns margins into probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import crc_mod, cut, hash_unit, kinds, runs, small_batches, strings

#: About so many documents of either label are learned from, and so many n-grams, the most frequent ones of these.
DOCS_EACH, VOCABULARY = 2_000, 1 << 16
#: Rows of the sample of which an n-gram must stand in two at least; every fifth is kept for the probabilities.
LEAST_ROWS, KEPT = 2, 0.2
#: Smoothing of counts, penalty of the loss, rounds, and the share of the fitted weights against their mean.
SMOOTH, PENALTY, ROUNDS, SHARE = 1.0, 1.0, 20, 0.75
CHARS, WORDS, MARKS = 3, 2, 6
#: Characters whose n-grams are hashed at a time, and texts whose indicators are marked at a time.
CHARS_AT_ONCE, TEXTS_AT_ONCE = 400_000, 128

_M1, _M2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)
_KINDS = np.arange(1, 40, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _mix(values: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of well spread bits; ``kind`` keeps n-grams of different sorts apart."""
    out = (values ^ _KINDS[kind]) * _M1
    out ^= out >> np.uint64(29)
    out *= _M2
    return out ^ (out >> np.uint64(32))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of some texts and the number of the text of each, one order after another; repeats included.

    A run of white space is one space, and every text has one at its head and end.
    """
    points = np.frombuffer((" " + " \x00 ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 3 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    # a text's own characters end before the NUL that parts it from the next
    inside = np.ones(len(points), bool)
    inside[np.cumsum(sizes)[:-1] - 1] = False
    white = (kinds(points) == 2) | (kinds(points) == 4)
    keep = inside & ~(white & np.r_[False, white[:-1]] & np.r_[False, inside[:-1]])
    points, owner, white = np.where(white, np.uint32(32), points)[keep].astype(np.uint64), owner[keep], white[keep]
    h = np.zeros(len(points), np.uint64)
    for k in range(1, CHARS + 1):
        h = h[: len(points) - k + 1] * _BASE + points[k - 1 :] + np.uint64(1)
        if not len(h):
            break
        same = owner[: len(h)] == owner[k - 1 :]
        yield _mix(h[same], k), owner[: len(h)][same]
    edge = np.flatnonzero(white)
    starts, ends = edge[:-1] + 1, edge[1:]
    real = (ends > starts) & (owner[edge[:-1]] == owner[edge[1:]])
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return
    # a word's hash adds its characters, each by its place
    place = np.arange(len(points)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(points)]))
    spread = _mix(points * np.uint64(0x10001) + place.astype(np.uint64) * _BASE, 11)
    spread[white] = 0
    word = np.add.reduceat(spread, starts)
    who = owner[starts]
    again = np.r_[False, (word[1:] == word[:-1]) & (who[1:] == who[:-1])]
    yield _mix(word, 12), who
    for k in range(2, WORDS + 1):
        h = word[: len(word) - k + 1]
        for j in range(1, k):
            h = h * _BASE + word[j : len(word) - k + 1 + j]
        same = who[: len(h)] == who[k - 1 :]
        yield _mix(h[same], 12 + k), who[: len(h)][same]
    seen = np.zeros(len(word), np.uint64)
    for k in range(1, min(MARKS, len(word)) + 1):
        seen = seen[: len(word) - k + 1] * np.uint64(2) + again[k - 1 :].astype(np.uint64)
        # of a text, each pattern of marks once
        marks = np.unique(who[: len(seen)][who[: len(seen)] == who[k - 1 :]].astype(np.int64) << k | seen[who[: len(seen)] == who[k - 1 :]].astype(np.int64))
        yield _mix((marks & ((1 << k) - 1)).astype(np.uint64), 20 + k), marks >> k


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Some texts at a time, with the number of the first."""
    for start, end in runs(texts, CHARS_AT_ONCE):
        for at in range(start, end, TEXTS_AT_ONCE):
            yield at, texts[at : min(end, at + TEXTS_AT_ONCE)]


@dataclass
class Vocabulary:
    """n-grams in the order of their hashes, and the ratio of each."""

    hashes: np.ndarray
    ratio: np.ndarray

    def __post_init__(self) -> None:
        # two tables by different bits of the hash; what finds its slot taken in both is looked up by bisection
        self.bits = max(8, len(self.hashes).bit_length() + 3)
        self.tables, left = [], np.arange(len(self.hashes))
        for k in range(2):
            table = np.full(1 << self.bits, -1, np.int32)
            table[self._slot(self.hashes[left], k)] = left
            self.tables.append(table)
            left = left[table[self._slot(self.hashes[left], k)] != left]
        self.rest = left

    def _slot(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits * (k + 1)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        out = self.tables[0][self._slot(hashes, 0)]
        miss = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))  # the slot of an n-gram that took it first
        if len(miss):
            second = self.tables[1][self._slot(hashes[miss], 1)]
            second[self.hashes[second] != hashes[miss]] = -1
            if len(self.rest):
                at = np.searchsorted(self.hashes[self.rest], hashes[miss]).clip(0, len(self.rest) - 1)
                second = np.where(self.hashes[self.rest[at]] == hashes[miss], self.rest[at], second)
            out[miss] = second
        return out

    def indicators(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Some texts at a time: the first one's number, then of each known n-gram in a text its text and its place."""
        width = len(self.hashes)
        for at, some in _groups(texts):
            mark = np.zeros(len(some) * width, bool)
            for h, who in grams(some):
                ids = self.ids(h)
                known = ids >= 0
                mark[who[known] * width + ids[known]] = True
            found = np.flatnonzero(mark)
            yield at, found // max(1, width), found % max(1, width)


@dataclass
class Model:
    """A vocabulary, the weight of each of its n-grams, and the curve of probabilities."""

    vocabulary: Vocabulary
    weight: np.ndarray
    shift: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.shift)
        ratio = self.vocabulary.ratio
        value, square = ratio * self.weight, ratio * ratio
        for at, row, gram in self.vocabulary.indicators(texts):
            n = int(row.max()) + 1 if len(row) else 0
            norm = np.sqrt(np.bincount(row, square[gram], n))
            out[at : at + n] += np.bincount(row, value[gram], n) / np.where(norm > 0, norm, 1)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts) + b, -40, 40)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and shift of the linear hinge-loss model by dual coordinate descent.

    ``rows`` has each text's n-grams, whose values are their ratios over the row's
    length; a last component of one stands for the shift. ``penalty`` bounds each dual
    variable. A round visits the rows in another order and stops the descent when no
    projected gradient is left.
    """
    weight, shift = np.zeros(len(ratio)), 0.0
    dual = np.zeros(len(rows))
    values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-12) for r in rows]
    length = np.array([float(v @ v) + 1.0 for v in values])
    chance = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in chance.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = y[i] * (float(weight[r] @ v) + shift) - 1.0
            projected = min(slope, 0.0) if dual[i] <= 0 else max(slope, 0.0) if dual[i] >= penalty[i] else slope
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(dual[i] - slope / length[i], 0.0), penalty[i])
                step = (new - dual[i]) * y[i]
                dual[i] = new
                weight[r] += step * v
                shift += step
        if worst < 1e-3:
            break
    return weight, shift


def curve(margin: np.ndarray, good: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve of margins, rows weighted to the share ``prior`` of good ones; targets are smoothed."""
    n, m = int(good.sum()), int((~good).sum())
    if not n or not m:
        return 4.0, float(np.log(prior / (1 - prior)))
    aim = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    c = np.where(good, prior / n, (1 - prior) / m) * len(margin)
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(c * (p - aim) * margin).sum() + 0.01 * a, (c * (p - aim)).sum()])
        v = c * p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 0.01, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (4.0, float(np.log(prior / (1 - prior))))


def train(rows: list[np.ndarray], good: np.ndarray, unseen: np.ndarray, vocabulary: Vocabulary, prior: float) -> Model:
    """The model of rows of n-grams; those marked ``unseen`` only set the curve."""
    y = np.where(good, 1.0, -1.0)
    seen = np.flatnonzero(~unseen)
    each = np.array([max(1, (good[seen] == g).sum()) for g in (False, True)])
    penalty = PENALTY * len(seen) / (2 * each[good[seen].astype(int)])
    weight, shift = descend([rows[i] for i in seen], y[seen], vocabulary.ratio, penalty)
    weight = SHARE * weight + (1 - SHARE) * np.abs(weight).mean() * (np.abs(weight) > 0)
    model = Model(vocabulary, weight, shift)
    margin = np.array([weight[r] @ vocabulary.ratio[r] / max(np.linalg.norm(vocabulary.ratio[r]), 1e-12) + shift for r in rows])
    held = unseen if unseen.any() and good[unseen].any() and (~good[unseen]).any() else np.ones(len(rows), bool)
    model.curve = curve(margin[held], good[held], prior)
    return model


def sample(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", docs_each: int = DOCS_EACH) -> tuple[DataFrame, float] | None:
    """(good, unseen, text) of a sample of labelled rows, and the share of good labels among all; None without both labels.

    About ``docs_each`` ids of either label are chosen by their hash before any text is
    read, so the sample's size doesn't depend on the table's. Rows of labels that
    contradict each other count as bad, labels other than 0 and 1 and null texts as none;
    equal texts count once, and rows that share an id are bounded by the hash of their texts.
    """
    told = labels.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    counts = {r["quality"]: r["count"] for r in told.groupBy("quality").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    rate = F.when(F.col("quality") == 1, docs_each / counts[1]).otherwise(docs_each / counts[0])
    chosen = told.filter(hash_unit("doc_id", 11) < rate)  # about 2 * docs_each rows
    small_batches(df.sparkSession)
    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = read.groupBy(F.xxhash64(F.lit(11), "text").alias("u")).agg(F.min("quality").alias("quality"), F.first("text").alias("text"))
    held = F.pmod(F.col("u"), F.lit(1000)) < F.lit(int(1000 * KEPT))
    few = rows.orderBy("u").limit(4 * docs_each).select("u") if rows.select("u").limit(4 * docs_each + 1).count() > 4 * docs_each else None
    if few is not None:
        rows = rows.join(F.broadcast(few), "u")
    return rows.select((F.col("quality") == 1).alias("good"), held.alias("unseen"), "text"), counts[1] / (counts[0] + counts[1])


def counted(rows: DataFrame) -> DataFrame:
    """(h, good, bad): in how many rows of either label an n-gram stands; tasks add up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, texts = np.array(batch.column(0).to_pylist(), bool), strings(batch.column(1))
            each = []
            for at, some in _groups(texts):
                every: list[list[np.ndarray]] = [[] for _ in some]
                for h, who in grams(some):
                    border = np.searchsorted(who, np.arange(len(some) + 1))
                    for k in range(len(some)):
                        every[k].append(h[border[k] : border[k + 1]])
                each += [(at + k, np.unique(np.concatenate(x))) for k, x in enumerate(every) if x]
            sides = [[h for k, h in each if good[k] == g] for g in (True, False)]
            found = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in sides]
            for g, (h, n) in zip((True, False), found, strict=True):
                zero = np.zeros(len(h), np.int32)
                n = n.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n if g else zero), pa.array(zero if g else n)], ["h", "good", "bad"])

    return rows.select("good", "text").mapInArrow(count, "h long, good int, bad int").groupBy("h").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def vocabulary(rows: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """The n-grams that stand in most rows, ``size`` at most, with the logarithm of their classes' smoothed ratio."""
    common = counted(rows).filter(F.col("good") + F.col("bad") >= LEAST_ROWS).orderBy(F.desc(F.col("good") + F.col("bad")), "h").limit(size).toArrow()  # of bounded size
    h, good, bad = (common[c].to_numpy() for c in ("h", "good", "bad"))
    order = np.argsort(h.view(np.uint64))
    p, q = good[order] + SMOOTH, bad[order] + SMOOTH
    return Vocabulary(h[order].view(np.uint64), np.log((p / p.sum()) / (q / q.sum())) if len(h) else np.zeros(0))


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", docs_each: int = DOCS_EACH) -> Model | None:
    """Learn ``quality`` (1 is good) from a bounded sample of labelled rows (see ``sample``).

    n-grams are counted and rows turned to n-grams in many tasks; the descent is one
    task of bounded size on an executor, and only the model reaches the driver. None
    without rows of both labels; labels without a document count for nothing.
    """
    got = sample(df, labels, doc_id, text, docs_each)
    if got is None:
        return None
    rows, prior = cut(got[0].repartition(16)), got[1]
    words = vocabulary(rows.filter("not unseen"))
    shared = df.sparkSession.sparkContext.broadcast(words)  # VOCABULARY entries at most

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(2))
            for at, row, gram in shared.value.indicators(texts):
                n = min(len(texts) - at, TEXTS_AT_ONCE)
                border = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                n = int(row.max()) + 1 if len(row) else 0
                lists = pa.ListArray.from_arrays(pa.array(border[: n + 1]), pa.array(gram.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), lists], ["good", "unseen", "grams"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list = []
        for batch in batches:
            lists = batch.column(2)
            values, border = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            told += [(g, u, values[border[k] : border[k + 1]].copy()) for k, (g, u) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
        told.sort(key=lambda x: (len(x[2]), x[2].tobytes(), x[0]))  # rows come in any order
        good, unseen = (np.array([x[k] for x in told], bool) for k in (0, 1))
        able = told and good[~unseen].any() and (~good[~unseen]).any()
        model = train([x[2] for x in told], good, unseen, shared.value, prior) if able else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    lists = rows.mapInArrow(known, "good boolean, unseen boolean, grams array<int>").repartition(1)
    found = lists.mapInArrow(learn, "model binary").collect()  # one model of fixed size
    return next((m for r in found if (m := pickle.loads(r["model"])) is not None), None)


def score(df: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """doc_id, score (the probability that the text is good) and predicted (1 from ``least`` on) of every row.

    Null and empty texts have the score of a text without n-grams; without a model
    every score is 1, so that nothing is called bad. Rows stay as often as they
    stand; an empty table gives none.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            p = np.ones(len(texts)) if shared.value is None else shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= least).astype(np.int32))], ["doc_id", "score", "predicted"])

    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(of, "doc_id long, score double, predicted int")


def learnable(labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Label rows outside the held-out fold: crc32(doc_id as text) mod ``folds`` is not ``held``; rows without doc_id go."""
    return labels.filter(crc_mod("doc_id", folds) != held)
