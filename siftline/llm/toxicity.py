"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear SVM over sentences.

A text is cut into sentences, and a sentence is a row of symbols: its letters of
any script, lower-cased, and one space between words. Marks and digits inside a
word and spaces between single letters fall away, so ``i.d.i.o.t`` and ``i d i o t``
read like the plain word. The kernel compares two stretches of a sentence (``WINDOW``
symbols from each place on, so across words as well) by all subsequences of five
symbols that they share, each weighted by ``DECAY`` to the power of the symbols it
skips; letters put in between or left out cost a little and don't break a match.
Landmark stretches span the feature space (Nyström). A squared-hinge SVM learns
from labelled documents: each sentence of a toxic document has its label, but only
some of them need be toxic, so the document speaks through its most toxic stretches,
chosen anew after every fit by the mean of the fits so far (that of the first left out),
which is the model in the end; clean documents speak through their worst stretches
and many others. A text's score is that of its most toxic stretch, calibrated on
the training documents.

The decision is linear in the kernel to the landmarks, and that is linear in the
weighted subsequences; so it is folded into one weight for each hashed subsequence
of five symbols, and a stretch's decision is a sum of table entries.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import code_points, crc_mod, hash_unit, kinds, runs, small_batches, strings

#: Labelled documents of either label in the fit, taken whole in the order of a hash until their characters are used up.
DOCS_EACH, CHARS_EACH = 3000, 5_000_000
#: Places at which the subsequences of a stretch begin, symbols that one spans at most, and the decay of a skipped symbol.
WINDOW, SPAN, DECAY = 10, 7, 0.6
#: Landmarks, stretches of clean sentences in a fit, and the fits.
LANDMARKS, NEGATIVES, FITS = 240, 6000, 6
#: Bits of the table of hashed subsequences.
BITS = 20
_SPACE, _BORDER = np.uint32(32), np.uint32(10)
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1))
#: Places of the second to the fifth symbol after the first.
_STEPS = [(a, b, c, d) for d in range(4, SPAN) for c in range(3, d) for b in range(2, c) for a in range(1, b)]
#: Symbols that are looked up at a time, so that the passes stay in a core's cache.
_AT_ONCE = 1 << 15

def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, a border after each sentence, and the text of each symbol."""
    points, text = code_points(texts)
    kind = kinds(points)
    at = np.flatnonzero((kind == 1) | (kind == 5))
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    # what lies between two letters: nothing or marks only, white space, or a border
    count = lambda hit: np.cumsum(np.r_[False, hit], dtype=np.int32)
    white = (kind == 2) | (kind == 4)
    # a sentence ends at a mark with white space behind it, or at a full-width mark
    spaces, ends = count(white), count((kind == 4) | (kind == 3) & (np.r_[white[1:], True] | (points >= 0x3000)))
    a, b = at[:-1] + 1, at[1:]
    spaced = spaces[b] > spaces[a]
    border = ends[b] > ends[a]
    spaced |= border
    # spaces between single letters, three at least, fall away
    start = np.r_[0, np.flatnonzero(spaced) + 1]
    single = np.diff(np.r_[start, len(at)]) == 1
    both = single[:-1] & single[1:]
    three = both & (np.r_[False, both][:-1] | np.r_[both, False][1:])
    gaps = np.flatnonzero(spaced)
    spaced[gaps[three & ~border[gaps]]] = False
    # a letter brings along what follows it: nothing, a space, or space, border, space
    follow = np.r_[np.where(border, 3, spaced.astype(np.int64)), 3]
    place = np.cumsum(1 + follow) - follow  # one after a space that begins all
    out = np.full(int((1 + follow).sum()) + 1, _SPACE, np.uint32)
    out[place] = points[at]
    out[place[follow == 3] + 2] = _BORDER
    owner = np.repeat(text[at], 1 + follow)
    owner = np.r_[owner[:1], owner]
    over = np.flatnonzero(follow[:-1] == 3)
    owner[place[over] + 3] = text[at[over + 1]]  # the space that begins a sentence is its own
    return out, owner


def fives(codes: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(span, slots of the subsequences that begin at each place and reach so far)."""
    n = max(0, len(codes) - SPAN + 1)
    first, second, third, fourth, last = (codes * m for m in _MIX)
    shift = np.uint32(32 - BITS)
    two = {(a, b): first[:n] + second[a : a + n] + third[b : b + n] for b in range(2, SPAN - 2) for a in range(1, b)}
    three = {(a, b, c): x + fourth[c : c + n] for (a, b), x in two.items() for c in range(b + 1, SPAN - 1)}
    for d in range(4, SPAN):
        end = last[d : d + n]
        yield d, [(x + end) >> shift for (_, _, c), x in three.items() if c < d]


def _inside(codes: np.ndarray) -> np.ndarray:
    """Symbols from each place to the next border."""
    places = np.arange(len(codes), dtype=np.int32)
    following = np.where(codes == _BORDER, places, np.int32(len(codes)))
    return np.minimum.accumulate(following[::-1])[::-1] - places


def begun(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the decayed weights of all subsequences that begin at each place and cross no border."""
    out = np.zeros(len(codes), np.float32)
    left = _inside(codes)
    padded = np.r_[codes, np.full(SPAN, _BORDER, np.uint32)]
    for at in range(0, len(codes), _AT_ONCE):
        part = padded[at : at + _AT_ONCE + SPAN - 1]
        own = out[at : at + _AT_ONCE]
        for b, slots in fives(part):
            total = weight.take(slots[0].astype(np.intp))
            for s in slots[1:]:
                total += weight.take(s.astype(np.intp))
            own += total[: len(own)] * (left[at : at + len(own)] > b) * np.float32(DECAY ** (b - 4))
    return out


def stretches(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Decision, without the bias, of the stretch that begins at each place."""
    total = np.cumsum(np.r_[0.0, begun(codes, weight)])
    place = np.arange(len(codes), dtype=np.int32)
    return (total[np.minimum(place + WINDOW, place + _inside(codes))] - total[:-1]).astype(np.float32)


def best_of_texts(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each text and its place; -inf and -1 for texts without symbols."""
    best, place = np.full(n, -np.inf), np.full(n, -1, np.int64)
    if len(values):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        most = np.maximum.reduceat(values, starts)
        best[owner[starts]] = most
        hit = np.flatnonzero(values == np.repeat(most, np.diff(np.r_[starts, len(values)])))[::-1]
        place[owner[hit]] = hit  # the first of several
    return best, place


def features(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights (stretches x subsequences) of the stretches that begin at ``places``."""
    reach = places[:, None] + np.arange(WINDOW + SPAN - 1)
    rows = np.where(reach < len(codes), codes[np.minimum(reach, len(codes) - 1)], _BORDER)
    open_ = np.cumsum(rows == _BORDER, axis=1) == 0  # before the first border
    first, second, third, fourth, last = (rows * m for m in _MIX)
    slots, weights = [], []
    for a, b, c, d in _STEPS:
        v, w, x, y, z = (u[:, k : k + WINDOW] for u, k in ((first, 0), (second, a), (third, b), (fourth, c), (last, d)))
        slots.append((v + w + x + y + z) >> np.uint32(32 - BITS))
        weights.append(np.where(open_[:, d : d + WINDOW], np.float32(DECAY ** (d - 4)), np.float32(0)))
    return np.concatenate(slots, axis=1).astype(np.int64), np.concatenate(weights, axis=1)


def kernel(x: tuple[np.ndarray, np.ndarray], landmarks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums over shared subsequences of the products of their weights (stretches x landmarks), for some landmarks at a time."""
    each = 100
    if len(landmarks[0]) > each:
        return np.concatenate([kernel(x, tuple(v[at : at + each] for v in landmarks)) for at in range(0, len(landmarks[0]), each)], axis=1)
    used = np.unique(landmarks[0][landmarks[1] > 0])
    column = np.full(1 << BITS, len(used), np.int32)
    column[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(landmarks[0])), np.float32)
    np.add.at(table, (column[landmarks[0]], np.arange(len(landmarks[0]))[:, None]), landmarks[1])
    table[len(used)] = 0
    out = np.zeros((len(x[0]), len(landmarks[0])), np.float32)
    place = column[x[0]]
    for at in range(0, len(x[0]), 256):
        # subsequences that no landmark has need no sum
        rows, cols = np.nonzero((place[at : at + 256] < len(used)) & (x[1][at : at + 256] > 0))
        if len(rows):
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            out[at + rows[starts]] = np.add.reduceat(table[place[at + rows, cols]] * x[1][at + rows, cols][:, None], starts, axis=0)
    return out


@dataclass
class Model:
    """Weight of each slot of subsequences, the bias, and the calibration of a text's decision."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def __getstate__(self):
        used = np.flatnonzero(self.weight)
        return {**self.__dict__, "weight": (used.astype(np.int32), self.weight[used])}

    def __setstate__(self, state):
        used, values = state["weight"]
        self.__dict__.update(state, weight=np.zeros(1 << BITS, np.float32))
        self.weight[used] = values

    def decide(self, texts: list[str]) -> np.ndarray:
        """Decision of each text's most toxic stretch; a text without letters has that of nothing shared."""
        out = np.full(len(texts), self.bias)
        for start, end in runs(texts, 400_000):
            codes, owner = symbols(texts[start:end])
            best, _ = best_of_texts(stretches(codes, self.weight), owner, end - start)
            out[start:end] = np.maximum(out[start:end], np.where(np.isfinite(best), best, 0) + self.bias)
        return out

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -60, 60)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a squared-hinge SVM by Newton steps; the last column is the bias and is hardly shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(40):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(shrink), (a * c[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _first_weights(codes: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logarithms of how much likelier a toxic document has each subsequence, shrunk for few documents."""
    counts = np.zeros((2, 1 << BITS), np.float32)
    bounds = np.searchsorted(owner, np.arange(len(toxic) + 1))
    seen = np.zeros(1 << BITS, bool)
    for d in range(len(toxic)):
        part = codes[bounds[d] : bounds[d + 1]]
        if len(part) < SPAN:
            continue
        slots = np.concatenate([s for _, rows in fives(part) for s in rows]).astype(np.intp)
        seen[slots] = True
        hit = slots[seen[slots]] if len(slots) < 4096 else np.flatnonzero(seen)
        hit = np.unique(hit) if len(slots) < 4096 else hit
        counts[int(toxic[d]), hit] += 1
        seen[hit] = False
    n = np.bincount(toxic.astype(int), minlength=2)
    odd = np.log((counts[1] + 2 * n[1] / n.sum()) / n[1]) - np.log((counts[0] + 2 * n[0] / n.sum()) / n[0])
    # what tells little by chance alone counts as nothing
    noise = 2 / np.sqrt(1 + counts.sum(axis=0) * n[1] / n.sum())
    return (np.sign(odd) * np.maximum(np.abs(odd) - noise, 0)).astype(np.float32)


def _peaks(value: np.ndarray, wanted: np.ndarray, limit: float) -> np.ndarray:
    """Places above the limit that no place of the stretch before or after exceeds."""
    at = np.flatnonzero(wanted & (value > limit))
    padded = np.r_[np.full(WINDOW, -np.inf), value, np.full(WINDOW, -np.inf)]
    around = padded[at[:, None] + np.arange(2 * WINDOW + 1)]
    return at[around.argmax(axis=1) == WINDOW]


def _cover(similar: np.ndarray, most: int) -> list[int]:
    """Rows that together are close to as many others as possible, the best one first."""
    near = similar > 0.25
    open_ = np.ones(len(near), bool)
    out: list[int] = []
    while len(out) < most:
        gain = near[:, open_].sum(axis=1)
        gain[out] = 0
        i = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[i] < 2:
            break
        out.append(i)
        open_ &= ~near[i]
    return out


def train(texts: list[str], toxic: np.ndarray, prior: float) -> Model | None:
    """Fit on whole labelled texts; ``prior`` is the true share of toxic ones. None without both labels."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return None
    rng = np.random.default_rng(7)
    codes, owner = [], []
    for start, end in runs(texts, 400_000):
        c, o = symbols(texts[start:end])
        codes.append(c)
        owner.append(o + np.int32(start))
    bounds = np.cumsum([0, *map(len, codes)]).tolist()
    codes, owner, n = np.concatenate(codes), np.concatenate(owner), len(texts)
    every_stretch = lambda w: np.concatenate([stretches(codes[a:b], w) for a, b in zip(bounds, bounds[1:])])
    weight = _first_weights(codes, owner, toxic)
    model, summed, bias = None, np.zeros(1 << BITS, np.float32), 0.0
    for turn in range(FITS):
        value = every_stretch(weight)
        best, place = best_of_texts(value, owner, n)
        known = place >= 0
        clean, bad = np.flatnonzero(~toxic & known), np.flatnonzero(toxic & known)
        if not len(clean) or not len(bad):
            return None
        # some labels are wrong: stretches no worse than the worst of most clean texts don't speak
        peaks = _peaks(value, toxic[owner], float(np.quantile(best[clean], 0.9)))
        positive = peaks if len(peaks) <= NEGATIVES else np.sort(rng.choice(peaks, NEGATIVES, replace=False))
        if len(positive) < 2:
            positive = place[bad[np.argsort(-best[bad], kind="stable")[: max(2, len(bad) // 10)]]]
        worst = clean[best[clean] <= np.quantile(best[clean], 0.99)]
        hard = place[worst[np.argsort(-best[worst], kind="stable")[: NEGATIVES // 2]]]
        plain = rng.integers(0, len(codes), NEGATIVES)
        plain = plain[~toxic[owner[plain]] & (codes[plain] != _BORDER)][: NEGATIVES // 2]
        negative = np.unique(np.r_[hard, plain])
        x = features(codes, np.r_[positive, negative])
        chosen = rng.permutation(len(positive))[:1500]
        some = tuple(v[chosen] for v in x)
        near = kernel(some, some).astype(np.float64)
        size = np.sqrt(np.maximum(np.diag(near), 1e-9))
        marks = chosen[_cover(near / size[:, None] / size, LANDMARKS * 2 // 3)]
        rest = len(positive) + rng.permutation(len(negative))[: LANDMARKS - len(marks)]
        marks = np.r_[marks, rest].astype(np.int64)
        landmarks = tuple(v[marks] for v in x)
        k = kernel(x, landmarks).astype(np.float64)
        scale = float(np.mean(np.diag(k[marks])))
        among = (k[marks] + k[marks].T) / 2 / scale
        values, vectors = np.linalg.eigh(among)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        design = np.c_[k / scale @ root, np.ones(len(k))]
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        cost = np.where(y > 0, len(negative) / len(positive) / 2, 1.0)
        w = _svm(design, y, cost)
        beta = root @ w[:-1] / scale
        weight = np.zeros(1 << BITS, np.float32)
        np.add.at(weight, landmarks[0].ravel(), (landmarks[1] * beta[:, None].astype(np.float32)).ravel())
        if turn:  # fits swing with what they choose, their mean hardly does
            summed, bias = summed + weight, bias + float(w[-1])
            weight = summed / np.float32(turn)
            model = Model(weight, bias / turn)
    best, place = best_of_texts(every_stretch(weight), owner, n)
    decision = np.maximum(np.where(place >= 0, best, 0), 0) + model.bias
    _calibrate(model, decision[toxic], decision[~toxic], prior)
    return model


def _calibrate(model: Model, toxic: np.ndarray, clean: np.ndarray, prior: float) -> None:
    """Logistic fit of decisions to labels, weighted to the true share of toxic documents."""
    x = np.r_[toxic, clean]
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    c = np.r_[np.full(len(toxic), prior / len(toxic)), np.full(len(clean), (1 - prior) / len(clean))] * len(x)
    a, b = 2.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(c * (p - y) * x).sum() + 0.01 * a, (c * (p - y)).sum() + 0.01 * b])
        v = c * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = (max(float(a), 0.1), float(b)) if np.isfinite([a, b]).all() else (4.0, 0.0)


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", docs_each: int = DOCS_EACH, chars_each: int = CHARS_EACH) -> Model | None:
    """Learn from a bounded sample of labelled rows; the share of labels is that of all.

    About ``docs_each`` documents of either label are chosen by a hash of their ids
    before any text is read; of these, texts are taken whole in the order of a hash
    until ``chars_each`` characters of a label are used up, and only these reach the fit.
    A text that is longer than that alone is left out. Equal texts count once,
    rows of labels that contradict each other count as toxic, labels other than 0 and
    1 and null texts as none. The fit is one task of that bounded size on an
    executor; only the model reaches the driver. None without rows of both labels.
    """
    told = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    counts = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    prior = counts[1] / (counts[0] + counts[1])
    rate = F.when(F.col("toxic") == 1, docs_each / counts[1]).otherwise(docs_each / counts[0])
    chosen = told.filter(hash_unit("doc_id", 7) < rate)  # about 2 * docs_each rows
    small_batches(df.sparkSession)
    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    hashed = read.filter("text is not null").withColumn("u", F.xxhash64(F.lit(7), "text"))
    # rows that share an id may be many: the hash of the text bounds them, then the characters do
    sized = hashed.groupBy("u").agg(F.max("toxic").alias("toxic"), F.max(F.length("text")).alias("n")).orderBy("u").limit(4 * docs_each).collect()
    taken, room = [], [chars_each, chars_each]
    for r in sized:
        label = r["toxic"]
        if 0 < room[label] and r["n"] <= chars_each:
            room[label] -= r["n"]
            taken.append((r["u"], label))
    picked = df.sparkSession.createDataFrame(taken, "u long, label int")
    rows = hashed.join(F.broadcast(picked), "u").groupBy("u").agg(F.first("label").alias("label"), F.first("text").alias("text")).select("label", "u", "text").repartition(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        held.sort()  # rows come in any order
        model = train([x[2] for x in held], np.array([x[1] for x in held], bool), prior) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.mapInArrow(learn, "model binary").collect()  # one model of fixed size
    return next((m for r in found if (m := pickle.loads(r["model"])) is not None), None)


def _scores(model: Model | None, texts: list[str]) -> np.ndarray:
    return np.zeros(len(texts)) if model is None else model.probability(model.decide(texts))


def score(df: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row, from its whole text alone.

    Null and empty texts have the score of a text without letters; without a model
    every score is 0. Rows stay as often as they stand; an empty table gives none.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: one weight a slot at most

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(shared.value, strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(of, "doc_id long, score double, predicted int")


def harmless(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text scores below 0.5; all columns stay.

    Null and empty texts score as a text without letters and rows stay as often as
    they stand; without a model, and of an empty table, every row stays.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(texts):
        import pandas as pd

        return pd.Series(_scores(shared.value, texts.fillna("").tolist()) < 0.5)

    return df.filter(fine(F.col(text)))


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out fold: crc32(doc_id as text) mod 5 is not 0; rows without doc_id go, repeated ones stay."""
    return labels.filter(crc_mod("doc_id", 5) != 0)
