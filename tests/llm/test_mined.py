"""Quality classifier, collocations and importance resampling against plain readings, with strange rows and with nothing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siftline.llm import collocation, importance, quality_classifier

SCHEMA = "doc_id long, text string, lang string, score double, rank string, phrase string, h long, seed string, part string"
MORE = (0.5, "r", "p", 1, "s", "t")
LONG = "word and more " * 3000
ROWS = [
    (1, "One line here\nand a second line\nthen a third one\nfour at last", "en"), (2, None, None), (3, "", "en"), (4, "  \n\n\t ", "de"), (5, LONG, "en"), (5, LONG, "en"),
    (None, "a row without id " * 30, "en"), (7, "日本語 😀 é ñ ß \u0000 �", "fr"), (8, "x" * 5000, "es"), (9, "1234 !!! ###", "en"), (10, "und so, und so. " * 40, "de"), (11, "und so " * 40, None),
]


@pytest.fixture(scope="module")
def strange(spark):
    return spark.createDataFrame([(*r, *MORE) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _low(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


# 11 -------------------------------------------------------------------------


def _plain_grams(text: str) -> set:
    """The n-grams of a text by name."""
    words = text.split()
    chars = " " + " ".join(words) + " " if words else " "
    out = {("c", chars[i : i + n]) for n in (1, 2, 3) for i in range(len(chars) - n + 1)}
    out |= {("w", tuple(words[i : i + n])) for n in (1, 2) for i in range(len(words) - n + 1)}
    again = [i > 0 and words[i] == words[i - 1] for i in range(len(words))]
    return out | {("m", tuple(again[i : i + n])) for n in range(1, 7) for i in range(len(again) - n + 1)}


def _texts(r: random.Random, n: int) -> list[str]:
    words = ["a", "b", "ab", "é", "日本", "A", "!!", "b"]
    return ["".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(r.randrange(0, 12))) for _ in range(n)]


def test_ngrams_equal_a_plain_reading():
    texts = [*_texts(random.Random(3), 200), "", " ", "one", "one one one", " lead and trail  "]
    got = [set() for _ in texts]
    for h, who in quality_classifier.grams(texts):
        for x, k in zip(h.tolist(), who.tolist(), strict=True):
            got[k].add(x)
    # equal n-grams and no others have equal hashes, in every pair of texts
    names = [_plain_grams(t) for t in texts]
    assert [len(g) for g in got] == [len(n) for n in names]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(names[i] & names[j]), (texts[i], texts[j])


def test_vocabulary_finds_each_of_its_hashes():
    r = np.random.default_rng(1)
    h = np.sort(r.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1))
    h[:64] = np.arange(64, dtype=np.uint64)  # the same upper bits in both tables
    v = quality_classifier.Vocabulary(h, np.zeros(len(h)))
    assert (v.ids(h) == np.arange(len(h))).all() and len(v.rest)
    assert (v.ids(np.arange(100, 400, dtype=np.uint64)) == -1).all()


def test_descent_reaches_the_optimum_of_its_dual():
    """At the optimum no dual variable can move: margins tell which of them stand at a border."""
    r = np.random.default_rng(2)
    ratio = r.normal(size=40)
    rows = [np.sort(r.choice(40, r.integers(3, 12), replace=False)) for _ in range(120)]
    y = np.array([1.0 if ratio[x].sum() + r.normal() > 0 else -1.0 for x in rows])
    penalty = np.full(120, 0.7)
    weight, shift = quality_classifier.descend(rows, y, ratio, penalty, rounds=3000)
    values = [ratio[x] / np.linalg.norm(ratio[x]) for x in rows]
    margin = y * np.array([weight[x] @ v + shift for x, v in zip(rows, values, strict=True)])
    loss = 0.5 * (weight @ weight + shift * shift) + (penalty * np.maximum(0, 1 - margin)).sum()
    for _ in range(300):  # the primal is convex: no step near by may lower it
        w, b = weight + r.normal(size=40) * 0.01, shift + r.normal() * 0.01
        m = y * np.array([w[x] @ v + b for x, v in zip(rows, values, strict=True)])
        assert 0.5 * (w @ w + b * b) + (penalty * np.maximum(0, 1 - m)).sum() >= loss - 1e-3


def test_op11_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()["op11_quality_classifier"](spark, d).toPandas()
    docs, labels = pd.read_parquet(f"{d}/documents.parquet"), pd.read_parquet(f"{d}/labels.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.97 and held[held.quality == 1].predicted.mean() > 0.98


def test_quality_of_strange_rows(spark, strange, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 0), (9, 0, None), (10, 1, 0), (None, 1, 0), (77, 1, 0), (3, None, None), (11, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(strange, labels)
    got = quality_classifier.score(strange, model).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all() and got.columns.tolist() == ["doc_id", "score", "predicted"]
    by = got.set_index("doc_id").score
    assert by[2] == by[3] and len(set(by[5])) == 1
    assert quality_classifier.fit(strange, labels.filter("quality = 1")) is None and quality_classifier.fit(nothing, labels.limit(0)) is None
    assert quality_classifier.fit(nothing, labels) is None
    assert set(quality_classifier.score(strange, None).toPandas().score) == {1.0} and quality_classifier.score(nothing, model).count() == 0
    # the fit doesn't depend on how rows are dealt out
    again = quality_classifier.score(strange, quality_classifier.fit(strange.repartition(7), labels)).toPandas()
    assert np.allclose(sorted(got.score), sorted(again.score), atol=1e-9)


def test_rows_of_one_id_are_bounded(spark, monkeypatch):
    rows = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    some, prior = quality_classifier.sample(rows, labels, docs_each=20)
    assert some.count() == 80 and prior == 0.5


# 12 -------------------------------------------------------------------------


def _plain_collocations(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", _low(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        told = []
        for p, a in frequent.items():
            if not (p in around and 100 * around[p] >= 80 * a):
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                told.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(told)[:top], 1)]
    return sorted(out)


def _phrase_rows(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["The", "of", "Ünd", "in-1", "a\x00b", "　x", "new", "york", "city", "z" * 300]
    text = lambda: "".join(r.choice(words[: r.randrange(2, 11)]) + r.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".", "\x0b"]) for _ in range(r.randrange(0, 60)))
    return [(r.choice(["en", "en", "de", None, "und"]), text()) for _ in range(n)]


@pytest.mark.parametrize(("least", "top", "each"), [(3, 2000, 200_000), (8, 25, 3), (2, 2000, 1)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, least, top, each):
    """Also where every prefix has so many windows that it gives way to longer ones, and text is taken a little at a time."""
    monkeypatch.setattr(collocation, "PREFIX_WINDOWS", each)
    monkeypatch.setattr(collocation, "PREFIXES", 1 << 40)
    monkeypatch.setattr(collocation, "RANKED", 40 * each)
    rows = _phrase_rows(least, 150)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collocation.collocations(df, least=least, top=top)
    assert sorted(map(tuple, got.collect())) == _plain_collocations(rows, least, top)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]


def test_collocations_of_strange_rows(spark, strange, nothing):
    rows = [(r[2], r[1]) for r in ROWS]
    assert sorted(map(tuple, collocation.collocations(strange).collect())) == _plain_collocations(rows, 30, 2000)
    assert collocation.collocations(nothing).count() == 0
    assert collocation.collocations(strange.filter("doc_id = 1")).count() == 0  # nothing is frequent


def test_op12_equals_a_plain_count(spark):
    d = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    got = __spark_entry__.queries()["op12_collocation"](spark, d)
    assert sorted(map(tuple, got.collect())) == _plain_collocations(zip(docs.lang, docs.text, strict=True), 30, 2000)


def test_long_texts_are_cut_at_borders_only(monkeypatch):
    monkeypatch.setattr(collocation, "BYTES_AT_ONCE", 10)
    import pyarrow as pa

    text = "aaa bbb ccc ddd eee. fff ggg, hhh iii jjj kkk"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    words = [w for _, raw in collocation._texts(batch) for w in collocation._words(raw)]
    assert words == text.replace(".", " .").replace(",", " .").encode().split()


def test_scores_are_exact_beyond_64_bits(spark):
    big = 5_000_000_000_000_000
    words = spark.createDataFrame([("en", "a", big), ("en", "b", 2 * big), ("en", "c", big + 7)], "lang string, phrase string, f long")
    phrases = spark.createDataFrame([("en", "a b", big - 1), ("en", "b c", big - 3), ("en", "a b c", (big - 1) * 4 // 5)], "lang string, phrase string, f long")
    got = {r["phrase"]: r for r in collocation.scored(phrases, words).collect()}
    assert got["a b"]["score"] == 2_000_000 * (big - 1) // (3 * big)
    cuts = [(2_000_000 * ((big - 1) * 4 // 5) // x, k) for k, x in ((1, big + big - 3), (2, big - 1 + big + 7))]
    assert got["a b c"]["score"] == min(cuts)[0] and got["a b c"]["l"] == (big if min(cuts)[1] == 1 else big - 1)
    assert {r["phrase"] for r in collocation.covered(phrases).collect()} == {p for p, a in (("a b", big - 1), ("b c", big - 3)) if 100 * ((big - 1) * 4 // 5) >= 80 * a}


# 13 -------------------------------------------------------------------------

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _plain_features(text) -> tuple[int, list[int]]:
    w = _WORD.findall(_low(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode("utf-8", "surrogatepass")) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _plain_resample(docs: list[tuple], targets: list, percent=5, least=20) -> dict:
    told = [(i, *_plain_features(t)) for i, t in docs]
    s, t = Counter(b for x in told for b in x[2]), Counter(b for x in targets for b in _plain_features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, words, buckets in told:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        rows.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((r[0], r[1], r[2], r[3], drawn.get(id(r))) for r in rows), key=repr)


def test_crcs_combine():
    r = random.Random(5)
    texts = ["".join(r.choice("abZ09 .é中😀\n\x00-") for _ in range(r.randrange(0, 300))) for _ in range(200)] + ["", "a" * 999 + " b " + "é" * 40 + " " + "y" * 47, "one", "one two"]
    count, crc, owner = importance.features(texts)
    for i, text in enumerate(texts):
        w = _WORD.findall(_low(text))
        assert count[i] == len(w)
        assert sorted(crc[owner == i].tolist()) == sorted(zlib.crc32(" ".join(w[a : a + k]).encode()) for k in (1, 2, 3) for a in range(len(w) - k + 1))
    a, b = b"some bytes", b"x" * 1_000_003
    joined = importance.shift(np.array([zlib.crc32(a)] * 2, np.uint32), np.array([len(b), 0])) ^ np.array([zlib.crc32(b), 0], np.uint32)
    assert joined.tolist() == [zlib.crc32(a + b), zlib.crc32(a)]


def test_op13_equals_a_plain_reading(spark, sf):
    docs, bench = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    got = __spark_entry__.queries()["op13_importance_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_resample(list(zip(docs.doc_id.tolist(), docs.text, strict=True)), list(bench.text))


def test_resampling_of_strange_rows(spark, strange, nothing):
    target = spark.createDataFrame([("a row without id",), (None,), ("",), ("x" * 99,)], "text string")
    rows = [(r[0], r[1]) for r in ROWS]
    for percent in (5, 50, 100):
        got = importance.resample(strange, target, percent=percent)
        assert sorted(map(tuple, got.collect()), key=repr) == _plain_resample(rows, [r[0] for r in target.collect()], percent)
    assert importance.resample(nothing, target).count() == 0
    assert importance.resample(strange, target.limit(0)).count() == len(ROWS)


def test_draw_of_many_equal_scores(spark):
    scored = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), (F.col("id") % 3).alias("score"))
    got = importance.draw(scored.repartition(6), 40, 20).filter("rank is not null").orderBy("rank").select("rank", "doc_id").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 3), i))[:2000]
    assert [(r[0], r[1]) for r in got] == list(enumerate(want, 1))
