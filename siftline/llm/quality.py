"""Quality rules whose cutoffs bound the false rejections of good documents.

Each rule rejects a document whose measure exceeds a cutoff. Labelled good
documents of a stratum tell how many a cutoff would reject; an exact
(Clopper-Pearson) upper bound of the false rejection rate must stay below the
rule's share of ``RISK``. Cutoffs are tested from the most lenient on until one
fails (a fixed sequence needs no correction), and the error level is split over
all strata that are tested and all rules (Bonferroni), so with probability
``1 - LEVEL`` no stratum loses more than ``RISK`` of its good documents. Every
stratum is tested that has enough labelled good documents for any cutoff to be
certified; one with fewer keeps everything, and so does null if it has fewer.
Among the certified cutoffs the one is taken that rejects most labelled bad
documents, less ``CARE`` times the good ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import CLASSES_AT_ONCE, cut, runs, small_batches, strings

#: Share of a stratum's good documents that all rules together may reject, and the chance of an error.
RISK, LEVEL = 0.05, 0.05
#: Measures, each with the cutoffs tried, from lenient to strict.
CUTOFFS = {
    "symbols_per_char": [x / 200 for x in range(60, 1, -1)],
    "marked_words": [x / 50 for x in range(49, 4, -1)],
    "upper_case": [x / 50 for x in range(49, 4, -1)],
    "top_word": [x / 50 for x in range(45, 5, -1)],
}
#: Good documents that weigh as much as one bad one when a certified cutoff is chosen.
CARE = 20
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_LOWER = re.compile(rb"[a-z]")
_MARKED = re.compile(rb"[!?*#$%&|~^]{2}|^[|]$")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(ids: np.ndarray, n: int = 5) -> int:
    """Words that stand in windows of ``n`` words found twice or more."""
    if len(ids) <= n:
        return 0
    count = len(ids) - n + 1
    mixed = ids.astype(np.uint64) + np.uint64(1)
    key = np.zeros(count, np.uint64)
    for k in range(n):
        key = (key ^ (mixed[k : k + count] * _MIX[k % len(_MIX)])) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    if (ordered[1:] != ordered[:-1]).all():
        return 0
    rank = ids.astype(np.int64)  # exact: a window's rank is built from those of its parts
    for k in range(1, n):
        _, rank = np.unique(rank[: len(ids) - k] * np.int64(len(ids) + 1) + ids[k:], return_inverse=True)
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the measures in the order of CUTOFFS."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0, *[0.0] * len(CUTOFFS))
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    duplicates = len(lines) - len(set(lines))
    repeated = repeated_words(ids)
    counts = np.bincount(ids)
    distinct = list(seen)
    marked = sum(counts[i] for i, w in enumerate(distinct) if _MARKED.search(w))
    upper = sum(counts[i] for i, w in enumerate(distinct) if len(w) > 1 and not _LOWER.search(w) and _is_upper(w))
    return (
        n, chars, symbols, duplicates, repeated,
        symbols / chars, float(marked) / n, float(upper) / n, float(counts.max() - 1) / n,
    )


def _is_upper(word: bytes) -> bool:
    """Whether a word of two letters or more of any script has capitals only."""
    text = word.decode("utf-8", "surrogatepass")
    return text.isupper() and sum(map(str.isalpha, text)) > 1


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _digest(text: str) -> int:
    """64 bits that tell equal texts, as a signed number."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def measures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, digest (of the text), the counts and the measures of every row; null texts have no words."""
    small_batches(df.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(2))
            got = [measure(t) for start, end in runs(texts) for t in texts[start:end]]
            columns = [pa.array([int(g[k]) for g in got], pa.int64()) for k in range(5)]
            columns += [pa.array([g[5 + k] for g in got], pa.float64()) for k in range(len(CUTOFFS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(_digest, texts)), pa.int64()), *columns], ["doc_id", "stratum", "digest", *_COUNTS, *CUTOFFS])

    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
    return read.mapInArrow(of, "doc_id long, stratum string, digest long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + ", ".join(f"{c} double" for c in CUTOFFS))


def upper_bound(rejected: int, total: int, level: float) -> float:
    """Exact upper confidence bound of a rate, by bisection of the binomial tail."""
    if rejected >= total:
        return 1.0
    lgamma, log = math.lgamma, math.log
    steps = np.arange(rejected + 1)
    ways = np.array([lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) for k in steps])
    low, high = rejected / total, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = ways + steps * log(p) + (total - steps) * (np.log1p(-p) if p < 1 else -np.inf)
        if np.exp(terms).sum() > level:
            low = p
        else:
            high = p
    return high


def _exceeded(rule: str, tries: list[float]) -> Column:
    """How many of the cutoffs a row's measure exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, tries)), lambda t: F.col(rule) > t))


def least_good(strata: int, risk: float = RISK, level: float = LEVEL) -> int:
    """Labelled good documents, none of them rejected, that certify a cutoff if so many strata are tested."""
    return math.ceil(math.log(level / (len(CUTOFFS) * max(1, strata))) / math.log1p(-risk / len(CUTOFFS)))


def certified(tally: dict[tuple, Counter], strata: list, risk: float = RISK, level: float = LEVEL) -> dict[object, dict[str, float]]:
    """Cutoffs by stratum and rule, from counts by (stratum, rule, quality) of how many cutoffs are exceeded."""
    share, error = risk / len(CUTOFFS), level / (len(CUTOFFS) * max(1, len(strata)))
    found: dict[object, dict[str, float]] = {}
    for stratum in strata:
        for rule, tries in CUTOFFS.items():
            good, bad = (tally.get((stratum, rule, q), Counter()) for q in (1, 0))
            n, best = good.total(), 0
            for i, t in enumerate(tries):
                # a row that exceeds k of the falling cutoffs exceeds the last k of them
                lost, caught = (sum(c for above, c in x.items() if above >= len(tries) - i) for x in (good, bad))
                if not n or upper_bound(lost, n, error) > share:
                    break
                if caught - CARE * lost > best:
                    best = caught - CARE * lost
                    found.setdefault(stratum, {})[rule] = t
    return found


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[object, dict[str, float]]:
    """Certified cutoffs by stratum and rule, from all labelled rows.

    ``labels`` has doc_id and quality (1 is good). Rows of equal text
    count once, for copies are no independent evidence; labels of one doc_id that contradict
    each other count as bad, other labels and rows without doc_id as none, and without
    labels there are no cutoffs. What reaches the driver is a
    row for each cutoff of a stratum with hundreds of labels.
    """
    told = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality in (0, 1)")
    held = measured.filter("not base_failed").join(told, "doc_id").select("stratum", "quality", "digest", *CUTOFFS).distinct()
    good = held.filter("quality = 1").groupBy("stratum").agg(F.count("*").alias("n")).filter(F.col("n") >= least_good(1, risk, level))
    good = {r["stratum"]: r["n"] for r in good.collect()}  # strata with hundreds of labels
    # strata that no cutoff can be certified for are not tested; fewer tests need fewer labels
    count = next((k for k in range(len(good), 0, -1) if sum(n >= least_good(k, risk, level) for n in good.values()) >= k), 0)
    strata = sorted(good, key=lambda s: (-good[s], s is not None, s))[:count]
    if not strata:
        return {}
    names = [s for s in strata if s is not None]
    tested = F.col("stratum").isin(names) if names else F.lit(False)
    tested = tested | F.col("stratum").isNull() if None in strata else tested
    cells = [F.struct(F.lit(rule).alias("rule"), _exceeded(rule, tries).alias("above")) for rule, tries in CUTOFFS.items()]
    table = held.filter(tested).select("stratum", "quality", F.explode(F.array(*cells)).alias("c")).groupBy("stratum", "quality", "c.rule", "c.above").count().collect()
    tally: dict[tuple, Counter] = {}
    for r in table:
        tally.setdefault((r["stratum"], r["rule"], r["quality"]), Counter())[r["above"]] += r["count"]
    return certified(tally, strata, risk, level)


def judge(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed, kept and reasons of every row.

    Base rule: under 10 words, or over a fifth of the words in repeated windows.
    Other rows are kept unless a measure exceeds its stratum's certified cutoff;
    ``reasons`` lists those rules. Null and empty texts fail the base rule. Rows
    stay as often as they stand; labels without a document count for nothing.
    """
    measured = cut(measures(df, doc_id, text, stratum).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    rows = [(s, *[rules.get(r) for r in CUTOFFS]) for s, rules in cutoffs(measured, labels).items()]
    limits = df.sparkSession.createDataFrame(rows, "s string, " + ", ".join(f"limit_{r} double" for r in CUTOFFS))
    joined = measured.join(F.broadcast(limits) if len(rows) <= CLASSES_AT_ONCE else limits, F.col("stratum").eqNullSafe(F.col("s")), "left")
    reasons = F.filter(F.array(*[F.when(F.col(r) > F.col(f"limit_{r}"), F.lit(r)) for r in CUTOFFS]), lambda x: x.isNotNull())
    out = joined.withColumn("reasons", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(reasons))
    return out.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), F.array_join("reasons", ",").alias("reasons"))
