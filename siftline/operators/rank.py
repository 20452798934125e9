"""Weighted relevance: labelled branches of a pattern give lines and files a score."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans import regex
from siftline.plans.regex import Options

_LABEL = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_MARK = re.compile(r"<([A-Za-z_][A-Za-z0-9_]*)>")
#: An opening bracket with what belongs to it: a group's name or flags.
_OPEN = re.compile(r"\((\?P?<\w+>|\?[a-zA-Z-]*:|\?[a-zA-Z-]+(?=\)))?")


@dataclass(frozen=True)
class Ranking:
    """The pattern without labels, the same with an empty group at each label, and the groups' numbers and weights."""

    plain: str
    marked: str = ""
    weights: tuple[tuple[int, float], ...] = ()


def parse_weights(spec: str) -> dict[str, float]:
    """Weights of ``label:weight,...``; raises ValueError for anything malformed."""
    out = {}
    for term in filter(None, map(str.strip, spec.split(","))):
        label, colon, weight = term.partition(":")
        if not colon:
            raise ValueError(f"weight {term!r} must be label:weight")
        if not _LABEL.fullmatch(label):
            raise ValueError(f"weight label {label!r} must be a word")
        try:
            value = float(weight.replace("_", "x"))  # Python's marks within numbers are none here
        except ValueError:
            raise ValueError(f"weight {weight!r} of {label!r} is not a number") from None
        if not math.isfinite(value):
            raise ValueError(f"weight of {label!r} must be finite")
        out[label] = value
    if not out:
        raise ValueError("no weights")
    return out


def parse(pattern: str, spec: str | None = None, fixed: bool = False) -> Ranking:
    """Strip declared ``<label>`` marks; each weighs the branch before it, up to the last bracket or bar.

    Other angle brackets, escaped characters and classes are ordinary pattern text. In
    place of a label the marked pattern has an empty group, which takes part in a match
    just when the branch before it does.
    """
    if spec is None:
        return Ranking(pattern)
    if fixed:
        raise ValueError("weights don't go with a fixed text, which has no branches")
    known = parse_weights(spec)
    plain, marked, weights = [], [], []
    groups, begun, i = 0, False, 0  # begun: the current branch has some text
    while i < len(pattern):
        c = pattern[i]
        label = _MARK.match(pattern, i)
        if label and label[1] in known:
            if not begun:
                raise ValueError(f"label <{label[1]}> has no branch before it")
            groups += 1
            weights.append((groups, known[label[1]]))
            marked.append("()")
            begun, i = False, label.end()
            continue
        opened = _OPEN.match(pattern, i)
        step = 2 if c == "\\" else _class_length(pattern, i) if c == "[" else len(opened[0]) if opened else 1
        if opened:
            groups += opened[1] is None or opened[1].startswith(("?P<", "?<"))
        begun = c not in "(|)"
        plain.append(pattern[i : i + step])
        marked.append(plain[-1])
        i += step
    regex.parse("".join(marked))
    return Ranking("".join(plain), "".join(marked), tuple(weights)) if weights else Ranking("".join(plain))


def _class_length(pattern: str, at: int) -> int:
    depth, i = 0, at
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        if pattern[i] == "[":
            depth += 1
            if pattern[i + 1 : i + 2] == "^":
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                i += 1
        elif pattern[i] == "]":
            depth -= 1
            if not depth:
                return i - at + 1
        i += 1
    return len(pattern) - at


def score(text: Column, ranking: Ranking, options: Options = Options()) -> Column:
    """The largest weight of the branches in a line's first match, 0 at least."""
    if not ranking.weights:
        return F.lit(0.0)
    java = regex.to_java(ranking.marked, options)
    out = [F.lit(0.0), F.lit(0.0)]
    for group, weight in ranking.weights:
        # the first match, held fast; a reference to an empty group fits only if the group took part in it
        out.append(F.when(text.rlike(f"\\A(?>[\\s\\S]*?(?:{java}))\\{group}"), F.lit(weight)).otherwise(F.lit(0.0)))
    return F.greatest(*out)


def file_scores(rows: DataFrame, ranking: Ranking, options: Options = Options()) -> DataFrame:
    """(path, score): the best score of each file's match rows."""
    return rows.filter("is_match").groupBy("path").agg(F.max(score(F.col("text"), ranking, options)).alias("score"))


def weighted(rows: DataFrame, ranking: Ranking, options: Options = Options()) -> DataFrame:
    """``rows`` with the order_value of the weight order, from one search.

    Rows are scored once and written to the checkpoint folder; the files' best scores, added up
    where the rows are before any shuffle, are joined to them.
    """
    from siftline.operators.page import written
    from siftline.operators.sort import SCORE_STEPS

    told = F.when(F.col("is_match"), -F.round(score(F.col("text"), ranking, options) * SCORE_STEPS).cast("long"))
    scored = written(rows.withColumn("__value", told))
    best = scored.filter("is_match").groupBy("path").agg(F.min("__value").alias("order_value"))
    return scored.drop("__value").join(best, "path", "left").withColumn("order_value", F.coalesce("order_value", F.lit(0).cast("long")))


def relevance(ranked: DataFrame, touched: DataFrame) -> DataFrame:
    """One row a ranking: queries, precision_at_1 and mrr of what was wanted; an extension.

    ``ranked`` has ranking, query, path and rank (from 1), ``touched`` the wanted query and
    path. A query whose wanted file is not among its ranked ones counts as 0.
    """
    wanted = touched.select("query", "path").distinct()
    names = ranked.select("ranking").distinct()
    asked = names.join(ranked.select("ranking", "query").distinct(), "ranking").join(wanted.select("query").distinct(), "query", "left_semi")
    best = ranked.join(wanted, ["query", "path"]).groupBy("ranking", "query").agg(F.min("rank").alias("rank"))
    told = asked.join(best, ["ranking", "query"], "left")
    first, reciprocal = F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0)), F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return told.groupBy("ranking").agg(F.count("*").alias("queries"), F.avg(first).alias("precision_at_1"), F.avg(reciprocal).alias("mrr"))
