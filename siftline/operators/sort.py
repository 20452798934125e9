"""Result order: one number a file, then path, line and ordinal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("none", "path", "modified", "accessed", "created", "weight", "match-count", "path-kind", "folder-distance", "in-folder")
#: Folders and names by which path-kind tells tests and what others wrote; all else is source.
TESTS, FOREIGN = r"(?i)(^|/)(tests?|specs?|__tests__|testdata|fixtures)/|(^|/)test_[^/]*$|[._-](test|spec)s?\.[^/]*$", r"(?i)(^|/)(vendor|third_party|node_modules|generated|dist|build|target)/|\.min\.[^/]*$|[._-](generated|pb)\.[^/]*$"
#: Steps of a score that count as different.
SCORE_STEPS = 1_000_000


@dataclass(frozen=True)
class SortSpec:
    """Key and direction; reversing turns files around, lines of a file always ascend.

    ``folder-distance`` and ``in-folder`` take a reference path, as in ``in-folder:src``.
    """

    key: str = "none"
    reverse: bool = False
    reference: str = ""

    def __post_init__(self):
        name, colon, reference = self.key.partition(":")
        if colon and name in ("folder-distance", "in-folder"):
            object.__setattr__(self, "key", name)
            object.__setattr__(self, "reference", reference.strip("/"))
        if self.key == "in-folder" and not self.reference:
            raise ValueError("in-folder needs a path, as in in-folder:src")
        if self.key not in KEYS:
            raise ValueError(f"unknown sort key: {self.key}")
        if self.key == "none":
            object.__setattr__(self, "reverse", False)


def order_values(rows: DataFrame, spec: SortSpec, files: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``order_value``: times in ns (0 if unknown), the negative score in millionths, or 0.

    ``files`` has path and the columns mtime_ns, atime_ns, ctime_ns that a time key
    needs; ``scores`` has path and score. match-count and the path keys are extensions:
    path-kind puts source before tests before what others wrote, folder-distance counts
    the folders between a file's folder and the reference, in-folder puts files below
    the reference first.
    """
    zero = F.lit(0).cast("long")
    if spec.key == "path-kind":
        return rows.withColumn("order_value", F.when(F.col("path").rlike(FOREIGN), 2).when(F.col("path").rlike(TESTS), 1).otherwise(0).cast("long"))
    if spec.key == "in-folder":
        return rows.withColumn("order_value", F.when(F.startswith(F.col("path"), F.lit(spec.reference + "/")), 0).otherwise(1).cast("long"))
    if spec.key == "folder-distance":
        return rows.withColumn("order_value", _distance(F.col("path"), spec.reference).cast("long"))
    if spec.key in ("none", "path"):
        return rows.withColumn("order_value", zero)
    if spec.key == "match-count":
        values = rows.filter("is_match").groupBy("path").agg((-F.count("*")).alias("order_value"))
    elif spec.key == "weight":
        if scores is None:
            raise ValueError("sort by weight needs weights")
        values = scores.select("path", (-F.round(F.col("score") * SCORE_STEPS)).cast("long").alias("order_value"))
    else:
        column = {"modified": "mtime_ns", "accessed": "atime_ns", "created": "ctime_ns"}[spec.key]
        if files is None or column not in files.columns:
            return rows.withColumn("order_value", zero)
        values = files.select("path", F.col(column).cast("long").alias("order_value"))
    return rows.join(values, "path", "left").withColumn("order_value", F.coalesce("order_value", zero))


def _distance(path: Column, folder: str) -> Column:
    """Steps up and down the tree from a folder to the folder of each path."""
    here = [x for x in folder.split("/") if x]
    parts = F.split(path, "/")
    shared = F.lit(0)
    for k in range(len(here), 0, -1):
        whole = F.lit("/".join(here[:k]) + "/")
        shared = F.greatest(shared, F.when(F.startswith(path, whole), F.lit(k)).otherwise(F.lit(0)))
    return F.lit(len(here)) + F.size(parts) - 1 - 2 * shared


def ordering(spec: SortSpec, lines: bool = True) -> list[Column]:
    """Sort columns of the total order."""
    turn = (lambda c: F.col(c).desc()) if spec.reverse else (lambda c: F.col(c).asc())
    return [turn("order_value"), turn("path")] + ([F.col("line_no").asc(), F.col("ordinal").asc()] if lines else [])


def after(spec: SortSpec, key: dict, lines: bool = True) -> Column:
    """Whether a row comes after ``key`` in the total order."""
    same, out = F.lit(True), F.lit(False)
    names = ["order_value", "path"] + (["line_no", "ordinal"] if lines else [])
    for name in names:
        beyond = F.col(name) < key[name] if spec.reverse and name in ("order_value", "path") else F.col(name) > key[name]
        out = out | (same & beyond)
        same = same & (F.col(name) == key[name])
    return out
