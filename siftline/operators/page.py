"""Keyset pages of results, their headers and views, and cursors that continue them."""

from __future__ import annotations

import base64
import itertools
import json
import secrets
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators.search import count_per_file, nearest_match, totals
from siftline.operators.sort import SortSpec, after, order_values, ordering

#: Matches (or files) of a page, and characters of a line that is shown in full.
PAGE_SIZE, MOST_COLUMNS = 50, 200
CURSOR_VERSION = 1


def matches_page(rows: DataFrame, spec: SortSpec = SortSpec(), size: int = PAGE_SIZE, start_after: dict | None = None) -> DataFrame:
    """The next ``size`` match rows in the total order; ``rows`` has order_value. A top-k, not a sort of all."""
    left = rows.filter("is_match")
    if start_after:
        left = left.filter(after(spec, start_after))
    return left.orderBy(*ordering(spec)).limit(max(1, size))


def files_page(rows: DataFrame, spec: SortSpec = SortSpec(), size: int = PAGE_SIZE, start_after: dict | None = None) -> DataFrame:
    """(path, order_value, n) of the next ``size`` files in order."""
    files = rows.filter("is_match").groupBy("path", "order_value").agg(F.count("*").alias("n"))
    if start_after:
        files = files.filter(after(spec, start_after, lines=False))
    return files.orderBy(*ordering(spec, lines=False)).limit(max(1, size))


def with_context_of(page: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that a page shows: its matches and the context whose nearest match is among them."""
    owned = nearest_match(rows).withColumn("block_owner", F.col("owner"))
    keys = page.select("file_id", F.col("line_no").alias("block_owner")).distinct()
    shown = page.select("file_id", "line_no", "ordinal").withColumn("on_page", F.lit(True))
    out = owned.join(keys, ["file_id", "block_owner"], "left_semi").join(shown, ["file_id", "line_no", "ordinal"], "left")
    return out.filter(~F.col("is_match") | F.col("on_page")).drop("owner", "block_owner", "on_page")


def truncated(text: Column, start: Column, most: int = MOST_COLUMNS) -> Column:
    """``text`` cut to ``most`` characters around the match that begins at character ``start`` (from 1; 0 for the head)."""
    n = F.length(text)
    at = F.greatest(start - 1, F.lit(0))
    begin = F.least(F.greatest(at - most // 3, F.lit(0)), n - most)
    cut = F.concat(F.when(begin > 0, F.lit("…")).otherwise(F.lit("")), F.substr(text, begin + 1, F.lit(most)), F.when(begin + most < n, F.lit("…")).otherwise(F.lit("")))
    return F.when(n <= most, text).otherwise(cut)


def grouped(rows: DataFrame, most: int = MOST_COLUMNS) -> DataFrame:
    """(path, lines): one row a file, its rows as ``  N: text`` or, for context, ``  N- text``, in order.

    Meant for pages: a file's rows meet in one array.
    """
    sign = F.when(F.col("is_match"), F.lit(":")).otherwise(F.lit("-"))
    view = F.concat(F.lit("  "), F.col("line_no").cast("string"), sign, F.lit(" "), truncated(F.col("text"), F.col("match_start"), most))
    told = rows.withColumn("view", F.struct("line_no", "ordinal", view.alias("view")))
    return told.groupBy("path").agg(F.transform(F.sort_array(F.collect_list("view")), lambda x: x["view"]).alias("lines"))


def header(mode: str, first: int, last: int, total_matches: int, total_files: int) -> str:
    """The line above a page; ``mode`` is matches, files or count."""
    if not total_matches:
        return "[no matches]"
    files = f"{total_files} file{'' if total_files == 1 else 's'}"
    if mode == "files":
        return f"[files {first}-{last} of {total_files}]"
    if mode == "count":
        return f"[count {first}-{last} of {files} · {total_matches} match{'' if total_matches == 1 else 'es'}]"
    return f"[matches {first}-{last} of {total_matches} in {files}]"


def headers(meta: DataFrame) -> DataFrame:
    """``meta`` (first_index, last_index, total_matches, total_files) with the header of a matches page."""
    plural = F.when(F.col("total_files") == 1, F.lit("")).otherwise(F.lit("s"))
    text = F.format_string("[matches %d-%d of %d in %d file%s]", "first_index", "last_index", "total_matches", "total_files", plural)
    return meta.withColumn("header", F.when(F.col("total_matches") == 0, F.lit("[no matches]")).otherwise(text))


@dataclass
class Cursor:
    """What a page needs to be continued."""

    mode: str
    patterns: list[str]
    options: dict = field(default_factory=dict)
    page_size: int = PAGE_SIZE
    sort: str = "none"
    reverse: bool = False
    weights: str | None = None
    last_key: dict | None = None
    shown: int = 0
    prev_total: int = 0
    fingerprint: int = 0
    root: str = ""

    def encode(self) -> str:
        return base64.urlsafe_b64encode(json.dumps({"v": CURSOR_VERSION, **asdict(self)}).encode()).decode()

    @classmethod
    def decode(cls, text: str) -> Cursor:
        """The cursor of a text; raises ValueError for another version or damage."""
        try:
            told = json.loads(base64.urlsafe_b64decode(text.encode()))
        except Exception as e:
            raise ValueError("not a cursor") from e
        if not isinstance(told, dict) or told.pop("v", None) != CURSOR_VERSION:
            raise ValueError("cursor of another version")
        try:
            return cls(**told)
        except TypeError as e:
            raise ValueError("not a cursor") from e


class CursorStore:
    """Cursors by token; a token works once, for ``ttl`` seconds, in this session."""

    def __init__(self, ttl: float = 120.0, clock=time.monotonic):
        self.ttl, self.clock = ttl, clock
        self.session = secrets.token_hex(4)
        self.next = itertools.count(1)
        self.kept: dict[str, tuple[float, str]] = {}

    def put(self, cursor: Cursor) -> str:
        now = self.clock()
        self.kept = {t: x for t, x in self.kept.items() if x[0] > now}
        token = f"{self.session}-{next(self.next)}"
        self.kept[token] = (now + self.ttl, cursor.encode())
        return token

    def take(self, token: str) -> Cursor:
        """The cursor of a token, which is then spent; raises KeyError for unknown, spent or old ones."""
        until, text = self.kept.pop(token)
        if until <= self.clock():
            raise KeyError(token)
        return Cursor.decode(text)


class OpenCursors:
    """Cursors that are their own tokens, for callers that outlive no process; nothing is kept."""

    def put(self, cursor: Cursor) -> str:
        return cursor.encode()

    def take(self, token: str) -> Cursor:
        return Cursor.decode(token)


def staleness(cursor: Cursor, total: int, fingerprint: int) -> str | None:
    """A note if the results changed since the cursor was made."""
    if cursor.fingerprint == fingerprint and cursor.prev_total == total:
        return None
    return f"[note: results changed since the last page: {cursor.prev_total} then, {total} now]"


@dataclass
class Page:
    """One page: its rows (a DataFrame), its header and what it says about the whole."""

    rows: DataFrame
    header: str
    total_matches: int
    total_files: int
    first_index: int
    last_index: int
    has_more: bool
    fingerprint: int
    last_key: dict | None


def paged(rows: DataFrame, spec: SortSpec = SortSpec(), mode: str = "matches", size: int = PAGE_SIZE, start_after: dict | None = None, shown: int = 0, files: DataFrame | None = None, scores: DataFrame | None = None) -> Page:
    """A page of match rows, or of files for the modes files and count, with its header."""
    ordered = order_values(rows, spec, files, scores).persist()
    try:
        told = totals(ordered).first()
        page = matches_page(ordered, spec, size, start_after) if mode == "matches" else files_page(ordered, spec, size, start_after)
        got = page.collect()  # a page
        spark = rows.sparkSession
        total = told["total_matches"] if mode == "matches" else told["total_files"]
        last = got[-1].asDict() if got else None
        names = ("order_value", "path", "line_no", "ordinal") if mode == "matches" else ("order_value", "path")
        first_index, last_index = (shown + 1, shown + len(got)) if got else (0, 0)
        head = header(mode, first_index, last_index, told["total_matches"], told["total_files"])
        return Page(spark.createDataFrame(got, page.schema), head, told["total_matches"], told["total_files"], first_index, last_index, last_index < total and bool(got), told["fingerprint"], {n: last[n] for n in names} if last else None)
    finally:
        ordered.unpersist()


def numbered(rows: DataFrame, spec: SortSpec = SortSpec()) -> DataFrame:
    """``rows`` (with order_value) and their place in the total order, for reports.

    A range-partitioned sort is written to the session's checkpoint folder; its
    partitions' sizes (one row each) give every partition its first place, and no task
    sees all rows.
    """
    placed = written(rows.orderBy(*ordering(spec)).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    out = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn("rank", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__at", "__start")


@dataclass(frozen=True)
class Snapshot:
    """All pages of a result as it was when it was searched: rows in their order with ``rank``, in files by range of rank."""

    spark: SparkSession
    path: str
    size: int = PAGE_SIZE

    @classmethod
    def write(cls, rows: DataFrame, path: str, spec: SortSpec = SortSpec(), size: int = PAGE_SIZE) -> Snapshot:
        """Keep the match rows (with order_value) of one search below a folder, named by the search's fingerprint."""
        placed = numbered(rows.filter("is_match"), spec)
        mark = totals(placed).first()["fingerprint"] & (1 << 64) - 1
        place = f"{path.rstrip('/')}/{mark:016x}"
        placed.sortWithinPartitions("rank").write.mode("overwrite").parquet(place)
        return cls(rows.sparkSession, place, max(1, size))

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def page(self, number: int) -> DataFrame:
        """The rows of one page (from 1): row groups of other ranks are not read."""
        return self._rows().filter((F.col("rank") > (number - 1) * self.size) & (F.col("rank") <= number * self.size))

    def pages(self) -> DataFrame:
        """All rows with the number of their page."""
        return self._rows().withColumn("page", F.floor((F.col("rank") - 1) / self.size).cast("long") + 1)

    def bounds(self) -> DataFrame:
        """(page, first_index, last_index, has_more) of every page."""
        total = self._rows().count()
        each = self.pages().groupBy("page").agg(F.min("rank").alias("first_index"), F.max("rank").alias("last_index"))
        return each.withColumn("has_more", F.col("last_index") < total)


def written(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, so that its partitions stay as they are; a folder is set only where none is, as in tests."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="siftline-"))
    return df.checkpoint()


__all__ = ["Cursor", "CursorStore", "OpenCursors", "Page", "Snapshot", "count_per_file", "files_page", "grouped", "header", "headers", "matches_page", "numbered", "paged", "staleness", "truncated", "with_context_of", "written"]
