"""Search: from patterns and options to match rows, by scan, prefilter or index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.filters import FileFilter
from siftline.operators.index import Index
from siftline.plans import regex
from siftline.plans.query import ALL, Query, for_pattern
from siftline.plans.regex import Options, PatternError
from siftline.sources.corpus import Corpus, explode_lines, line_array


#: Candidates that become a list in the filter, and those that are broadcast at most.
LISTED, BROADCAST = 1_000, 200_000
#: Measured by bench.py: seconds that a lookup's jobs take, and bytes a second and core that are read for a pattern, and for its required text.
LOOKUP_SECONDS, MATCHED_BYTES, REQUIRED_BYTES = 0.4, 30e6, 100e6


@dataclass(frozen=True)
class SearchOptions:
    """What a search looks for and which rows it gives."""

    ignore_case: bool = False
    word: bool = False
    fixed: bool = False
    multi_line: bool = False
    dot_all: bool = False
    invert: bool = False
    only_matching: bool = False
    before: int = 0
    after: int = 0
    filter: FileFilter = field(default_factory=FileFilter)
    scope: str = ""
    file: str | None = None

    def pattern_options(self) -> Options:
        return Options(self.ignore_case, self.word, False, self.multi_line, self.dot_all)


@dataclass(frozen=True)
class Plan:
    """A search's Java pattern, the trigrams it needs and the text every match holds."""

    pattern: str
    java: str
    query: Query
    literal: str
    options: SearchOptions

    @property
    def is_fallback(self) -> bool:
        """Whether no index can narrow this search."""
        return self.options.invert or self.query.is_all


def plan(patterns: str | list[str], options: SearchOptions = SearchOptions()) -> Plan:
    """Analyse and check a search; raises PatternError or ValueError, nothing is swallowed later."""
    if options.before < 0 or options.after < 0:
        raise ValueError("context must not be negative")
    pattern = regex.join([patterns] if isinstance(patterns, str) else list(patterns), options.fixed)
    reading = options.pattern_options()
    node = regex.parse(pattern, reading)
    options.filter.condition(F.lit(""))
    if options.multi_line and _may_be_empty(node):
        raise PatternError("a pattern that fits the empty text can't be searched across lines")
    query = ALL if options.invert else for_pattern(node, reading)
    literal = "" if options.invert or reading.ignore_case else regex.required_literal(node)
    return Plan(pattern, regex.to_java(node, reading), query, literal, options)


def _may_be_empty(node: regex.Node) -> bool:
    if node.kind in ("lit", "class", "any"):
        return False
    if node.kind == "rep":
        return node.low == 0 or _may_be_empty(node.items[0])
    return (any if node.kind == "alt" else all)(map(_may_be_empty, node.items))


def narrowed(corpus: Corpus, p: Plan, index: Index | None = None, strategy: str = "auto") -> DataFrame:
    """The files a search reads: path filters, then the index's candidates, then files with the required text.

    ``strategy``: scan (filters only), prefilter (and the required text), index
    (and candidates), auto (index where a lookup costs less than reading the files that it is
    thought to leave out, else prefilter). All give the same matches, also with
    an index of an earlier state of the corpus.
    """
    o = p.options
    files = corpus.files.filter("live and not is_binary")
    if o.file is not None:
        files = files.filter(F.col("path") == o.file)  # a named file is searched whatever the filters say
    else:
        if not o.filter.is_empty:
            files = files.filter(o.filter.condition(F.col("path"), corpus.root))
        if o.scope:
            files = files.filter((F.col("path") == o.scope) | F.startswith(F.col("path"), F.lit(o.scope.rstrip("/") + "/")))
    if strategy == "index" and index is None:
        raise ValueError("no index given")
    if strategy == "auto" and index is not None and not worth_a_lookup(p, index, corpus):
        strategy = "prefilter"
    if strategy in ("index", "auto") and index is not None and not p.is_fallback:
        if index.numbered is corpus:
            files = _among(files, index.matching_ids(p.query)) if index.narrows(p.query) else files
        elif index.of is corpus:
            keys, few = index.candidate_paths(p.query)
            files = files.join(F.broadcast(keys), "path", "left_semi") if few else _among(files, keys)
        else:
            files = _among(files, index.may_match(p.query, files))
    if strategy != "scan" and p.literal:
        files = files.filter(F.contains(F.col("text"), F.lit(p.literal)))
    return files


def worth_a_lookup(p: Plan, index: Index, corpus: Corpus) -> bool:
    """Whether an index is thought to save more reading than its lookup costs, by the corpus's size and the counts of its trigrams."""
    if p.is_fallback or not index.narrows(p.query):
        return False
    rate = (REQUIRED_BYTES if p.literal else MATCHED_BYTES) * corpus.files.sparkSession.sparkContext.defaultParallelism
    read = _bytes(corpus.files) / rate
    return read > LOOKUP_SECONDS and read * (1 - index.share(p.query)) > LOOKUP_SECONDS


def _bytes(df: DataFrame) -> int:
    """What the optimizer takes a table's size to be."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _among(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``files`` whose key is among ``keys`` (path or file_id), without a shuffle of texts while these are few.

    Few keys become a list that Parquet's row group statistics can use, a bounded
    number is broadcast, and beyond that both sides are joined by their hash.
    """
    (key,) = keys.columns
    few = keys.limit(BROADCAST + 1).toArrow()  # of bounded size
    if len(few) > BROADCAST:
        return files.join(keys, key, "left_semi")
    if len(few) <= LISTED:
        return files.filter(F.col(key).isin(few[key].to_pylist()))
    return files.join(F.broadcast(files.sparkSession.createDataFrame(few)), key, "left_semi")


def search(corpus: Corpus, patterns: str | list[str] | Plan, options: SearchOptions = SearchOptions(), index: Index | None = None, strategy: str = "auto") -> DataFrame:
    """Match rows: file_id, path, line_no, ordinal, is_match, text, match_start, block.

    ``ordinal`` numbers several matches of a line (only_matching), ``match_start``
    counts characters from 1 (0 for context and inverted rows), and ``block``
    numbers runs of neighbouring rows of a file when context is asked for, else
    it is 0. Without context a search is one scan without a shuffle.
    """
    p = patterns if isinstance(patterns, Plan) else plan(patterns, options)
    o = p.options
    files = narrowed(corpus, p, index, strategy)
    if o.multi_line:
        return _across_lines(files, p)
    if o.before or o.after:
        return _with_context(files, p)
    lines = explode_lines(files)
    hit = F.col("line").rlike(p.java)
    if o.invert:
        return _rows(lines.filter(~hit), F.lit(0), F.col("line"), F.lit(0))
    matched = lines.filter(hit)
    if not o.only_matching:
        return _rows(matched, F.lit(0), F.col("line"), F.regexp_instr("line", F.lit(p.java)))
    found = F.filter(F.regexp_extract_all("line", F.lit(p.java), F.lit(0)), lambda m: m != "")
    parts = F.split("line", p.java, -1)
    each = matched.select("file_id", "path", "line_no", parts.alias("parts"), found.alias("found"))
    each = each.select("file_id", "path", "line_no", "parts", "found", F.posexplode("found").alias("ordinal", "line"))
    start = F.aggregate(F.slice("parts", F.lit(1), F.col("ordinal") + 1), F.lit(1), lambda n, x: n + F.length(x))
    start = start + F.aggregate(F.slice("found", F.lit(1), F.col("ordinal")), F.lit(0), lambda n, x: n + F.length(x))
    return _rows(each, F.col("ordinal"), F.col("line"), F.when(F.size("parts") == F.size("found") + 1, start).otherwise(0))


def _rows(df: DataFrame, ordinal: Column, text: Column, start: Column, is_match: Column = None, block: Column = None) -> DataFrame:
    return df.select(
        "file_id", "path", "line_no", ordinal.cast("int").alias("ordinal"), (F.lit(True) if is_match is None else is_match).alias("is_match"), text.alias("text"),
        start.cast("int").alias("match_start"), (F.lit(0) if block is None else block).cast("long").alias("block"),
    )


def _with_context(files: DataFrame, p: Plan) -> DataFrame:
    """Matched lines and their neighbours, without a shuffle: a file's row is cut into its blocks, and these into lines."""
    o = p.options
    told = files.select("file_id", "path", line_array(F.col("text")).alias("all"))
    wanted = lambda x: ~x.rlike(p.java) if o.invert else x.rlike(p.java)
    told = told.withColumn("hits", F.filter(F.transform("all", lambda x, i: F.when(wanted(x), i)), lambda i: i.isNotNull())).filter(F.size("hits") > 0)
    # a block begins at a hit whose context leaves a gap to that of the hit before, and ends where the next one begins
    gap = o.before + o.after + 1
    hits, count = F.col("hits"), F.size("hits")
    starts = F.filter(hits, lambda h, i: (i == 0) | (h - F.get(hits, i - 1) > gap))
    ends = F.filter(hits, lambda h, i: (i == count - 1) | (F.get(hits, i + 1) - h > gap))
    last = F.size("all") - 1

    def block(first: Column, final: Column) -> Column:
        low, high = F.greatest(first - o.before, F.lit(0)), F.least(final + o.after, last)
        return F.struct(low.alias("low"), F.slice("all", low + 1, high - low + 1).alias("lines"))

    blocks = told.withColumn("starts", starts).withColumn("ends", ends).select("file_id", "path", F.posexplode(F.zip_with("starts", "ends", block)).alias("block", "b"))
    shown = blocks.select("file_id", "path", "block", "b.low", F.posexplode("b.lines").alias("pos", "line"))
    shown = shown.withColumn("is_match", wanted(F.col("line"))).withColumn("line_no", (F.col("low") + F.col("pos") + 1).cast("long"))
    start = F.when(F.col("is_match") & F.lit(not o.invert), F.regexp_instr("line", F.lit(p.java))).otherwise(0)
    whole = _rows(shown, F.lit(0), F.col("line"), start, F.col("is_match"), F.col("block"))
    if not o.only_matching or o.invert:
        return whole
    found = F.filter(F.regexp_extract_all("text", F.lit(p.java), F.lit(0)), lambda m: m != "")
    parts = F.when(F.col("is_match"), found).otherwise(F.array("text"))
    each = whole.select("file_id", "path", "line_no", "is_match", "block", "match_start", F.posexplode(parts).alias("ordinal", "line"))
    return _rows(each, F.col("ordinal"), F.col("line"), F.when(F.col("ordinal") == 0, F.col("match_start")).otherwise(0), F.col("is_match"), F.col("block"))


def _across_lines(files: DataFrame, p: Plan) -> DataFrame:
    """Matches that may span lines: one row for each line a match touches, or each match.

    A text is split at its matches and the matches are extracted; both lists add up
    to the text again, which gives each match its place without a Python function.
    """
    o = p.options
    body = F.substring_index("text", "\0", 1)
    told = files.select("file_id", "path", body.alias("body")).filter(F.col("body").rlike(p.java) | F.lit(o.invert))
    told = told.withColumn("found", F.regexp_extract_all("body", F.lit(p.java), F.lit(0))).withColumn("parts", F.split("body", p.java, -1))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    pairs = F.zip_with("parts", "found", lambda gap, m: F.struct(breaks(gap).alias("gap"), breaks(m).alias("own"), m.alias("m"), F.element_at(F.split(gap, "\n", -1), -1).alias("tail")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())

    def add(state: Column, x: Column) -> Column:
        first = state["line"] + x["gap"]
        end = first + x["own"] - F.when(F.endswith(x["m"], F.lit("\n")), 1).otherwise(0)
        column = F.when(x["gap"] > 0, F.length(x["tail"])).otherwise(state["column"] + F.length(x["tail"]))
        after = F.length(F.element_at(F.split(x["m"], "\n", -1), -1))
        row = F.struct(first.alias("first"), F.greatest(first, end).alias("last"), x["m"].alias("m"), (column + 1).alias("start"))
        return F.struct((first + x["own"]).alias("line"), F.when(x["own"] > 0, after).otherwise(column + after).alias("column"), F.concat(state["rows"], F.array(row)).alias("rows"))

    zero = F.struct(F.lit(1).alias("line"), F.lit(0).alias("column"), F.expr("cast(array() as array<struct<first:int,last:int,m:string,start:int>>)").alias("rows"))
    told = told.withColumn("pairs", pairs).withColumn("rows", F.aggregate("pairs", zero, add)["rows"])
    if o.only_matching and not o.invert:
        each = told.select("file_id", "path", F.posexplode("rows").alias("k", "r")).select("file_id", "path", F.col("r.first").cast("long").alias("line_no"), "k", "r.m", "r.start")
        ordinal = F.row_number().over(Window.partitionBy("file_id", "line_no").orderBy("k")) - 1
        return _rows(each.withColumn("ordinal", ordinal), F.col("ordinal"), F.col("m"), F.col("start"))
    touched = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.sequence(r["first"], r["last"]))))
    told = told.withColumn("touched", touched).withColumn("all", line_array(F.col("body")))
    wanted = F.array_except(F.sequence(F.lit(1), F.size("all")), F.col("touched")) if o.invert else F.filter("touched", lambda i: i <= F.size("all"))
    wanted = F.when(F.size("all") > 0, wanted)
    each = told.select("file_id", "path", "all", "rows", F.explode(wanted).alias("line_no"))
    start = F.when(F.lit(o.invert), F.lit(0)).otherwise(F.coalesce(F.get(F.filter("rows", lambda r: r["first"] == F.col("line_no")), F.lit(0))["start"], F.lit(0)))
    out = each.select("file_id", "path", F.col("line_no").cast("long").alias("line_no"), F.element_at("all", F.col("line_no")).alias("line"), start.alias("start"))
    return _rows(out, F.lit(0), F.col("line"), F.col("start"))


def nearest_match(rows: DataFrame) -> DataFrame:
    """``rows`` with ``owner``: the nearest match's line within the block; of two equally near the earlier one."""
    line = F.when(F.col("is_match"), F.col("line_no"))
    w = Window.partitionBy("file_id", "block").orderBy("line_no", "ordinal")
    back = F.last(line, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(line, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    nearer = F.when(back.isNull() | (ahead.isNotNull() & (ahead - F.col("line_no") < F.col("line_no") - back)), ahead).otherwise(back)
    return rows.withColumn("owner", nearer)


def files_with_matches(rows: DataFrame) -> DataFrame:
    """(path) of every file with a match."""
    return rows.filter("is_match").select("path").distinct()


def count_per_file(rows: DataFrame) -> DataFrame:
    """(path, n): match rows of each file, which are lines, or occurrences of an only-matching search."""
    return rows.filter("is_match").groupBy("path").agg(F.count("*").alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: total_matches, total_files, fingerprint; the last changes when the set of matches does."""
    key = F.xxhash64("path", "line_no", "ordinal")
    of = rows.filter("is_match").groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(key).alias("x"))
    return of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"), F.count("*").alias("total_files"), F.coalesce(F.bit_xor("x"), F.lit(0)).alias("fingerprint"))


def line_spans(rows: DataFrame) -> DataFrame:
    """(path, first_line, last_line, n): an extension that tells what part of each file holds its matches."""
    return rows.filter("is_match").groupBy("path").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n"))


def rendered(rows: DataFrame, line_numbers: bool = True, paths: bool = True, prefix: str = "") -> DataFrame:
    """``rows`` with ``rendered``: ``path:line:text``, with ``-`` instead of ``:`` for context."""
    sep = F.when(F.col("is_match"), F.lit(":")).otherwise(F.lit("-"))
    parts = [F.concat(F.lit(prefix), F.col("path"), sep)] if paths else []
    parts += [F.concat(F.col("line_no").cast("string"), sep)] if line_numbers else []
    return rows.withColumn("rendered", F.concat(*parts, F.col("text")))
