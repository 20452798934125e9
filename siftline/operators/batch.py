"""Many searches in one pass over a corpus.

Each pattern, or fixed text of a table, is filed under the rarest trigram of a
text that all its matches hold. A bit table of all filed trigrams (2 MiB, however
many patterns there are) picks the lines, and a join by trigram brings the patterns
filed there to a line; only these run on it. Patterns without such a text run on every line,
in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.batches import small_batches, stretches
from siftline.functions.trigrams import trigrams
from siftline.operators.index import Index
from siftline.operators.search import Plan, SearchOptions, narrowed, plan, search
from siftline.sources.corpus import Corpus, explode_lines

#: Files whose trigrams tell which are rare where no index does; they decide on speed alone.
SAMPLED_FILES = 500
#: Bytes of texts whose trigrams are looked at at a time.
TEXT_AT_ONCE = 1 << 20
#: Columns of the rows.
ROWS = ["label", "file_id", "path", "line_no", "ordinal", "is_match", "text", "match_start", "block"]


def counts(corpus: Corpus, index: Index | None) -> DataFrame:
    """(tri, files): how many files hold a trigram, by the index or some files."""
    if index is not None:
        return index.postings.groupBy("tri").agg(F.count("*").alias("files"))
    some = corpus.files.limit(SAMPLED_FILES).select(F.explode(F.array_distinct(trigrams(F.col("text")))).alias("tri"))
    return some.groupBy("tri").agg(F.count("*").alias("files"))


def filed(texts: DataFrame, held: DataFrame) -> DataFrame:
    """``texts`` (key, literal and others) with ``tri``, the literal's rarest trigram (the smaller of equals); null below three bytes."""
    each = texts.select("key", F.explode_outer(F.array_distinct(trigrams(F.col("literal")))).alias("tri"))
    told = each.join(held, "tri", "left").withColumn("rank", F.struct(F.coalesce("files", F.lit(0)).alias("n"), "tri"))
    return texts.join(told.groupBy("key").agg(F.min("rank").alias("rank")), "key").withColumn("tri", F.col("rank.tri")).drop("rank")


def table_of(patterns: DataFrame) -> np.ndarray:
    """One bit for each of all trigrams, set for those under which something is filed."""
    size = 1 << 15
    parts = patterns.filter("tri is not null").groupBy((F.col("tri") / size).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.pmod(F.col("tri").cast("long"), F.lit(size))).alias("b"))
    out = np.zeros(1 << 21, np.uint8)
    for r in parts.toLocalIterator():
        out[r["k"] * size // 8 : (r["k"] + 1) * size // 8] = np.frombuffer(r["b"], np.uint8)
    return out


def lines_with(files: DataFrame, table: np.ndarray) -> DataFrame:
    """(file_id, path, line_no, line, tri): every line and each filed trigram that it holds, once."""
    shared = files.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for some in stretches(np.fromiter((len(x.as_py() or b"") for x in whole.column(2)), np.int64, whole.num_rows), TEXT_AT_ONCE):
                yield from picked(whole.slice(some.start, some.stop - some.start), table)

    def picked(batch: pa.RecordBatch, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, paths = batch.column(0), batch.column(1)
        texts = [(x.as_py() or b"").partition(b"\0")[0] for x in batch.column(2)]
        raw = b"\n".join(texts) + b"\n"
        b = np.frombuffer(raw, np.uint8).astype(np.int32)
        gram = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        at = np.flatnonzero(table[gram >> 3] >> (gram & 7).astype(np.uint8) & 1) if len(b) > 2 else np.zeros(0, np.int64)
        ends = np.flatnonzero(b == 10)
        begins = np.r_[0, ends[:-1] + 1]
        pairs = np.unique(np.searchsorted(ends, at) << 24 | gram[at])
        lines, tris = pairs >> 24, (pairs & 0xFFFFFF).astype(np.int32)
        first = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1])
        # a long line with many trigrams stands there many times
        for some in stretches((ends - begins)[lines] + 64):
            line = lines[some]
            owner = np.searchsorted(first, line, side="right") - 1
            shown = [raw[begins[k] : ends[k]] for k in line.tolist()]
            take = pa.array(owner)
            columns = [ids.take(take), paths.take(take), pa.array(line - first[owner] + 1, pa.int64()), pa.array(shown, pa.binary()).cast(pa.string()), pa.array(tris[some])]
            yield pa.RecordBatch.from_arrays(columns, ["file_id", "path", "line_no", "line", "tri"])

    small_batches(files.sparkSession)
    return files.select("file_id", "path", F.col("text").cast("binary").alias("raw")).mapInArrow(pick, "file_id long, path string, line_no long, line string, tri int")


def batch_search(corpus: Corpus, queries: dict[str, str], options: SearchOptions = SearchOptions(), index: Index | None = None) -> DataFrame:
    """Several labelled searches as one result, the rows of ``search`` with a column ``label``; an extension.

    Plain searches run in one pass. Those that need more of a file than its lines
    (context, inverted, only_matching, matches across lines) are searches one after another.
    """
    if not queries:
        raise ValueError("no query")
    plans = {label: plan(pattern, options) for label, pattern in queries.items()}
    if options.multi_line or options.invert or options.only_matching or options.before or options.after:
        out = None
        for label, p in plans.items():
            one = search(corpus, p, options, index).withColumn("label", F.lit(label)).select(ROWS)
            out = one if out is None else out.unionByName(one)
        return out
    spark = corpus.files.sparkSession
    rows = [(label, p.literal, p.java) for label, p in plans.items()]
    told = filed(spark.createDataFrame(rows, "key string, literal string, java string"), counts(corpus, index)).persist()
    try:
        table, loose = table_of(told), [(r["key"], r["java"]) for r in told.filter("tri is null").collect()]  # queries of the caller
        filed_ = spark.createDataFrame([(r["key"], r["java"], r["tri"]) for r in told.filter("tri is not null").collect()], "label string, java string, tri int")
    finally:
        told.unpersist()
    files = narrowed(corpus, Plan("", "", next(iter(plans.values())).query, "", options), None, "scan")
    hits = lines_with(files, table).join(F.broadcast(filed_), "tri").filter("line rlike java").select("label", "file_id", "path", "line_no", "line", "java")
    if loose:
        every = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(j).alias("java")) for k, j in loose])
        fitting = F.filter(every, lambda x: F.regexp_like(F.col("line"), x["java"]))
        lines = explode_lines(files).select("file_id", "path", "line_no", "line", F.explode(fitting).alias("x"))
        hits = hits.unionByName(lines.select("x.label", "file_id", "path", "line_no", "line", "x.java"))
    start = F.regexp_instr("line", F.col("java"))
    return hits.select("label", "file_id", "path", "line_no", F.lit(0).alias("ordinal"), F.lit(True).alias("is_match"), F.col("line").alias("text"), start.cast("int").alias("match_start"), F.lit(0).cast("long").alias("block"))


def needle_search(corpus: Corpus, needles: DataFrame, needle: str = "needle", index: Index | None = None) -> DataFrame:
    """(needle, file_id, path, line_no): every line that holds a fixed text of a table, however many texts there are.

    A text of several lines is told with the line that each of its places begins in; files
    that hold its trigram are read again. Null and empty texts are nowhere, repeated
    ones count once. Only where there are texts below three bytes, all pairs of characters are looked at.
    """
    texts = needles.select(F.col(needle).alias("key")).filter("key <> ''").distinct()
    told = filed(texts.select("key", F.col("key").alias("literal"), F.contains("key", F.lit("\n")).alias("several")), counts(corpus, index)).drop("literal").persist()
    files = corpus.files.filter("live and not is_binary")
    hits = lines_with(files, table_of(told)).join(told.filter("tri is not null"), "tri")
    one = hits.filter(~F.col("several") & F.contains("line", "key")).select("key", "file_id", "path", "line_no")
    pairs = hits.filter("several").select("key", "file_id")
    short = told.filter("tri is null").select("key", "several")
    if short.limit(1).count():
        lines = explode_lines(files).select("file_id", "path", "line_no", F.explode(_parts(F.col("line"))).alias("key"))
        one = one.unionByName(lines.join(short.filter("not several").select("key"), "key"))
        all_ = files.select("file_id", F.explode(_parts(F.substring_index("text", "\0", 1))).alias("key"))
        pairs = pairs.unionByName(all_.join(short.filter("several").select("key"), "key"))
    whole = pairs.distinct().join(files.select("file_id", "path", F.substring_index("text", "\0", 1).alias("text")), "file_id").filter(F.contains("text", "key"))
    several = whole.select("key", "file_id", "path", F.explode(_begins(F.col("text"), F.col("key"))).alias("line_no"))
    return one.unionByName(several).withColumnRenamed("key", "needle").distinct()


def _parts(line: Column) -> Column:
    """All texts of one and two characters of a line, each once; none of more than two bytes is asked for."""
    at = F.when(F.length(line) > 0, F.sequence(F.lit(1), F.length(line))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substr(line, i, F.lit(1)), F.substr(line, i, F.lit(2))))))


def _begins(text: Column, key: Column) -> Column:
    """The lines in which the places of a text begin, from the left, none within another."""
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(key, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    own = feeds(key)
    zero = F.struct(F.lit(1).cast("long").alias("line"), F.array().cast("array<bigint>").alias("out"))

    def add(state: Column, gap: Column) -> Column:
        begin = state["line"] + feeds(gap)
        return F.struct((begin + own).cast("long").alias("line"), F.concat(state["out"], F.array(begin.cast("long"))).alias("out"))

    return F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), zero, add)["out"]
