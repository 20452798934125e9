"""Removal of repeated multi-line chunks, with DataFrame functions only.

A text's lines are hashed; a rolling hash over ``WINDOW`` line hashes stands at
every line, and a chunk ends where that rolling hash is a strict local minimum.
The choice looks at four lines only, so lines put in or taken out above a
repeated passage don't shift its chunk borders, and a chunk that ends so has two
lines at least. Chunks meet under a 128-bit hash in one aggregate that is
combined before its shuffle; the smallest and the largest of their bodies show
whether all are equal byte for byte. Of a repeated chunk the occurrence in the
smallest doc_id stays, there the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, join_split

#: Lines under the rolling hash, and its multiplier.
WINDOW, FACTOR = 2, 31
_P = "__line_dedup_"


def _line_hash(line: Column) -> Column:
    """48 bits of the line's MD5, as a long that FACTOR can multiply."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 12), 16, 10).cast("long")


def _with_chunks(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the chunks of its text: body, two hashes, whether it has two visible lines, whether it repeats an earlier one."""
    lines, hashes, rolling, ends = (F.col(_P + x) for x in ("lines", "hashes", "rolling", "ends"))
    far = F.lit(1 << 60)
    df = df.withColumn(_P + "lines", F.split(F.col(text), "\n"))
    df = df.withColumn(_P + "hashes", F.transform(lines, _line_hash))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))
    df = df.withColumn(_P + "rolling", F.zip_with(hashes, before, lambda h, p: h + p * FACTOR))
    n = F.size(rolling)
    low = F.concat(F.array(F.lit(-1).cast("long")), F.slice(rolling, 1, F.greatest(n - 1, F.lit(0))))
    high = F.concat(F.slice(rolling, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(far))
    sides = F.zip_with(low, high, lambda a, b: F.least(a, b))
    minimum = F.zip_with(rolling, sides, lambda r, s: r < s)
    at = F.transform(minimum, lambda m, i: F.when(m, i + 1))
    df = df.withColumn(_P + "ends", F.array_distinct(F.concat(F.filter(at, lambda i: i.isNotNull()), F.array(n))))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    cuts = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))

    def chunk(part: Column, i: Column) -> Column:
        body = F.array_join(part, "\n")
        seen = F.size(F.filter(part, lambda x: F.length(F.trim(x)) > 0)) >= 2
        return F.struct(body.alias("body"), i.alias("i"), seen.alias("multi"))

    df = df.withColumn(_P + "sorted", F.array_sort(F.transform(cuts, chunk)))
    by_body = F.col(_P + "sorted")
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(by_body, 1, F.size(by_body) - 1), lambda c: c["body"]))
    told = F.zip_with(
        by_body, shifted,
        lambda c, p: F.struct(c["i"].alias("i"), c["body"].alias("body"), F.xxhash64(c["body"]).alias("a"), F.xxhash64(F.lit(1), c["body"]).alias("b"), c["multi"].alias("multi"), (c["multi"] & c["body"].eqNullSafe(p)).alias("again")),
    )
    return df.withColumn(_P + "chunks", told).drop(*(_P + x for x in ("lines", "hashes", "rolling", "ends", "sorted")))


def repeated_chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, first, n): hashes of multi-line chunks that occur twice or more, the smallest doc_id that has each, and how often it stands.

    Null and empty texts have no such chunk; a chunk that only rows without doc_id hold is none.
    """
    chunks = _with_chunks(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    rows = chunks.select("doc_id", F.explode(F.filter(F.col(_P + "chunks"), lambda c: c["multi"])).alias("c")).select("doc_id", "c.a", "c.b", "c.body")
    met = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("body").alias("low"), F.max("body").alias("high"))
    return met.filter("n > 1 and low = high and first is not null").select("a", "b", "first", "n")


def _with_lost(df: DataFrame, lost: DataFrame, doc_id: str) -> DataFrame:
    """``df`` with what its doc_id has lost (null for nothing); texts of one doc_id are dealt out if they are many, rows without one meet nobody."""
    known = df.filter(F.col(doc_id).isNotNull())
    times = known.groupBy(F.col(doc_id).alias(_P + "id")).agg(F.count("*").alias(_P + "times"))
    right = lost.withColumnRenamed("doc_id", _P + "id").join(times, _P + "id").withColumnRenamed(_P + "id", doc_id)
    told = join_split(known, right, [doc_id], _P + "times", df.count(), how="left").drop(_P + "times")
    return told.unionByName(df.filter(F.col(doc_id).isNull()).withColumn(_P + "lost", F.lit(None).cast(lost.schema[_P + "lost"].dataType)))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``df`` with all but one occurrence of every repeated multi-line chunk taken out of ``text``.

    Rows, their number and all other columns stay; ``removed`` names a column for
    the number of lines taken out. A text without repeats stays byte for byte.
    Null texts stay null, empty ones empty; a text whose every chunk stands
    elsewhere becomes empty. Rows that share a doc_id are one document: none
    loses a chunk to the other. A row without doc_id keeps what stands in others
    and loses only its own later repeats.
    """
    repeats = cut(repeated_chunks(df, doc_id, text))
    plain = _with_chunks(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    own = F.array_distinct(F.transform(F.filter(F.col(_P + "chunks"), lambda c: c["multi"]), lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"))))
    held = plain.filter("doc_id is not null").select("doc_id", F.explode(own).alias("h")).select("doc_id", "h.a", "h.b")
    total = repeats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lost = join_split(held, repeats, ["a", "b"], "n", total).filter("doc_id <> first").groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias(_P + "lost"))
    columns = df.columns
    whole = _with_chunks(_with_lost(df, lost, doc_id), text)
    in_order = F.array_sort(F.col(_P + "chunks"))

    def stays(c: Column) -> Column:
        gone = F.coalesce(F.array_contains(F.col(_P + "lost"), F.struct(c["a"].alias("a"), c["b"].alias("b"))), F.lit(False))
        return ~(c["again"] | (c["multi"] & gone))

    whole = whole.withColumn(_P + "kept", F.filter(in_order, stays))
    new = F.array_join(F.transform(F.col(_P + "kept"), lambda c: c["body"]), "\n")
    out = whole.withColumn(_P + "new", new)
    count = lambda t, empty: F.when(t.isNull() | empty, F.lit(0)).otherwise(F.size(F.split(t, "\n")))
    lines_out = (count(F.col(text), F.lit(False)) - count(F.col(_P + "new"), F.size(_P + "kept") == 0)).cast("long")
    result = [F.col(c) if c != text else F.col(_P + "new").alias(text) for c in columns]
    return out.select(*result, *([lines_out.alias(removed)] if removed else []))


def _with_pairs(df: DataFrame, text: str) -> DataFrame:
    """``df`` with its text's lines and, for each two neighbouring visible lines, place of the first and SHA-256 of both."""
    lines = F.col(_P + "lines")
    df = df.withColumn(_P + "lines", F.split(F.col(text), "\n"))
    following = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    seen = lambda x: F.length(F.trim(x)) > 0
    both = F.zip_with(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), following, lambda a, b: F.when(seen(a) & seen(b), F.unhex(F.sha2(F.concat_ws("\n", a, b).cast("binary"), 256))))
    told = F.transform(both, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return df.withColumn(_P + "pairs", F.filter(told, lambda c: c["h"].isNotNull()))


def dedup_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the lines of every repeat of two neighbouring visible lines, wherever chunk borders lie.

    Pairs overlap, so a repeated passage of two lines or more goes whole. Equal pairs
    have equal SHA-256. A pair stays in the smallest doc_id that has it, there where it
    stands first; every line taken out still stands somewhere. Rows without doc_id and
    those that share one are treated as ``dedup_lines`` treats them.
    """
    plain = _with_pairs(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    own = F.array_distinct(F.transform(F.col(_P + "pairs"), lambda c: c["h"]))
    rows = cut(plain.select("doc_id", F.explode(own).alias("h")))
    repeats = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1 and first is not null")
    repeats = cut(repeats)
    total = repeats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lost = join_split(rows.filter("doc_id is not null"), repeats, ["h"], "n", total).filter("doc_id <> first").groupBy("doc_id").agg(F.collect_set("h").alias(_P + "lost"))
    columns = df.columns
    whole = _with_pairs(_with_lost(df, lost, doc_id), text)
    pairs = F.col(_P + "pairs")
    # by hash, then by place: each pair's first place in its text comes before the others
    firsts = F.array_sort(pairs)
    before = F.concat(F.array(F.lit(None).cast(whole.schema[_P + "pairs"].dataType.elementType)), F.slice(firsts, F.lit(1), F.greatest(F.size(firsts) - 1, F.lit(0))))
    whole = whole.withColumn(_P + "again", F.transform(F.filter(F.zip_with(firsts, before, lambda c, b: F.struct(c.alias("c"), c["h"].eqNullSafe(b["h"]).alias("again"), b["i"].alias("b"))), lambda x: x["again"] & (x["c"]["i"] > x["b"] + 1)), lambda x: x["c"]["i"]))
    taken = F.transform(F.filter(pairs, lambda c: F.coalesce(F.array_contains(F.col(_P + "lost"), c["h"]), F.lit(False))), lambda c: c["i"])
    whole = whole.withColumn(_P + "out", F.array_union(F.col(_P + "again"), taken))
    kept = F.filter(F.col(_P + "lines"), lambda x, i: ~(F.array_contains(F.col(_P + "out"), i) | F.array_contains(F.col(_P + "out"), i - 1)))
    new = F.when(F.size(_P + "out") > 0, F.array_join(kept, "\n")).otherwise(F.col(text))
    return whole.select(*(F.col(c) if c != text else new.alias(text) for c in columns))


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for doc_id, text and n_removed of ``dedup_lines`` over a table."""
    return f"""
with l as (
  select doc_id, generate_subscripts(a, 1) as i, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from {source})
), h as (
  select *, ('0x' || substr(md5(line), 1, 12))::bigint as h from l
), r as (
  select *, h + {FACTOR} * coalesce(lag(h) over (partition by doc_id order by i), 0) as r from h
), e as (
  select *, coalesce(r < lag(r) over w and r < coalesce(lead(r) over w, {1 << 60}), false) as ends from r window w as (partition by doc_id order by i)
), c as (
  select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk from e
), b as (
  select doc_id, chunk, string_agg(line, chr(10) order by i) as body, count(*) as n, count(*) filter (length(trim(line)) > 0) as seen from c group by doc_id, chunk
), k as (
  select *, seen >= 2 and count(*) over (partition by body) > 1 and not (doc_id = min(doc_id) over (partition by body) and chunk = min(chunk) over (partition by body, doc_id)) as gone from b
)
select doc_id, coalesce(string_agg(body, chr(10) order by chunk) filter (not gone), '') as text, coalesce(sum(n) filter (gone), 0)::bigint as n_removed
from k group by doc_id
"""
