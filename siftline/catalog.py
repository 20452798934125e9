"""The engine's queries over the test tables, and the SQL that each must equal."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.config import EngineConfig
from siftline.functions import formats
from siftline.functions.trigrams import trigrams
from siftline.operators import batch, page, rank, sort
from siftline.operators import search as s
from siftline.operators.filters import FileFilter
from siftline.operators.find import NameIndex, find, find_page, git_scoped
from siftline.operators.index import Index, bitmap_ids, bitmaps, changes, changes_by_folder, tombstone
from siftline.operators.search import SearchOptions
from siftline.operators.segments import StoredIndex
from siftline.operators.status import Progress, status
from siftline.plans.query import for_pattern, of_literal
from siftline.plans.regex import Options, escape, join, to_java
from siftline.sources import frontier, splits
from siftline.sources.corpus import Corpus
from siftline.streaming.cursors import cursor_answers
from siftline.streaming.live import LiveStatus
from siftline.streaming.refresh import folder_listings, follow, matches_of_stream
from siftline.tools import Tools, handle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PATH = "concat(source, '/', cast(doc_id as varchar), '.', lang)"
#: Lines of documents, without the empty rest after a last line feed.
LINES = f"""l as (
  select doc_id, path, unnest(a) as line, generate_subscripts(a, 1) as line_no from (
    select doc_id, {PATH} as path, case when a[-1] = '' then a[:-2] else a end as a from (select *, string_split(text, chr(10)) as a from documents))
)"""
#: Byte trigrams of documents.
GRAMS = """b as (select doc_id, hex(encode(text)) as h from documents),
g as (select distinct doc_id, cast(('0x' || substr(h, 2 * i - 1, 6)) as bigint) as tri from (select doc_id, h, unnest(range(1, len(h) // 2 - 1)) as i from b))"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents as files: sources are folders, languages endings."""
    return Corpus.from_df(_table(spark, sf_dir, "documents"), "doc_id", "text", _path())


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("file_id").alias("doc_id"), "line_no", F.col("text").alias("line"), *more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match ``[Ll]icense``, found through the index."""
    return search_indexed(spark, sf_dir)


def _lines_where(condition: str) -> str:
    return f"with {LINES} select doc_id, line_no, line from l where {condition}"


@query(_lines_where("regexp_matches(line, '[Ll]icense')"))
def search_regex(spark, d):
    return _shown(s.search(documents(spark, d), "[Ll]icense", strategy="scan"))


@query(_lines_where("regexp_matches(line, '[Ll]icense')"))
def search_indexed(spark, d):
    corpus = documents(spark, d)
    return _shown(s.search(corpus, "[Ll]icense", index=Index.build(corpus), strategy="index"))


@query(_lines_where("regexp_matches(line, '[A-Za-z]+\\s+License,\\s+Version')"))
def search_prefilter(spark, d):
    return _shown(s.search(documents(spark, d), r"[A-Za-z]+\s+License,\s+Version", strategy="prefilter"))


@query(_lines_where("regexp_matches(line, '[a-zA-Z0-9_.]+@[a-zA-Z0-9_.]+')"))
def search_fallback(spark, d):
    """No trigram is required, so the index leaves every file in."""
    corpus = documents(spark, d)
    return _shown(s.search(corpus, "[a-zA-Z0-9_.]+@[a-zA-Z0-9_.]+", index=Index.build(corpus)))


@query(_lines_where("regexp_matches(line, '(?i)LICENSE')"))
def search_ignore_case(spark, d):
    return _shown(s.search(documents(spark, d), "LICENSE", SearchOptions(ignore_case=True)))


@query(_lines_where("contains(line, 'MIT License.')"))
def search_fixed(spark, d):
    return _shown(s.search(documents(spark, d), "MIT License.", SearchOptions(fixed=True)))


@query(_lines_where(r"regexp_matches(line, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')"))
def search_word(spark, d):
    return _shown(s.search(documents(spark, d), "the", SearchOptions(word=True)))


@query(_lines_where("regexp_matches(line, '(?:Apache)|(?:GNU [A-Z][a-z]+)|(?:MIT)')"))
def search_multi_pattern(spark, d):
    return _shown(s.search(documents(spark, d), ["Apache", "GNU [A-Z][a-z]+", "MIT"]))


@query(_lines_where("not regexp_matches(line, '[ea]')"))
def search_invert(spark, d):
    return _shown(s.search(documents(spark, d), "[ea]", SearchOptions(invert=True)))


@query(_lines_where("regexp_matches(line, '^The ') and regexp_matches(line, 'ing\\.$')"))
def search_anchored(spark, d):
    return _shown(s.search(documents(spark, d), r"^The .*ing\.$"))


@query(f"""with {LINES}, m as (select doc_id, line_no, regexp_extract_all(line, '[Tt]h[a-z]+ing') as a from l)
select doc_id, line_no, ordinal - 1 as ordinal, m as line from (select doc_id, line_no, unnest(a) as m, generate_subscripts(a, 1) as ordinal from m)""")
def search_only_matching(spark, d):
    rows = s.search(documents(spark, d), "[Tt]h[a-z]+ing", SearchOptions(only_matching=True))
    return rows.select(F.col("file_id").alias("doc_id"), "line_no", F.col("ordinal").cast("long").alias("ordinal"), F.col("text").alias("line"))


@query(r"""select doc_id, sum(n)::bigint as n from (select doc_id, len(regexp_extract_all(text, '[a-z]+\.\n[A-Z][a-z]+')) as n from documents) where n > 0 group by doc_id""")
def search_multiline(spark, d):
    rows = s.search(documents(spark, d), r"[a-z]+\.\n[A-Z][a-z]+", SearchOptions(multi_line=True, only_matching=True))
    return rows.groupBy(F.col("file_id").alias("doc_id")).agg(F.count("*").alias("n"))


@query(f"""with {LINES}, m as (select doc_id, line_no, line, regexp_matches(line, '[Ll]icense') as hit from l)
select doc_id, line_no, line from m where hit union select m.doc_id, m.line_no, m.line from m join m n on n.doc_id = m.doc_id and n.line_no = m.line_no - 1 where n.hit""")
def search_multiline_lines(spark, d):
    """Every line that a match across a line end touches."""
    return _shown(s.search(documents(spark, d), r"[^\n]*[Ll]icense[^\n]*(\n[^\n]+)?", SearchOptions(multi_line=True))).distinct()


@query("select doc_id from documents where regexp_matches(text, 'of.the.+and', 's')")
def search_dot_all(spark, d):
    rows = s.search(documents(spark, d), "of.the.+and", SearchOptions(multi_line=True, dot_all=True))
    return rows.select(F.col("file_id").alias("doc_id")).distinct()


@query(f"with {LINES} select distinct path from l where regexp_matches(line, 'license')")
def files_with_matches(spark, d):
    return s.files_with_matches(s.search(documents(spark, d), "license"))


@query(f"with {LINES} select path, count(*) as n from l where regexp_matches(line, '[Tt]he ') group by path")
def count_per_file(spark, d):
    return s.count_per_file(s.search(documents(spark, d), "[Tt]he "))


@query(f"with {LINES} select path, sum(len(regexp_extract_all(line, '[Tt]he ')))::bigint as n from l where regexp_matches(line, '[Tt]he ') group by path")
def count_occurrences(spark, d):
    return s.count_per_file(s.search(documents(spark, d), "[Tt]he ", SearchOptions(only_matching=True)))


@query(f"with {LINES} select count(*) as total_matches, count(distinct path) as total_files from l where regexp_matches(line, '[Ll]icense')")
def match_totals(spark, d):
    return s.totals(s.search(documents(spark, d), "[Ll]icense")).select("total_matches", "total_files")


def _context_sql(before: int, after: int, columns: str = "doc_id, line_no, line, hit as is_match") -> str:
    return f"""with {LINES}, m as (select *, regexp_matches(line, '[Ll]icense') as hit from l),
c as (select *, max(hit::int) over (partition by doc_id order by line_no rows between {after} preceding and {before} following) = 1 as shown from m),
k as (select *, coalesce(line_no - lag(line_no) over w > 1, false)::int as gap from c where shown window w as (partition by doc_id order by line_no)),
x as (select *, sum(gap) over (partition by doc_id order by line_no)::bigint as block from k)
select {columns} from x"""


def _context(spark, d, before, after):
    return s.search(documents(spark, d), "[Ll]icense", SearchOptions(before=before, after=after))


@query(_context_sql(0, 2))
def context_after(spark, d):
    return _shown(_context(spark, d, 0, 2), "is_match")


@query(_context_sql(2, 0))
def context_before(spark, d):
    return _shown(_context(spark, d, 2, 0), "is_match")


@query(_context_sql(1, 1))
def context_both(spark, d):
    return _shown(_context(spark, d, 1, 1), "is_match")


@query(_context_sql(1, 2, "doc_id, line_no, block"))
def context_blocks(spark, d):
    return _context(spark, d, 1, 2).select(F.col("file_id").alias("doc_id"), "line_no", "block")


@query(f"""with {LINES}, m as (select *, regexp_matches(line, '(?i)license') as hit from l),
c as (select *, max(hit::int) over (partition by doc_id order by line_no rows between 3 preceding and 3 following) = 1 as shown from m),
k as (select *, coalesce(line_no - lag(line_no) over w > 1, false)::int as gap from c where shown window w as (partition by doc_id order by line_no)),
x as (select *, sum(gap) over (partition by doc_id order by line_no) as block from k),
y as (select *, last_value(case when hit then line_no end ignore nulls) over (partition by doc_id, block order by line_no rows between unbounded preceding and current row) as b,
  first_value(case when hit then line_no end ignore nulls) over (partition by doc_id, block order by line_no rows between current row and unbounded following) as f from x)
select doc_id, line_no, case when b is null then f when f is null then b when line_no - b <= f - line_no then b else f end as owner from y""")
def context_nearest(spark, d):
    rows = s.search(documents(spark, d), "license", SearchOptions(ignore_case=True, before=3, after=3))
    return s.nearest_match(rows).select(F.col("file_id").alias("doc_id"), "line_no", "owner")


def _filtered(spark, d, **filter_):
    return s.count_per_file(s.search(documents(spark, d), "[Ll]icense", SearchOptions(filter=FileFilter(**filter_))))


def _filter_sql(condition: str) -> str:
    return f"with {LINES} select path, count(*) as n from l where regexp_matches(line, '[Ll]icense') and {condition} group by path"


@query(_filter_sql("regexp_matches(path, '\\.(de|fr)$')"))
def glob_filter(spark, d):
    return _filtered(spark, d, globs=("*.{de,fr}",))


@query(_filter_sql("not (path like '%.en' and not path like 'src3/%')"))
def glob_negate(spark, d):
    """The last glob that fits decides."""
    return _filtered(spark, d, globs=("**", "!*.en", "/src3/**"))


LANGUAGES = {"english": ["*.en"], "romance": ["*.fr", "*.es"]}


@query(_filter_sql("(path like '%.fr' or path like '%.es')"))
def type_filter(spark, d):
    return _filtered(spark, d, types=("romance",), known=LANGUAGES)


@query(_filter_sql("not path like '%.en'"))
def type_not(spark, d):
    return _filtered(spark, d, type_nots=("english",), known=LANGUAGES)


@query(_filter_sql("path like 'src1/%'"))
def path_scope(spark, d):
    return s.count_per_file(s.search(documents(spark, d), "[Ll]icense", SearchOptions(scope="src1")))


@query(f"with {LINES} select path, line_no from l where path = 'src7/7.en' and regexp_matches(line, 'the')")
def single_file(spark, d):
    return s.search(documents(spark, d), "the", SearchOptions(file="src7/7.en", filter=FileFilter(globs=("*.de",)))).select("path", "line_no")


@query(f"select {PATH} as path from documents where contains({PATH}, '/12')")
def find_name(spark, d):
    return find(documents(spark, d).files, "/12")


@query("select p_name as path from part where contains(p_name, 'ing') and p_name > (select p_name from (select distinct p_name from part where contains(p_name, 'ing') order by 1 limit 1 offset 1)) order by p_name limit 15")
def find_parts_page(spark, d):
    parts = _table(spark, d, "part").select(F.col("p_name").alias("path"), F.lit(True).alias("live"))
    key = [r["path"] for r in find(parts, "ing").distinct().orderBy("path").limit(2).collect()]
    return find_page(parts, "ing", 15, key[-1] if key else None).paths


@query(f"with {GRAMS} select tri::int as tri, doc_id from g")
def trigram_postings(spark, d):
    return Index.build(documents(spark, d)).postings.select("tri", F.col("file_id").alias("doc_id"))


@query(f"with {GRAMS} select tri::int as tri, count(*) as files from g group by tri")
def trigram_stats(spark, d):
    return Index.build(documents(spark, d)).postings.groupBy("tri").agg(F.count("*").alias("files"))


@query("with b as (select item_id, hex(encode(text)) as h from benchmark) select item_id, cast(('0x' || substr(h, 2 * i - 1, 6)) as int) as tri, i - 1 as pos from (select item_id, h, unnest(range(1, len(h) // 2 - 1)) as i from b)")
def trigram_function(spark, d):
    told = _table(spark, d, "benchmark").select("item_id", F.posexplode(trigrams(F.col("text"))).alias("pos", "tri"))
    return told.select("item_id", "tri", F.col("pos").cast("long").alias("pos"))


def _holds(*literals: str, sign: str = "and") -> str:
    each = [f"exists (select 1 from g where g.doc_id = d.doc_id and tri = {t})" for x in literals for t in dict.fromkeys(of_literal(x))]
    return f" {sign} ".join(each)


def _candidates(spark, d, pattern, **options):
    index = Index.build(documents(spark, d))
    return index.candidates(for_pattern(pattern, Options(**options))).select(F.col("file_id").alias("doc_id"))


@query(f"with {GRAMS} select doc_id from documents d where {_holds('license')}")
def candidates_and(spark, d):
    return _candidates(spark, d, "license")


@query(f"with {GRAMS} select doc_id from documents d where ({_holds('Apache')}) or ({_holds('GNU')}) or ({_holds('ther')})")
def candidates_or(spark, d):
    return _candidates(spark, d, "Apache|GNU|ther")


@query(f"with {GRAMS} select doc_id from documents d where ({_holds('under')}) and ({_holds('sion')})")
def candidates_prefix_suffix(spark, d):
    return _candidates(spark, d, "under.*sion")


@query(f"with {GRAMS} select doc_id from documents d where ({_holds('lice')})")
def candidates_inner(spark, d):
    return _candidates(spark, d, r"\w+lice\w+")


@query("select doc_id from documents")
def candidates_fallback(spark, d):
    return _candidates(spark, d, "ab|.")


@query(f"with {GRAMS}, {LINES} select (select count(*) from documents d where {_holds('icens')}) as candidates, (select count(distinct doc_id) from l where regexp_matches(line, 'icens')) as confirmed")
def candidate_precision(spark, d):
    corpus = documents(spark, d)
    found = Index.build(corpus).candidates(for_pattern("icens")).select("file_id", F.lit(1).alias("candidate"), F.lit(0).alias("hit"))
    true = s.search(corpus, "icens", strategy="scan").select("file_id", F.lit(0).alias("candidate"), F.lit(1).alias("hit")).distinct()
    return found.unionByName(true).agg(F.coalesce(F.sum("candidate"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("hit"), F.lit(0)).alias("confirmed"))


_SOUND = {"license": ("license", False), "either": ("(?i)LICEN[CS]E", False), "words": ("the|that", False), "tail": ("Apache.*[0-9]", False), "folded": ("ciónes", True), "class": ("[A-Z][a-z]+ing[.,]", False)}


@query(f"with {LINES} " + " union all ".join(f"select '{k}' as name, count(distinct doc_id) as files, 0::bigint as missed from l where regexp_matches(line, '{'(?i)' * fold + p}')" for k, (p, fold) in _SOUND.items()))
def soundness_violations(spark, d):
    """By pattern: files with a match, and those of them that the index left out."""
    corpus = documents(spark, d)
    index, out = Index.build(corpus), None
    for name, (p, fold) in _SOUND.items():
        true = s.search(corpus, p, SearchOptions(ignore_case=fold), strategy="scan").select("file_id").distinct()
        found = index.candidates(for_pattern(p, Options(ignore_case=fold))).select("file_id", F.lit(1).alias("found"))
        one = true.join(found, "file_id", "left").agg(F.count("*").alias("files"), F.count_if(F.col("found").isNull()).alias("missed")).select(F.lit(name).alias("name"), "files", "missed")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {GRAMS} select count(*) as n, 'and' as kind from documents d where {_holds('licen')} union all select count(*), 'or' from documents d where {_holds('licen', sign='or')}")
def bitmap_algebra(spark, d):
    maps = bitmaps(Index.build(documents(spark, d)).postings)
    each = [bitmap_ids(maps, of_literal("licen"), every).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n")).withColumn("kind", F.lit(kind)) for kind, every in (("and", True), ("or", False))]
    return each[0].unionByName(each[1])


@query(f"with {GRAMS} select (select count(*) from documents) as files, count(distinct tri) as trigrams, count(*) as postings, (select sum(octet_length(encode(text)))::bigint from documents) as bytes from g")
def index_status(spark, d):
    return status(Index.build(documents(spark, d))).select("files", "trigrams", "postings", "bytes")


def _matched(spark, d):
    return s.search(documents(spark, d), "[Ll]icense")


def _ranked(rows: DataFrame, spec: sort.SortSpec, **more) -> DataFrame:
    return page.numbered(sort.order_values(rows.select("path", "line_no", "ordinal", "is_match"), spec, **more), spec).select("path", "line_no", F.col("rank").cast("long").alias("rank"))


@query(f"with {LINES} select path, line_no, row_number() over (order by path, line_no) as rank from l where regexp_matches(line, '[Ll]icense')")
def sort_path(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec("path"))


@query(f"with {LINES} select path, line_no, row_number() over (order by path desc, line_no) as rank from l where regexp_matches(line, '[Ll]icense')")
def sort_path_desc(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec("path", reverse=True))


def _times(spark, d):
    stamp = _table(spark, d, "events").select(F.col("event_id").alias("doc_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("mtime_ns"))
    return _table(spark, d, "documents").join(stamp, "doc_id").select(_path().alias("path"), "mtime_ns")


@query(f"with {LINES} select path, line_no, row_number() over (order by coalesce(epoch_us(ts), 0), path, line_no) as rank from l left join events on event_id = doc_id where regexp_matches(line, '[Ll]icense')")
def sort_modified(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec("modified"), files=_times(spark, d))


_WEIGHTED = ("(Apache<a>|MIT<m>) License", "a:0.7,m:0.9")


@query(f"""with {LINES}, m as (select *, case when regexp_extract(line, '(Apache|MIT) License', 1) = 'MIT' then 900000 else 700000 end as v from l where regexp_matches(line, '(Apache|MIT) License')),
f as (select path, -max(v) as order_value from m group by path)
select m.path, line_no, order_value::bigint as order_value, row_number() over (order by order_value, m.path, line_no) as rank from m join f on f.path = m.path""")
def sort_weight(spark, d):
    ranking, spec = rank.parse(*_WEIGHTED), sort.SortSpec("weight")
    ordered = rank.weighted(s.search(documents(spark, d), ranking.plain), ranking)
    return page.numbered(ordered, spec).select("path", "line_no", "order_value", F.col("rank").cast("long").alias("rank"))


@query(f"with {LINES}, m as (select path, line_no from l where regexp_matches(line, '[Ll]icense')), c as (select path, count(*) as n from m group by path) select m.path, line_no, row_number() over (order by -n, m.path, line_no) as rank from m join c on c.path = m.path")
def sort_match_count(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec("match-count"))


@query(f"with {LINES} select path, line_no from l where regexp_matches(line, '[Ll]icense') order by path, line_no limit 10")
def page_first(spark, d):
    return page.matches_page(sort.order_values(_matched(spark, d), sort.SortSpec()), size=10).select("path", "line_no")


@query(f"with {LINES} select path, line_no from l where regexp_matches(line, '[Ll]icense') order by path, line_no limit 10 offset 10")
def page_next(spark, d):
    rows = sort.order_values(_matched(spark, d), sort.SortSpec())
    last = page.matches_page(rows, size=10).collect()
    key = {n: last[-1][n] for n in ("order_value", "path", "line_no", "ordinal")} if last else None
    return page.matches_page(rows, size=10, start_after=key).select("path", "line_no")


@query(f"with {LINES} select path, count(*) as n from l where regexp_matches(line, '[Ll]icense') group by path order by path desc limit 10")
def page_files(spark, d):
    spec = sort.SortSpec("path", reverse=True)
    return page.files_page(sort.order_values(_matched(spark, d), spec), spec, 10).select("path", "n")


@query(f"""with {LINES}, t as (select count(*) as m, count(distinct path) as f from l where regexp_matches(line, 'license'))
select case when m = 0 then '[no matches]' else concat('[matches 1-', least(50, m), ' of ', m, ' in ', f, ' file', case when f = 1 then '' else 's' end, ']') end as header from t""")
def page_header(spark, d):
    told = s.totals(s.search(documents(spark, d), "license"))
    meta = told.withColumns({"first_index": F.lit(1), "last_index": F.least(F.lit(50).cast("long"), F.col("total_matches"))})
    return page.headers(meta).select("header")


@query(f"""with {LINES}, m as (select path, line_no, line, length(line) as n, length(regexp_extract(line, '^(.*?)[Ll]icensed', 1)) as hit from l where regexp_matches(line, '[Ll]icensed')),
b as (select *, least(greatest(hit - 66, 0), n - 200) as st from m),
v as (select path, line_no, case when n <= 200 then line else concat(case when st > 0 then '…' else '' end, substr(line, (st + 1)::bigint, 200), case when st + 200 < n then '…' else '' end) end as line from b)
select path, string_agg(concat('  ', line_no, ': ', line), chr(10) order by line_no) as view from v group by path""")
def grouped_view(spark, d):
    return page.grouped(s.search(documents(spark, d), "[Ll]icensed")).select("path", F.array_join("lines", "\n").alias("view"))


@query(f"""with {LINES}, m as (select doc_id, line_no, line, length(line) as n, instr(line, 'ing') - 1 as hit from l where contains(line, 'ing')),
b as (select *, least(greatest(hit - 20, 0), n - 60) as st from m)
select doc_id, line_no, case when n <= 60 then line else concat(case when st > 0 then '…' else '' end, substr(line, (st + 1)::bigint, 60), case when st + 60 < n then '…' else '' end) end as line from b""")
def truncate_centered(spark, d):
    rows = s.search(documents(spark, d), "ing")
    return rows.select(F.col("file_id").alias("doc_id"), "line_no", page.truncated(F.col("text"), F.col("match_start"), 60).alias("line"))


@query(f"with {LINES} select concat(path, ':', line_no, ':', line) as rendered from l where regexp_matches(line, 'MIT')")
def render_lines(spark, d):
    return s.rendered(s.search(documents(spark, d), "MIT")).select("rendered")


def _listings(spark, d):
    """Two states of one folder: some files gone, some new, some of another size."""
    files = documents(spark, d).files.select("path", "size", "mtime_ns", "file_id")
    old = files.filter("file_id % 10 <> 3")
    new = files.filter("file_id % 10 <> 5").withColumn("size", F.col("size") + F.when(F.col("file_id") % 10 == 7, 1).otherwise(0))
    return old, new


@query(f"""select {PATH} as path, case doc_id % 10 when 3 then 'new' when 5 then 'removed' else 'changed' end as kind from documents where doc_id % 10 in (3, 5, 7)""")
def reconcile_diff(spark, d):
    return changes(*_listings(spark, d))


@query(f"""with {GRAMS.replace("hex(encode(text)) as h from documents", "hex(encode(case when doc_id % 10 = 7 then concat(text, ' edited') else text end)) as h from documents where doc_id % 10 <> 5")}
select tri::int as tri, count(*) as files, count(distinct doc_id) as ids from g group by tri""")
def apply_changes(spark, d):
    """The index of an old state, brought to a new one: equal to the index of the new."""
    docs = _table(spark, d, "documents")
    old = Corpus.from_df(docs.filter("doc_id % 10 <> 3"), "doc_id", "text", _path())
    edited = docs.filter("doc_id % 10 <> 5").withColumn("text", F.when(F.col("doc_id") % 10 == 7, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    new = Corpus.from_df(edited, "doc_id", "text", _path())
    index = Index.build(old)
    after = index.apply(index.reconcile(new.files), new)
    return after.postings.groupBy("tri").agg(F.count("*").alias("files"), F.count_distinct("file_id").alias("ids"))


@query(f"select {PATH} as path, doc_id % 4 <> 0 as live from documents")
def tombstones(spark, d):
    files = documents(spark, d).files
    return tombstone(files, files.filter("file_id % 4 = 0").select("path")).select("path", "live")


@query(f"with {GRAMS} select {PATH} as path from documents d where doc_id % 3 = 0 or ({_holds('Apache')})")
def delta_union(spark, d):
    """Candidates of an index that lacks a third of the files, and what a wider walk adds."""
    docs = _table(spark, d, "documents")
    index = Index.build(Corpus.from_df(docs.filter("doc_id % 3 <> 0"), "doc_id", "text", _path()))
    return index.with_delta(for_pattern("Apache"), docs.select(_path().alias("path")))


@query("with l as (select page_id, unnest(string_split(html, chr(10))) as line, generate_subscripts(string_split(html, chr(10)), 1) as line_no from pages) select page_id, line_no from l where regexp_matches(line, '<title>[A-Z]')")
def pages_search(spark, d):
    corpus = Corpus.from_df(_table(spark, d, "pages"), "page_id", "html", "url")
    return s.search(corpus, "<title>[A-Z]").select(F.col("file_id").alias("page_id"), "line_no")


@query("with l as (select concat(conv_id, '/', turn) as path, unnest(string_split(text, chr(10))) as line from conversations) select path, count(*) as n from l where regexp_matches(line, 'the ') group by path")
def conversations_search(spark, d):
    turns = _table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 10_000 + F.col("turn"))
    corpus = Corpus.from_df(turns, "id", "text", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    return s.count_per_file(s.search(corpus, "the "))


@query(f"with {LINES} select 'apache' as label, path, line_no from l where contains(line, 'Apache') union all select 'mit', path, line_no from l where contains(line, 'MIT')")
def batch_search(spark, d):
    return batch.batch_search(documents(spark, d), {"apache": "Apache", "mit": "MIT"}).select("label", "path", "line_no")


@query(f"with {LINES} select path, min(line_no) as first_line, max(line_no) as last_line, count(*) as n from l where contains(line, 'that') group by path")
def line_span(spark, d):
    return s.line_spans(s.search(documents(spark, d), "that"))


@query(f"with {LINES} select doc_id, line_no from l where exists (select 1 from benchmark b where contains(l.line, b.text) and not contains(b.text, chr(10)))")
def benchmark_needles(spark, d):
    """Every benchmark text of one line as a fixed text, all in one pass."""
    items = _table(spark, d, "benchmark").select(F.col("text").alias("needle"))
    return batch.needle_search(documents(spark, d), items.filter(~F.contains("needle", F.lit("\n")))).select(F.col("file_id").alias("doc_id"), "line_no").distinct()


@query("""with f as (select doc_id, item_id, d.text as t, b.text as k from documents d, benchmark b where contains(d.text, b.text)),
p as (select doc_id, item_id, k, unnest(string_split(t, k)) as gap, generate_subscripts(string_split(t, k), 1) as i, len(string_split(t, k)) as n from f),
s as (select doc_id, item_id, i, n, 1 + sum(length(gap) - length(replace(gap, chr(10), ''))) over (partition by doc_id, item_id order by i) + (i - 1) * (length(k) - length(replace(k, chr(10), ''))) as line_no from p)
select distinct doc_id, item_id, line_no::bigint as line_no from s where i < n""")
def benchmark_passages(spark, d):
    """Where each benchmark text begins in a document, texts of several lines too, all in one pass."""
    items = _table(spark, d, "benchmark")
    found = batch.needle_search(documents(spark, d), items.select(F.col("text").alias("needle")))
    return found.join(items, F.col("needle") == F.col("text")).select(F.col("file_id").alias("doc_id"), "item_id", "line_no").distinct()


@query("""select doc_id, case when n_chars < 1000 then cast(n_chars as varchar) else concat((n_chars + 50) // 1000, '.', (n_chars + 50) // 100 % 10, 'k') end as count_short,
case when b < 1023.95 then concat(b, ' B') else printf('%.1f KB', b / 1024.0) end as bytes_short,
case when n_chars < 60 then concat(n_chars, 's') when n_chars < 3600 then concat(n_chars // 60, 'm', n_chars % 60, 's') when n_chars < 86400 then concat(n_chars // 3600, 'h', n_chars % 3600 // 60, 'm') else concat(n_chars // 86400, 'd', n_chars % 86400 // 3600, 'h') end as duration
from (select doc_id, n_chars, octet_length(encode(text)) as b from documents)""")
def human_formats(spark, d):
    n = F.col("n_chars")
    return _table(spark, d, "documents").select(
        "doc_id", formats.human_count(n).alias("count_short"), formats.human_bytes(F.octet_length("text").cast("long")).alias("bytes_short"), formats.human_duration(n).alias("duration"),
    )


@query("select page_id, regexp_matches(url, 'a\\.com/en/.*[?]page=2') as hit from pages")
def escaped_pattern(spark, d):
    java = to_java(escape("a.com/en/") + ".*" + escape("?page=2"))
    return _table(spark, d, "pages").select("page_id", F.col("url").rlike(java).alias("hit"))


@query(f"""with {LINES}, m as (select path, line_no, row_number() over (order by path, line_no) as rank from l where regexp_matches(line, '[Ll]icense'))
select count(*) as pages, (select count(*) from m)::bigint as rows from (select distinct (rank - 1) // 25 from m)""")
def page_walk(spark, d):
    """All pages of a kept result hold each match once."""
    kept = page.Snapshot.write(sort.order_values(_matched(spark, d), sort.SortSpec()), _place(spark), size=25)
    return kept.pages().select("page", "path", "line_no", "ordinal").distinct().agg(F.count_distinct("page").alias("pages"), F.count("*").alias("rows"))


@query(f"with {LINES} select path, line_no, line from l where regexp_matches(line, '[Ll]icense') order by path, line_no limit 25 offset 50")
def page_of_snapshot(spark, d):
    """The third page of a kept result; no search runs for it."""
    kept = page.Snapshot.write(sort.order_values(_matched(spark, d), sort.SortSpec()), _place(spark), size=25)
    return kept.page(3).select("path", "line_no", F.col("text").alias("line"))


# an index of another state of the corpus ------------------------------------

#: Documents of the state that an index was built of, and how those of the present state differ from it.
_OLD, _NOW = "doc_id % 10 <> 3", "doc_id % 10 <> 5"
_EDITED = "case when doc_id % 10 = 7 then concat(text, chr(10), 'a new License') else text end"
_NOW_LINES = LINES.replace("from documents)", f"from (select * exclude (text), {_EDITED} as text from documents where {_NOW}))")


def _states(spark, d):
    docs = _table(spark, d, "documents")
    old = Corpus.from_df(docs.filter(_OLD), "doc_id", "text", _path())
    # the present state numbers its files in another way
    edited = docs.filter(_NOW).withColumn("text", F.when(F.col("doc_id") % 10 == 7, F.concat("text", F.lit("\na new License"))).otherwise(F.col("text"))).withColumn("number", F.col("doc_id") * 7 + 3)
    return old, Corpus.from_df(edited, "number", "text", _path())


_AFTER = f"with {_NOW_LINES} select path, line_no, line from l where regexp_matches(line, '[Ll]icense')"


def _after(rows):
    return rows.select("path", "line_no", F.col("text").alias("line"))


@query(_AFTER)
def search_stale(spark, d):
    """Files that are new, changed or gone since the index was built."""
    old, now = _states(spark, d)
    return _after(s.search(now, "[Ll]icense", index=Index.build(old), strategy="index"))


@query(_AFTER)
def search_after_apply(spark, d):
    old, now = _states(spark, d)
    index = Index.build(old)
    after = index.apply(index.reconcile(now.files), now)
    return _after(s.search(now, "[Ll]icense", index=Index(after.files, after.postings), strategy="index"))


@query(f"with {LINES} select path, line_no, line from l where regexp_matches(line, '[Ll]icense') and doc_id % 10 <> 3")
def search_after_revival(spark, d):
    """The index of the first state, brought to the second and back: removed files live again."""
    old, now = _states(spark, d)
    index = Index.build(old)
    there = index.apply(index.reconcile(now.files), now)
    back = there.apply(there.reconcile(old.files), old)
    return _after(s.search(old, "[Ll]icense", index=Index(back.files, back.postings), strategy="index"))


@query(f"select {PATH} as path, doc_id % 10 in (3, 7) as changed from documents where {_NOW}")
def freshness_flags(spark, d):
    old, now = _states(spark, d)
    return Index.build(old).freshness(now.files.select("path"), now).select("path", "changed")


def _place(spark) -> str:
    """A new place for tables: in the checkpoint folder, on whatever file system, or a temporary folder where none is set, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/catalog-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="catalog-")


def _scratch(spark) -> str:
    """A new folder for plain files that driver and workers see: in the checkpoint folder, or a temporary one where none is set, as in tests.

    Folders are read through the mounted file system, so a checkpoint folder elsewhere can't hold them.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        return tempfile.mkdtemp(prefix="catalog-")
    local = shared.removeprefix("file://")
    if not local.startswith("/"):
        raise ValueError(f"rows over folders need a mounted checkpoint folder, not {shared}")
    return tempfile.mkdtemp(prefix="catalog-", dir=local)


@query(_lines_where("regexp_matches(line, '[Ll]icense')"))
def search_saved(spark, d):
    """Through an index that was saved and loaded."""
    place, corpus = _place(spark) + "/index", documents(spark, d)
    StoredIndex.build(corpus, place)
    return _shown(s.search(corpus, "[Ll]icense", index=StoredIndex.open(spark, place), strategy="index"))


@query(f"with {GRAMS} select {PATH} as path from documents d where {PATH} like '%.de' and ({_holds('schlich')})")
def candidates_kept(spark, d):
    """Candidates among the paths that a filter keeps."""
    index = Index.build(documents(spark, d))
    return index.candidates(for_pattern("schlich"), F.col("path").endswith(".de")).select("path")


# folders ---------------------------------------------------------------------

#: Benchmark items as files of a folder; some are hidden, some ignored, some in UTF-16, some binary.
_FILE = "concat(case when item_id % 5 = 0 then 'keep/' else '' end, case when item_id % 7 = 0 then '.' else '' end, 'item', item_id, case when item_id % 3 = 0 then '.skip' else '.txt' end)"
_ITEMS = f"i as (select *, {_FILE} as path from benchmark), seen as (select * from i where item_id % 7 <> 0 and item_id % 3 <> 0)"


def _folder(spark, d, change=lambda r, raw: raw) -> str:
    """The items of ``benchmark`` (a small table) as a folder's files."""
    root = _scratch(spark)
    for r in _table(spark, d, "benchmark").withColumn("path", F.expr(_FILE)).toLocalIterator():
        os.makedirs(os.path.dirname(f"{root}/{r['path']}"), exist_ok=True)
        with open(f"{root}/{r['path']}", "wb") as f:
            f.write(change(r, r["text"].encode()))
    with open(f"{root}/.ignore", "w") as f:
        f.write("# leave these out\n*.skip\n")
    return root


@query(f"with {_ITEMS} select path, octet_length(encode(text)) as size from seen")
def walk_folder(spark, d):
    """Ignored and hidden files are left out; sizes are those on disk."""
    return Corpus.from_path(spark, _folder(spark, d)).files.select("path", "size")


@query(f"with {_ITEMS} select path, octet_length(encode(text)) as size, text from seen")
def walk_rounds(spark, d):
    """The same by rounds of tasks that give folders back after a few entries, and the texts read from that listing."""
    root = _folder(spark, d)
    found = frontier.listing(spark, root, first=2, each=1)
    return frontier.read(found, root).select("path", "size", "text")


@query(f"with {_ITEMS} select path from i where item_id % 3 <> 0")
def walk_hidden(spark, d):
    return Corpus.from_path(spark, _folder(spark, d), hidden=True).files.filter("path <> '.ignore'").select("path")


@query(f"with {_ITEMS} select path from i where item_id % 7 <> 0")
def walk_no_ignore(spark, d):
    return Corpus.from_path(spark, _folder(spark, d), no_ignore=True).files.select("path")


_FOLDER_LINES = _ITEMS + ", l as (select path, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from seen)"


@query(f"with {_FOLDER_LINES} select path, line_no, line from l where regexp_matches(line, '[a-z]+ing')")
def folder_search(spark, d):
    corpus = Corpus.from_path(spark, _folder(spark, d))
    return _after(s.search(corpus, "[a-z]+ing", index=Index.build(corpus), strategy="index"))


@query(f"with {_FOLDER_LINES} select path, line_no, line from l where regexp_matches(line, 'the') and path like 'keep/%' and path not like '%5.txt'")
def folder_globs(spark, d):
    """Globs are relative to the folder."""
    filter_ = FileFilter(globs=("keep/*", "!/keep/*5.txt"))
    return _after(s.search(Corpus.from_path(spark, _folder(spark, d)), "the", SearchOptions(filter=filter_)))


@query(f"with {_ITEMS} select path, text from seen")
def folder_decode(spark, d):
    """Some files in UTF-16 of either order, some with a byte order mark."""
    marks = {0: lambda t: b"\xef\xbb\xbf" + t.encode(), 1: lambda t: b"\xff\xfe" + t.encode("utf-16-le"), 2: lambda t: b"\xfe\xff" + t.encode("utf-16-be")}
    root = _folder(spark, d, lambda r, raw: marks.get(r["item_id"] % 4, str.encode)(r["text"]))
    return Corpus.from_path(spark, root).files.select("path", "text")


@query(f"with {_FOLDER_LINES} select path, line_no, line from l where contains(line, 'the') and not regexp_matches(path, '[02468][.]txt$')")
def folder_binary(spark, d):
    """Files that begin with a NUL have no lines; of others the text ends there."""
    root = _folder(spark, d, lambda r, raw: b"\0" + raw if r["item_id"] % 2 == 0 else raw + b"\n" * 1100 + b"\0the end")
    corpus = Corpus.from_path(spark, root)
    return s.search(corpus, "the", index=Index.build(corpus)).select("path", "line_no", F.col("text").alias("line"))


@query("""with l as (select doc_id % 3 as k, line, row_number() over (partition by doc_id % 3 order by doc_id, n) as line_no from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)),
m as (select *, contains(line, 'icense') as hit from l), c as (select *, max(hit::int) over (partition by k order by line_no rows between 1 preceding and 2 following) = 1 as shown from m)
select concat('f', k) as path, line_no, line, hit as is_match from c where shown""")
def huge_files(spark, d):
    """Documents one after another as three large files, read in ranges of 50 kB, found lines with their context across the ranges' borders."""
    root = _scratch(spark)
    texts = _table(spark, d, "documents").filter("doc_id is not null").select(F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("path"), F.col("doc_id").alias("at"), "text")
    lines = splits.lines(splits.write_files(texts, root), root, 50_000)
    found = lines.filter(F.contains("line", F.lit("icense")))
    shown = splits.with_context(found, lines, before=2, after=1)
    return shown.select("path", "line_no", "line", "is_match")


# surfaces ------------------------------------------------------------------------


def _cli(spark, *args: str) -> DataFrame:
    """Lines that a command writes."""
    from siftline.cli import main

    out = io.StringIO()
    main([*args], spark, out)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


@query(f"with {_FOLDER_LINES} select concat(path, ':', line_no, ':', line) as line from l where regexp_matches(line, '(?i)that')")
def cli_search(spark, d):
    root = _folder(spark, d)
    return _cli(spark, "-i", "that", root).select(F.replace("line", F.lit(root + "/"), F.lit("")).alias("line"))


@query(f"with {_ITEMS} select path as line from seen where contains(path, '1')")
def cli_find(spark, d):
    root = _folder(spark, d)
    return _cli(spark, "--find", "1", root).select(F.replace("line", F.lit(root + "/"), F.lit("")).alias("line"))


@query(f"with {_FOLDER_LINES}, c as (select path, count(*) as n from l where contains(line, 'the') group by path) select concat(path, ': ', n) as line from c union all select concat('[count 1-', count(*), ' of ', count(*), ' file', case when count(*) = 1 then '' else 's' end, ' · ', sum(n), ' match', case when sum(n) = 1 then '' else 'es' end, ']') from c")
def cli_count(spark, d):
    return _cli(spark, "--compact", "-c", "--page-size", "100000", "the", _folder(spark, d))


@query(f"with {_FOLDER_LINES} select path, line_no, line from l where contains(line, 'the')")
def cli_cursors(spark, d):
    """Pages one after another, each by the cursor that the page before gave."""
    from siftline.cli import main

    rows, args = [], ["--compact", "--page-size", "7", "the", _folder(spark, d)]
    while args:
        out = io.StringIO()
        main(args, spark, out)
        args, path = [], None
        for line in out.getvalue().splitlines():
            if line.startswith("[more: cursor "):
                args = ["--cursor", line[14:-1]]
            elif line.startswith("  "):
                number, _, text = line.strip(" ").partition(": ")
                rows.append((path, int(number), text))
            elif not line.startswith("["):
                path = line
    shown = spark.createDataFrame(rows, "path string, line_no long, shown string")
    # long lines are shown in part
    whole = _after(s.search(Corpus.from_path(spark, _folder(spark, d)), "the"))
    part = F.regexp_replace("shown", "^…|…$", "")
    return shown.join(whole, ["path", "line_no"]).filter(F.contains("line", part)).select("path", "line_no", "line")


@query(f"""with {LINES}, c as (select path, count(*) as n from l where regexp_matches(line, '[Ll]icense') group by path), f as (select count(*) as f, sum(n) as m from c)
select concat(path, ': ', n) as line from (select * from c order by path limit 20) union all select concat('[count 1-', least(20, f), ' of ', f, ' file', case when f = 1 then '' else 's' end, ' · ', m, ' match', case when m = 1 then '' else 'es' end, ']') from f""")
def tool_content_search(spark, d):
    text = Tools(documents(spark, d)).content_search("[Ll]icense", count=True, page_size=20, sort_by="path")
    return spark.createDataFrame([(x,) for x in text.splitlines() if not x.startswith("[more")], "line string")


@query(f"select {PATH} as line from documents where contains({PATH}, '/1') order by 1 limit 30")
def tool_file_search(spark, d):
    text = Tools(documents(spark, d)).file_search("/1", limit=30)
    return spark.createDataFrame([(x,) for x in text.splitlines() if not x.startswith("[")], "line string")


@query(f"with {GRAMS} select (select count(*) from documents) as files, count(distinct tri) as trigrams from g")
def tool_status(spark, d):
    """What the status tool answers to a request, read back from its short numbers."""
    corpus = documents(spark, d)
    index = Index.build(corpus)
    reply = handle(Tools(corpus, index), {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "status", "arguments": {}}})
    told = dict(x.split(maxsplit=1) for x in reply["result"]["content"][0]["text"].splitlines())
    exact = index.stats().select("files", "trigrams")
    row = exact.select(formats.human_count(F.col("files")).alias("f"), formats.human_count(F.col("trigrams")).alias("t")).first()
    return exact.filter(F.lit((told["files"], told["trigrams"]) == (row["f"], row["t"])))


@query(f"""with {LINES}, m as (select row_number() over (order by path, line_no) as k, count(*) over () as n from l where regexp_matches(line, '[Ll]icense'))
select distinct (k - 1) // 30 + 1 as page, ((k - 1) // 30) * 30 + 1 as first_index, least(n, ((k - 1) // 30 + 1) * 30) as last_index, n > ((k - 1) // 30 + 1) * 30 as has_more from m""")
def page_bounds(spark, d):
    kept = page.Snapshot.write(sort.order_values(_matched(spark, d), sort.SortSpec("path")), _place(spark), sort.SortSpec("path"), 30)
    return kept.bounds()


@query(_lines_where("regexp_matches(line, '^[A-Z][a-z]+ing')"))
def udtf_search_lines(spark, d):
    from siftline.functions import udtf

    udtf.register(spark)
    found = spark.sql("select doc_id, inline(found) from (select doc_id, matching_lines(text, '^[A-Z][a-z]+ing') as found from {docs})", docs=_table(spark, d, "documents"))
    return found.select("doc_id", "line_no", "line")


def _streamed(stream: DataFrame, spark) -> DataFrame:
    """What a stream gives until it has nothing more."""
    place = _place(spark)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(f"{place}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


@query(_lines_where("regexp_matches(line, '[Ll]icensed')"))
def stream_search(spark, d):
    """Documents that arrive as a stream of files."""
    docs = _table(spark, d, "documents")
    arriving = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*").parquet(_as_folder(spark, docs, _several(docs)))
    return _streamed(matches_of_stream(arriving, "[Ll]icensed", "doc_id", "text"), spark).select(F.col("file_id").alias("doc_id"), "line_no", "line")


def _as_folder(spark, df: DataFrame, files: int = 3) -> str:
    place = _place(spark) + "/in"
    df.repartition(files).write.parquet(place)
    return place


def _several(df: DataFrame) -> int:
    """Three files of a table, or as many as it is read in parts, so that no file and no task grows with it."""
    return max(3, df.rdd.getNumPartitions())


@query(_AFTER)
def stream_refresh(spark, d):
    """A stored index that followed the corpus from an earlier state, by one refresh for each batch of listings."""
    old, now = _states(spark, d)
    place = _place(spark)
    StoredIndex.build(old, f"{place}/index")
    listing = now.files.select("path", "size", "mtime_ns")
    batches = spark.readStream.schema(listing.schema).option("maxFilesPerTrigger", 2).parquet(_as_folder(spark, listing))
    run = follow(batches, f"{place}/index", lambda _: now, f"{place}/checkpoint")
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return _after(s.search(now, "[Ll]icense", index=StoredIndex.open(spark, f"{place}/index"), strategy="index"))


# further orders ---------------------------------------------------------------------


def _rank_sql(key: str, condition: str = "regexp_matches(line, '[Ll]icense')", more: str = "") -> str:
    return f"with {LINES} select path, line_no, row_number() over (order by {key}, path, line_no) as rank from l {more} where {condition}"


@query(_rank_sql("0"))
def sort_none(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec())


@query(_rank_sql("coalesce(epoch_us(ts), 0)", more="left join events on event_id = doc_id"))
def sort_accessed(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec("accessed"), files=_times(spark, d).withColumnRenamed("mtime_ns", "atime_ns"))


@query(_rank_sql("coalesce(epoch_us(ts), 0) desc, path desc", more="left join events on event_id = doc_id").replace("path desc, path, line_no", "path desc, line_no"))
def sort_created_desc(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec("created", reverse=True), files=_times(spark, d).withColumnRenamed("mtime_ns", "ctime_ns"))


@query(_rank_sql("case when path like 'src3/%' then 0 else 1 end"))
def sort_in_folder(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec("in-folder:src3"))


@query(_rank_sql("case when path like 'src1/%' then 0 else 2 end"))
def sort_folder_distance(spark, d):
    return _ranked(_matched(spark, d), sort.SortSpec("folder-distance:src1"))


_KIND = "case when doc_id % 3 = 0 then 'vendor/' when doc_id % 3 = 1 then 'tests/' else '' end || " + PATH


@query(_rank_sql("path").replace("row_number() over (order by path, path, line_no)", "row_number() over (order by case when path like 'vendor/%' then 2 when path like 'tests/%' then 1 else 0 end, path, line_no)").replace(PATH, _KIND))
def sort_path_kind(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "vendor/").when(F.col("doc_id") % 3 == 1, "tests/").otherwise("")
    corpus = Corpus.from_df(_table(spark, d, "documents"), "doc_id", "text", F.concat(kind, _path()))
    return _ranked(s.search(corpus, "[Ll]icense"), sort.SortSpec("path-kind"))


def _weighted(spark, d, patterns: list[str], spec: str):
    ranking = rank.parse(join(patterns), spec)
    rows = s.search(documents(spark, d), ranking.plain)
    ordered = sort.order_values(rows, sort.SortSpec("weight"), scores=rank.file_scores(rows, ranking))
    return page.numbered(ordered, sort.SortSpec("weight")).select("path", "line_no", "order_value", F.col("rank").cast("long").alias("rank"))


def _weight_sql(value: str, condition: str) -> str:
    return f"""with {LINES}, m as (select path, line_no, {value} as v from l where {condition}), f as (select path, -max(v) as order_value from m group by path)
select m.path, line_no, order_value::bigint as order_value, row_number() over (order by order_value, m.path, line_no) as rank from m join f on f.path = m.path"""


@query(_weight_sql("case when regexp_extract(line, '(Apache|MIT|under the)', 1) = 'MIT' then 900000 when regexp_extract(line, '(Apache|MIT|under the)', 1) = 'Apache' then 400000 else 0 end", "regexp_matches(line, 'Apache|MIT|under the')"))
def sort_weight_multi(spark, d):
    """Labels in several patterns."""
    return _weighted(spark, d, ["Apache<a>", "MIT<m>", "under the"], "a:0.4,m:0.9")


_REST = r"regexp_extract(line, '\bLicense\b.*')"


@query(_weight_sql(f"case when regexp_matches({_REST}, '^License *$') then 700000 when starts_with({_REST}, 'License, Version') then 300000 else 0 end", r"regexp_matches(line, '\bLicense\b')"))
def sort_weight_empty_branch(spark, d):
    """A labelled branch may take part in a match without text."""
    return _weighted(spark, d, [r"\bLicense\b( *$<end>|, Version<v>|)"], "end:0.7,v:0.3")


@query(f"with {LINES} select concat('in/', path, ':', line) as rendered from l where regexp_matches(line, 'MIT')")
def render_prefix(spark, d):
    """Below a folder as it was typed, without line numbers."""
    return s.rendered(s.search(documents(spark, d), "MIT"), line_numbers=False, prefix="in/").select("rendered")


@query("""with w as (select doc_id, quality from labels), r as (select *, row_number() over (order by -quality, doc_id) as a, row_number() over (order by doc_id) as b, doc_id % 11 as q from w),
p as (select 'good first' as ranking, q, doc_id, row_number() over (partition by q order by -quality, doc_id) as k from r union all select 'by id', q, doc_id, row_number() over (partition by q order by doc_id) from r),
t as (select q, max(doc_id) as doc_id from r group by q)
select ranking, count(*) as queries, round(avg(case when k = 1 then 1.0 else 0.0 end), 9) as precision_at_1, round(avg(1.0 / k), 9) as mrr from p join t using (q, doc_id) group by ranking""")
def relevance_eval(spark, d):
    """Two orders of labelled documents, eleven queries, each wanting its last document."""
    labels = _table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "quality", (F.col("doc_id") % 11).cast("string").alias("query"))
    by = lambda name, *keys: labels.select(F.lit(name).alias("ranking"), "query", "path", F.row_number().over(Window.partitionBy("query").orderBy(*keys)).alias("rank"))
    ranked = by("good first", F.desc("quality"), "doc_id").unionByName(by("by id", "doc_id"))
    touched = labels.groupBy("query").agg(F.max("doc_id").cast("string").alias("path"))
    told = rank.relevance(ranked, touched)
    return told.select("ranking", "queries", F.round("precision_at_1", 9).alias("precision_at_1"), F.round("mrr", 9).alias("mrr"))

# a stored index and what follows it --------------------------------------------------


_SWAPPED = LINES.replace("from documents)", "from (select * exclude (text), case when doc_id % 6 = 1 then replace(text, 'icense', 'ICENSE') else text end as text from documents))")


@query(f"with {_SWAPPED} select 'stale' as state, path, line_no from l where regexp_matches(line, 'icense') union all select 'applied', path, line_no from l where regexp_matches(line, 'icense')")
def search_same_size_edit(spark, d):
    """Edits that keep a row's size are seen by a stale index and by one brought up to date."""
    docs = _table(spark, d, "documents")
    old = Corpus.from_df(docs, "doc_id", "text", _path())
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 6 == 1, F.replace("text", F.lit("icense"), F.lit("ICENSE"))).otherwise(F.col("text")))
    now = Corpus.from_df(edited, "doc_id", "text", _path())
    index = StoredIndex.build(old, _place(spark) + "/index")
    after = index.apply(index.reconcile(now.files), now)
    told = [s.search(now, "icense", index=i, strategy="index").select(F.lit(state).alias("state"), "path", "line_no") for state, i in (("stale", index), ("applied", after))]
    return told[0].unionByName(told[1])


@query(f"""with {GRAMS.replace("hex(encode(text)) as h from documents", "hex(encode(case when doc_id % 16 < 4 then concat(text, ' edit ', doc_id % 16) else text end)) as h from documents where doc_id % 16 <> 9")}
select tri::int as tri, count(*) as files from g group by tri""")
def stored_batches(spark, d):
    """Batches of changes, each a small segment, with the merges that fall due: equal to an index built anew."""
    docs, place = _table(spark, d, "documents"), _place(spark) + "/index"
    index = StoredIndex.build(Corpus.from_df(docs, "doc_id", "text", _path()), place)
    for k in range(4):
        text = F.when(F.col("doc_id") % 16 <= k, F.concat("text", F.lit(" edit "), (F.col("doc_id") % 16).cast("string"))).otherwise(F.col("text"))
        now = docs.withColumn("text", text)
        now = now.filter("doc_id % 16 <> 9") if k == 3 else now
        corpus = Corpus.from_df(now, "doc_id", "text", _path())
        index = index.apply(index.reconcile(corpus.files), corpus).merged()
    return StoredIndex.open(spark, place).postings.groupBy("tri").agg(F.count("*").alias("files"))


@query(f"""with {GRAMS} select 'and' as kind, doc_id from documents d where {_holds('license')} union all select 'or', doc_id from documents d where ({_holds('Apache')}) or ({_holds('GNU')}) or ({_holds('ther')})
union all select 'both', doc_id from documents d where ({_holds('under')}) and ({_holds('sion')})""")
def candidates_stored(spark, d):
    """Conditions over stored containers."""
    corpus = documents(spark, d)
    index, out = StoredIndex.build(corpus, _place(spark) + "/index"), None
    ids = corpus.files.select("path", F.col("file_id").alias("doc_id"))
    for kind, pattern in (("and", "license"), ("or", "Apache|GNU|ther"), ("both", "under.*sion")):
        one = index.candidates(for_pattern(pattern)).join(ids, "path").select(F.lit(kind).alias("kind"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {GRAMS}, n as (select count(*) as n from documents), c as (select tri, count(*) as files from g group by tri) select tri::int as tri, files from c, n where files * 1000 >= n")
def common_trigrams(spark, d):
    """The counts by which a stored index weighs a condition."""
    index = StoredIndex.build(documents(spark, d), _place(spark) + "/index")
    return spark.createDataFrame(sorted(index.common.items()), "tri int, files long")


@query(f"select {PATH} as path from documents where contains({PATH}, '1/12') or (contains({PATH}, '7.e') and doc_id % 5 <> 0)")
def find_name_indexed(spark, d):
    """Names through a trigram index of the paths, and through it after some files went."""
    files = documents(spark, d).files
    index = NameIndex.build(files, _place(spark) + "/names")
    gone = files.filter("file_id % 5 = 0").select("path", F.lit("removed").alias("kind"))
    return index.find("1/12").unionByName(index.apply(gone, files.filter("file_id % 5 <> 0")).find("7.e")).distinct()


@query(f"""select {PATH} as path, case doc_id % 10 when 3 then 'new' when 5 then 'removed' else 'changed' end as kind from documents where doc_id % 10 in (3, 5, 7) and source <> 'src1'""")
def reconcile_folders(spark, d):
    """Only folders whose digests differ are compared file by file."""
    old, new = _listings(spark, d)
    same = F.startswith(F.col("path"), F.lit("src1/"))
    return changes_by_folder(old.filter(~same).unionByName(new.filter(same)), new)


@query(f"with {_FOLDER_LINES} select concat(path, ':', line_no, ':', line) as line from l where regexp_matches(line, '(?i)that')")
def cli_search_indexed(spark, d):
    """The command line through a kept index."""
    root = _folder(spark, d)
    return _cli(spark, "--index", _place(spark), "-i", "that", root).select(F.replace("line", F.lit(root + "/"), F.lit("")).alias("line"))


@query(_lines_where("regexp_matches(line, 'GNU|Apache')"))
def search_kept_index(spark, d):
    """Settings keep an index whose build took long enough; it is opened again."""
    corpus = Corpus(documents(spark, d).files, root="documents")
    settings = EngineConfig(cache_dir=_place(spark), persist_threshold_ms=0)
    settings.open_index(corpus)
    index = settings.open_index(corpus)
    return _shown(s.search(corpus, "GNU|Apache", index=index, strategy="index").filter(F.lit(isinstance(index, StoredIndex))))


@query(f"""with {LINES}, m as (select path, line_no from l where regexp_matches(line, '[Ll]icense')), {_NOW_LINES.replace("l as (", "w as (", 1)}, n as (select path, line_no from w where regexp_matches(line, '[Ll]icense')),
x as ((select * from m except select * from n) union all (select * from n except select * from m)), g as (select distinct lang from documents)
select lang, lang in (select regexp_extract(path, '[a-z]+$') from x) as changed from g""")
def fingerprints(spark, d):
    """By language: whether a result's fingerprint in one state of the corpus differs from that in another."""
    out = None
    for lang in [r["lang"] for r in _table(spark, d, "documents").select("lang").distinct().collect()]:  # a handful
        each = [s.totals(s.search(c, "[Ll]icense", SearchOptions(filter=FileFilter(globs=(f"*.{lang}",))))).select(F.col("fingerprint").alias(n)) for c, n in ((documents(spark, d), "was"), (_states(spark, d)[1], "is"))]
        one = each[0].join(each[1]).select(F.lit(lang).alias("lang"), (F.col("was") != F.col("is")).alias("changed"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("select item_id, case when regexp_full_match(text, '[A-Za-z0-9_@%+=:,./-]+') then text else concat(chr(39), replace(text, chr(39), concat(chr(39), chr(92), chr(39), chr(39))), chr(39)) end as word from benchmark")
def shell_words(spark, d):
    return _table(spark, d, "benchmark").select("item_id", formats.shell_quote(F.col("text")).alias("word"))


@query(f"with {LINES} select path, line_no from l where regexp_matches(line, '[Ll]icense') and doc_id in (select doc_id from labels)")
def search_listed_paths(spark, d):
    """A search among listed paths only: those of labelled documents."""
    corpus = documents(spark, d)
    listed = _table(spark, d, "labels").join(corpus.files.select(F.col("file_id").alias("doc_id"), "path"), "doc_id").select("path")
    return s.search(Corpus(git_scoped(corpus.files, listed)), "[Ll]icense").select("path", "line_no")


@query("select count(*) as done, count(*) as total from documents")
def build_progress(spark, d):
    """What a build's progress tells when it is through."""
    progress = Progress(documents(spark, d).files)
    Index.build(Corpus(progress.counted())).postings.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([progress.told()], "done long, total long")


@query(f"""with {LINES}, c as (select (select count(*) from l where regexp_matches(line, '[Ll]icense')) as was), {_NOW_LINES.replace("l as (", "w as (", 1)}, n as (select (select count(*) from w where regexp_matches(line, '[Ll]icense')) as now)
select concat('[note: results changed since the last page: ', was, ' then, ', now, ' now]') as note from c, n""")
def staleness_note(spark, d):
    """What a cursor of one state of the corpus is told in another; the store gives it out once."""
    was, now = (s.totals(s.search(c, "[Ll]icense")).first() for c in (documents(spark, d), _states(spark, d)[1]))
    store = page.CursorStore()
    token = store.put(page.Cursor("matches", ["[Ll]icense"], prev_total=was["total_matches"], fingerprint=was["fingerprint"]))
    return spark.createDataFrame([(page.staleness(store.take(token), now["total_matches"], now["fingerprint"]),)], "note string")


# streams -----------------------------------------------------------------------------


@query("""with e as (select user_id, ts, event_type, event_id, lag(event_type) over w as before, lag(ts) over w as since, lag(event_id) over w as cursor from events where event_type in ('view', 'click') window w as (partition by user_id order by ts)),
t as (select *, coalesce(before = 'view' and ts < since + interval 6 hour, false) as found from e where event_type = 'click' and ts <= (select max(ts) - interval 1 day from events where event_type in ('view', 'click')))
select cast(user_id as varchar) as token, epoch_us(ts) as at_us, found, case when found then cast(cursor as varchar) end as cursor from t""")
def stream_cursors(spark, d):
    """Cursors that views put and clicks take, in event time; the stream's files come in no order."""
    e, view = _table(spark, d, "events").filter("event_type in ('view', 'click')"), F.col("event_type") == "view"
    requests = e.select(F.col("user_id").cast("string").alias("token"), F.col("ts").cast("timestamp").alias("at"), view.alias("put"), F.when(view, F.col("event_id").cast("string")).alias("cursor"))
    arriving = spark.readStream.schema(requests.schema).parquet(_as_folder(spark, requests, _several(requests)))
    told = _streamed(cursor_answers(arriving, ttl_seconds=6 * 3600, delay="1 day"), spark)
    return told.select("token", F.unix_micros("at").alias("at_us"), "found", "cursor")


@query("select 'finished' as state, count(*) as rows from documents")
def stream_status(spark, d):
    """What a listener has written of a stream that has ended."""
    docs, place = _table(spark, d, "documents"), _place(spark)
    files = _several(docs)
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(_as_folder(spark, docs, files))
    with LiveStatus(spark, f"{place}/status") as live:
        _streamed(matches_of_stream(arriving, "[Ll]icensed", "doc_id", "text"), spark)
        live.settled()
    return live.now().select("state", "rows")


@query(f"with {_FOLDER_LINES} select path, line_no, line from l where contains(line, 'the') union all select 'late.txt', 1, 'the last'")
def stream_listing(spark, d):
    """A folder's own stream of listings keeps an index up to date: it catches up with what came before it, then with a file that comes later."""
    root, place = _folder(spark, d), _place(spark)
    run = follow(folder_listings(spark, root), f"{place}/index", lambda sp: Corpus.from_path(sp, root), f"{place}/checkpoint")
    try:
        run.processAllAvailable()
        with open(f"{root}/late.txt", "w") as f:
            f.write("the last\n")
        run.processAllAvailable()
    finally:
        run.stop()
    return _after(s.search(Corpus.from_path(spark, root), "the", index=StoredIndex.open(spark, f"{place}/index"), strategy="index"))
