"""Search, index, filters, ranking, pages: laws and small cases."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siftline import catalog
from siftline.functions.trigrams import postings as extract
from siftline.operators import batch, page, rank, segments, sort
from siftline.operators.filters import FileFilter
from siftline.operators.find import find_page
from siftline.operators.index import Index, changes
from siftline.operators.search import SearchOptions, nearest_match, plan, rendered, search, totals
from siftline.plans.query import for_pattern
from siftline.plans.regex import PatternError
from siftline.sources.corpus import Corpus, decode
from siftline.tools import Tools, handle

NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in "part events documents pages benchmark conversations labels".split():
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, oracle, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = oracle.execute(catalog.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def _corpus(spark, *files):
    rows = [(i, path, text) for i, (path, text) in enumerate(files)]
    return Corpus.from_df(spark.createDataFrame(rows, "id long, path string, text string"), "id", "text", "path")


def _told(rows, *columns):
    return [tuple(r) for r in rows.orderBy("path", "line_no", "ordinal").select(*columns).collect()]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "line_no", "line"]


def test_lines_with_and_without_a_match(spark):
    c = _corpus(spark, ("day.log", "dawn\nnoon bell rings\ndusk"), ("night.log", "tick tock tick"))
    assert _told(rendered(search(c, "bell")), "rendered") == [("day.log:2:noon bell rings",)]
    assert _told(search(c, "bell", SearchOptions(invert=True)), "path", "line_no") == [("day.log", 1), ("day.log", 3), ("night.log", 1)]
    assert _told(search(c, "tick", SearchOptions(only_matching=True)), "text", "ordinal", "match_start") == [("tick", 0, 1), ("tick", 1, 11)]


def test_strange_texts(spark):
    c = _corpus(spark, ("none", None), ("empty", ""), ("binary", "\0foo"), ("late", "x" * 2000 + "foo\n\0foo"), ("last", "foo\n"), ("blank", "\n\nfoo"))
    for strategy in ("scan", "prefilter", "index"):
        rows = search(c, "foo", index=Index.build(c), strategy=strategy)
        assert _told(rows, "path", "line_no") == [("blank", 3), ("last", 1), ("late", 1)]
    assert Index.build(c).candidates(for_pattern(".")).count() == 6


def test_strategies_agree_and_invert_is_the_rest(spark, sf):
    c = catalog.documents(spark, sf)
    index = Index.build(c)
    for pattern in ("license", r"[\w.]+\s+license", "the|that", "(?i)THE", r"\d{4}"):
        told = {_s: totals(search(c, pattern, index=index, strategy=_s)).first() for _s in ("scan", "prefilter", "index")}
        assert told["scan"] == told["prefilter"] == told["index"]
        both = told["scan"]["total_matches"] + search(c, pattern, SearchOptions(invert=True)).count()
        assert both == c.lines().count()


def test_multi_line(spark):
    c = _corpus(spark, ("a", "one\ntwo three\nfour\ntwo three\nfive"))
    rows = search(c, r"three\nf", SearchOptions(multi_line=True))
    assert _told(rows, "line_no", "text") == [(2, "two three"), (3, "four"), (4, "two three"), (5, "five")]
    rows = search(c, r"^t\w+ (three)$", SearchOptions(multi_line=True, only_matching=True))
    assert _told(rows, "line_no", "text", "match_start") == [(2, "two three", 1), (4, "two three", 1)]
    assert _told(search(c, r"three\nf", SearchOptions(multi_line=True, invert=True)), "line_no") == [(1,)]
    with pytest.raises(PatternError):
        plan("x*", SearchOptions(multi_line=True))


def test_nearest_match_prefers_the_earlier(spark):
    c = _corpus(spark, ("a", "hit\nx\nhit\ny\nz\nhit"))
    rows = nearest_match(search(c, "hit", SearchOptions(before=1, after=1)))
    assert [tuple(r) for r in rows.orderBy("line_no").select("line_no", "owner").collect()] == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 6), (6, 6)]


def test_errors_are_raised_early(spark):
    for bad in (lambda: plan("("), lambda: plan("a", SearchOptions(filter=FileFilter(types=("nope",)))), lambda: plan("a", SearchOptions(before=-1)), lambda: plan([])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    ("filter_", "kept"),
    [
        (FileFilter(globs=("*.rs",)), {"src/a.rs", "b.rs"}), (FileFilter(globs=("!*.rs",)), {"c.py", "src/d.txt"}), (FileFilter(globs=("src/*",)), {"src/a.rs", "src/d.txt"}),
        (FileFilter(types=("rust", "py")), {"src/a.rs", "b.rs", "c.py"}), (FileFilter(type_nots=("rust",)), {"c.py", "src/d.txt"}), (FileFilter(), {"src/a.rs", "b.rs", "c.py", "src/d.txt"}),
        (FileFilter(globs=("*.rs", "!/b.rs")), {"src/a.rs"}), (FileFilter(globs=("[a-b].r?",)), {"src/a.rs", "b.rs"}),
    ],
)
def test_filters(spark, filter_, kept):
    paths = spark.createDataFrame([(p,) for p in ("src/a.rs", "b.rs", "c.py", "src/d.txt")], "path string")
    assert {r[0] for r in paths.filter(filter_.condition(F.col("path"))).collect()} == kept


def _grown(r: random.Random, depth: int = 0):
    """A random pattern: parts in a row, each a text or choices between labelled branches, some of them without text."""
    out = []
    for _ in range(r.randrange(1, 4)):
        if depth < 2 and r.random() < 0.5:
            inner = [_grown(r, depth + 1) if r.random() < 0.85 else [] for _ in range(r.randrange(1, 4))]
            # a label stands behind text of its branch, not behind a bracket
            out.append([(x, r.choice([None, "u", "v", "w"]) if x and isinstance(x[-1], str) else None) for x in inner])
        else:
            out.append("".join(r.choice("abc") for _ in range(r.randrange(1, 3))))
    return out


def _spelled(parts, labels: bool) -> str:
    branch = lambda b: _spelled(b[0], labels) + (f"<{b[1]}>" if labels and b[1] else "")
    return "".join(p if isinstance(p, str) else "(" + "|".join(map(branch, p)) + ")" for p in parts)


def _readings(parts) -> list[tuple[str, frozenset]]:
    """Every text that a pattern fits, the preferred ones first, with the labels of the branches it takes."""
    out = [("", frozenset())]
    for p in parts:
        own = [(p, frozenset())] if isinstance(p, str) else [(t, of | {label} if label else of) for inner, label in p for t, of in _readings(inner)]
        out = [(x + y, f | g) for x, f in out for y, g in own]
    return out


def _plain_score(parts, weights: dict, line: str) -> float:
    readings = _readings(parts)
    for at in range(len(line) + 1):
        for text, labels in readings:
            if line.startswith(text, at):
                return max([0.0, *(weights[x] for x in labels if x in weights)])
    return 0.0


def test_scores_equal_a_plain_reading_of_grown_patterns(spark):
    r = random.Random(8)
    seen = 0
    for _ in range(25):
        parts = _grown(r)
        if len(_readings(parts)) > 400:
            continue
        weights = {x: r.choice([-1.0, 0.25, 2.0, 7.5]) for x in r.sample("uvw", r.randrange(1, 4))}
        spec = ",".join(f"{k}:{v}" for k, v in weights.items())
        # a mark that isn't declared is plain text, so only declared ones are written
        marked = re.sub(r"<(\w)>", lambda m: m[0] if m[1] in weights else "", _spelled(parts, True))
        ranking = rank.parse(marked, spec)
        assert ranking.plain == _spelled(parts, False)
        lines = ["".join(r.choice("abc") for _ in range(r.randrange(0, 9))) for _ in range(30)] + [t for t, _ in _readings(parts)[:20]]
        rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", rank.score(F.col("t"), ranking).alias("s")).collect()
        want = [_plain_score(parts, weights, x["t"]) for x in rows]
        assert [x["s"] for x in rows] == want, (marked, spec)
        seen += sum(x > 0 for x in want)
    assert seen > 50


def test_marks_that_are_text(spark):
    """Undeclared marks, and declared ones in classes, belong to the pattern."""
    for pattern, spec, plain, scores in (
        ("([<w>]+|keel<w>)", "w:6", "([<w>]+|keel)", {"keel": 6.0, "<w>": 0.0}), ("oar<unknown>|mast<w>", "w:1", "oar<unknown>|mast", {"oar<unknown>": 0.0, "mast": 1.0, "oar": 0.0}),
        (r"(\()(a<v>|b)[()]", "v:1", r"(\()(a|b)[()]", {"(a)": 1.0, "(b(": 0.0}), ("^$|(buoy<b>)?x", "b:7", "^$|(buoy)?x", {"": 0.0, "buoyx": 7.0, "x": 0.0}),
    ):
        ranking = rank.parse(pattern, spec)
        rows = spark.createDataFrame([(t,) for t in scores], "t string").select("t", rank.score(F.col("t"), ranking).alias("s")).collect()
        assert ranking.plain == plain and {r["t"]: r["s"] for r in rows} == scores


def test_weights_are_read_as_their_grammar_says():
    """Random lists of terms: those of labels and finite numbers alone are taken."""
    r = random.Random(4)
    number, taken = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0
    for _ in range(20_000):
        spec = "".join(r.choice(["a", "b1", "_", ":", ":", ",", ".5", "2", "-", "nan", "1e9", "inf", " ", "é"]) for _ in range(r.randrange(0, 9)))
        terms = [t.strip() for t in spec.split(",") if t.strip()]
        fine = bool(terms) and all(re.fullmatch(rf"[A-Za-z_]\w*:\s*{number}", t, re.ASCII) for t in terms)
        try:
            got = rank.parse_weights(spec)
        except ValueError:
            got = None
        assert (got is not None) == fine, spec
        if fine:
            taken += 1
            assert got == {t.partition(":")[0]: float(t.partition(":")[2]) for t in terms}
    assert taken > 50
    for pattern in ("<w>oar", "(<w>oar)", "oar|<w>"):  # a label needs a branch
        with pytest.raises(ValueError):
            rank.parse(pattern, "w:2")
    with pytest.raises(ValueError):
        rank.parse("oar<w>", "w:2", fixed=True)


def test_pages_hold_everything_once_in_order(spark):
    c = _corpus(spark, ("isle/bay/cove", "x\nx"), ("isle/bay-2", "x\n\nx"), ("isle/bays", "x"))
    for spec in (sort.SortSpec(), sort.SortSpec("path", reverse=True), sort.SortSpec("match-count")):
        rows = search(c, "x")
        got, key, shown = [], None, 0
        while True:
            p = page.paged(rows, spec, size=2, start_after=key, shown=shown)
            part = [(r["path"], r["line_no"]) for r in p.rows.collect()]
            got += part
            key, shown = p.last_key, p.last_index
            if not p.has_more:
                break
        assert len(got) == len(set(got)) == 5 and got[0][0] == ("isle/bays" if spec.reverse else "isle/bay-2")
    assert [r[0] for r in search(c, "x").select("path").distinct().orderBy("path").collect()] == ["isle/bay-2", "isle/bay/cove", "isle/bays"]
    assert page.paged(search(c, "nothing")).header == "[no matches]"
    assert page.paged(search(c, "x"), mode="count").header == "[count 1-3 of 3 files · 5 matches]"
    assert page.paged(search(c, "x"), mode="files", size=2).header == "[files 1-2 of 3]"


def test_fingerprint_follows_the_matches(spark):
    a, b = _corpus(spark, ("a", "x\ny\nx")), _corpus(spark, ("a", "x\nx\nx"))
    prints = [totals(search(c, "x")).first()["fingerprint"] for c in (a, a, b)]
    assert prints[0] == prints[1] != prints[2]


@pytest.mark.parametrize(("line", "want"), [("ß" * 90 + "pearl" + "-" * 90, "…" + "ß" * 10 + "pearl" + "-" * 15 + "…"), ("pearl" + "." * 90, "pearl" + "." * 25 + "…"), ("." * 90 + "pearl", "…" + "." * 25 + "pearl"), ("a pearl", "a pearl")])
def test_truncation(spark, line, want):
    row = _corpus(spark, ("a", line))
    assert search(row, "pearl").select(page.truncated(F.col("text"), F.col("match_start"), 30).alias("t")).first()["t"] == want


def test_context_belongs_to_its_page(spark):
    c = _corpus(spark, ("a", "o\no\nfind\no\nfind\no\no\no\no\nfind"))
    rows = search(c, "find", SearchOptions(before=1, after=2))
    for k, lines in enumerate(([2, 3, 4], [5, 6, 7], [9, 10])):
        key = {"order_value": 0, "path": "a", "line_no": (0, 3, 5)[k], "ordinal": 0}
        part = page.matches_page(sort.order_values(rows, sort.SortSpec()), size=1, start_after=key)
        assert sorted(r["line_no"] for r in page.with_context_of(part, rows).collect()) == lines


def test_cursor():
    now = [0.0]
    store = page.CursorStore(clock=lambda: now[0])
    cursor = page.Cursor("matches", ["a"], {"word": True}, 7, "path", True, None, {"path": "x"}, 3, 9, -5)
    assert page.Cursor.decode(cursor.encode()) == cursor
    token = store.put(cursor)
    assert store.take(token) == cursor
    with pytest.raises(KeyError):
        store.take(token)
    token = store.put(cursor)
    now[0] = 121
    with pytest.raises(KeyError):
        store.take(token)
    for bad in ("", "x", "e30="):
        with pytest.raises(ValueError):
            page.Cursor.decode(bad)
    assert page.staleness(cursor, 9, -5) is None and "9 then, 10 now" in page.staleness(cursor, 10, -5)


def test_batch_search_equals_searches_one_after_another(spark, sf):
    c = catalog.documents(spark, sf)
    index = Index.build(c)
    queries = {"lic": "[Ll]icense", "mit": "MIT", "the": r"\bthe$", "none": "zqzq", "dot": "^.{0,3}$", "both": "GNU|Apache", "mail": r"[\w.]+@[\w.]+", "again": "MIT"}
    for options, given in ((SearchOptions(), index), (SearchOptions(), None), (SearchOptions(ignore_case=True), None), (SearchOptions(fixed=True), index), (SearchOptions(word=True, filter=FileFilter(globs=("*.en",))), None), (SearchOptions(after=1), None)):
        got = batch.batch_search(c, queries, options, given)
        want = [(label, *r) for label, p in queries.items() for r in search(c, p, options, strategy="scan").collect()]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError):
        batch.batch_search(c, {})


def test_needles_of_a_table(spark):
    files = [("a", "one two\nthree\n\ntwo threefour\nno"), ("b", None), ("c", ""), ("d", "\0two"), ("e", "x" * 2000 + "two\n\0two"), ("f", "ααβ\nα.*\\Eβ\n" * 3), ("g", "aXa\naXaXa")]
    needles = ["two", "e\n\nt", "two\nthree", "no", "α", "α.*\\Eβ", "β\nα", "\n", "a\n", None, "", "two", "zzz", "aXa", "o\nt", "\\E", "ee\n\ntwo th"]
    c = _corpus(spark, *files)
    want = set()
    for path, text in files:
        body = (text or "").partition("\0")[0]
        if text and "\0" in text[:1024]:
            continue
        for n in {n for n in needles if n}:
            if "\n" not in n:
                lines = body.split("\n")
                want |= {(n, path, i) for i, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1) if n in line}
            else:
                at = body.find(n)
                while at >= 0:
                    want.add((n, path, body.count("\n", 0, at) + 1))
                    at = body.find(n, at + len(n))
    df = spark.createDataFrame([(n,) for n in needles], "n string")
    for index in (None, Index.build(c)):
        assert {(r["needle"], r["path"], r["line_no"]) for r in batch.needle_search(c, df, "n", index).collect()} == want
    assert batch.needle_search(c, df.limit(0), "n").count() == 0
    many = spark.range(3000).select(F.concat(F.lit("t"), "id", F.lit(" three")).alias("n")).unionByName(df)
    assert batch.needle_search(c, many, "n").count() == len(want)


def _found(index, pattern):
    return {r["path"] for r in index.candidates(for_pattern(pattern)).collect()}


def _states(r: random.Random, n: int):
    """States of a folder, one after another: some files go, some come, some are edited, some in their old size."""
    words = ["ivy", "moss", "fern", "reed"]
    state = {f"f{i}": " ".join(r.choice(words) for _ in range(3)) for i in range(12)}
    while True:
        yield dict(state)
        for name in r.sample(sorted(state), min(2, len(state))):
            del state[name]
        state |= {f"f{r.randrange(n)}": "x" * r.randrange(9) + r.choice([" ivy", " fern moss fern"]) for _ in range(3)}
        for name in r.sample(sorted(state), 2):  # the size stays
            state[name] = state[name].replace("moss", "MOSS").replace("ivy", "yvi")


def test_stored_index_follows_many_states(spark, tmp_path, monkeypatch):
    """A log of segments and tombstones, merged when that is due, finds what a scan finds, as does every older version."""
    monkeypatch.setattr(segments, "SMALLEST", 3)
    monkeypatch.setattr(segments, "FAN", 3)
    place, r, index, merges = str(tmp_path / "log"), random.Random(3), None, 0
    for k, state in enumerate(_states(r, 40)):
        corpus = _corpus(spark, *sorted(state.items(), key=lambda _: r.random()))
        if index is None:
            index = segments.StoredIndex.build(corpus, place)
        else:
            diff = index.reconcile(corpus.files)
            changed = diff.filter("kind <> 'removed'").count()
            older, index = index, index.apply(diff, corpus)
            if changed:
                assert index.log["segments"][-1]["files"] == changed  # what is written grows with the changes
            assert index.reconcile(corpus.files).count() == 0
            while index.due():
                index, merges = index.merged(keep=100), merges + 1
            assert {x["path"] for x in older.files.filter("live").select("path").collect()} == before
        before = set(state)
        again = segments.StoredIndex.open(spark, place)
        assert again.log == index.log and index.live_files == len(state) == again.files.filter("live").count()
        if k % 10 == 9:
            fresh = Index.build(corpus)
            for pattern in ("moss fern", "yvi|MOSS"):
                for most in (segments.READ_BYTES, 0):  # few postings on the driver, many bucket by bucket
                    monkeypatch.setattr(segments, "READ_BYTES", most)
                    assert _found(again, pattern) == _found(fresh, pattern)
                told = [{tuple(x) for x in search(corpus, pattern, index=again, strategy=s).select("path", "line_no").collect()} for s in ("scan", "index")]
                assert told[0] == told[1]
            tri = lambda i: sorted(map(tuple, i.postings.join(i.files, "file_id").select("path", "tri").collect()))
            assert tri(again) == tri(fresh) and tuple(again.stats().first()) == tuple(fresh.stats().first())
        if k == 19:
            break
    assert merges >= 4 and len(index.log["segments"]) < 8


def test_containers_keep_their_places():
    r = np.random.default_rng(6)
    kinds = set()
    for n in (1, 2, 3, 40, 256, 257, 3000, segments.BUCKET):
        for places in (np.sort(r.choice(segments.BUCKET, n, replace=False)), np.arange(segments.BUCKET - n, segments.BUCKET)):
            kind, data = segments.encode(places)
            kinds.add(kind)
            assert (np.flatnonzero(segments.decode(kind, data)) == places).all() and len(data) <= segments.BUCKET // 8
    assert kinds == {segments.ARRAY, segments.BITS, segments.RUNS}


def test_writers_of_one_log_do_not_overwrite_each_other(spark, tmp_path):
    place = str(tmp_path / "log")
    first = _corpus(spark, ("elm", "ripe pear"), ("oak", "bare"))
    index = segments.StoredIndex.build(first, place)
    a, b = _corpus(spark, ("elm", "ripe plum"), ("oak", "bare")), _corpus(spark, ("elm", "ripe fig!"), ("oak", "bare"))
    index.apply(index.reconcile(a.files), a)
    held = {x.name for x in (tmp_path / "log").iterdir()}
    with pytest.raises(segments.Conflict):
        index.apply(index.reconcile(b.files), b)
    assert {x.name for x in (tmp_path / "log").iterdir()} == held  # nothing of the slower one stays
    now = segments.StoredIndex.open(spark, place)
    after = now.apply(now.reconcile(b.files), b)
    assert _found(after, "fig") == {"elm"} and _found(after, "pear|plum") == set() and _found(index, "pear") == {"elm"}
    none = spark.createDataFrame([], "id long, path string, text string")
    empty = after.apply(after.reconcile(Corpus.from_df(none, "id", "text", "path").files), Corpus.from_df(none, "id", "text", "path"))
    assert empty.live_files == 0 and _found(empty, "bare") == set() and _found(empty, ".") == set()
    thread = empty.merge_in_background()
    thread.join(120)
    assert not thread.is_alive() and not segments.StoredIndex.open(spark, place).due()
    assert segments.StoredIndex.build(Corpus.from_df(none, "id", "text", "path"), str(tmp_path / "none")).live_files == 0


def test_damaged_and_missing_logs(spark, tmp_path):
    place = tmp_path / "log"
    segments.StoredIndex.build(_corpus(spark, ("elm", "pear")), str(place))
    for _ in range(3):
        index = segments.StoredIndex.build(_corpus(spark, ("elm", "pear")), str(place))
    assert sorted(x.name for x in place.iterdir() if x.name.startswith("v-")) == ["v-3", "v-4"]
    assert len([x for x in place.iterdir() if x.name.startswith("s-")]) == 2
    (place / index.log["segments"][0]["name"]).rename(place / "elsewhere")
    with pytest.raises(ValueError, match="damaged"):
        segments.StoredIndex.open(spark, str(place))
    (place / "v-5").write_text('{"format": 1}')
    for bad in (place, tmp_path / "missing"):
        with pytest.raises(ValueError):
            segments.StoredIndex.open(spark, str(bad))


def test_an_edit_that_keeps_the_size_is_seen(spark):
    old, now = _corpus(spark, ("a", "one fox ran"), ("b", "owl")), _corpus(spark, ("a", "one owl ran"), ("b", "owl"))
    index = Index.build(old)
    for one in (index, index.apply(index.reconcile(now.files), now)):
        assert {r["path"] for r in search(now, "owl", index=Index(one.files, one.postings), strategy="index").collect()} == {"a", "b"}
    assert [tuple(r) for r in index.reconcile(now.files).collect()] == [("a", "changed")]
    timed = spark.createDataFrame([(1, "a", "one fox ran", 5)], "id long, path string, text string, t long")
    assert Corpus.from_df(timed, "id", "text", "path", "t").files.first()["digest"] is None


def test_tables_and_indexes_of_random_states_agree(spark):
    r = random.Random(12)
    state = {f"f{i}": " ".join(r.choice(["ivy", "moss", "fern", "reed"]) for _ in range(3)) for i in range(12)}
    index, corpus = None, None
    for _ in range(3):
        files = sorted(state.items(), key=lambda _: r.random())
        corpus = _corpus(spark, *files)
        if index is None:
            index = Index.build(corpus)
        else:
            stale = {x["path"] for x in search(corpus, "fern", index=index, strategy="index").select("path").collect()}
            assert stale == {p for p, t in files if "fern" in t}
            index = index.apply(index.reconcile(corpus.files), corpus)
        for word in ("ivy", "moss fern"):
            got = {x["path"] for x in search(corpus, word, index=Index(index.files, index.postings), strategy="index").select("path").collect()}
            assert got == {p for p, t in files if word in t}
        for name in r.sample(sorted(state), 4):
            del state[name]
        state |= {f"f{r.randrange(16)}": "x" * r.randrange(9) + r.choice([" ivy", " fern moss fern"]) for _ in range(5)}


def test_auto_weighs_a_lookup_against_what_it_saves(spark, sf, tmp_path, monkeypatch):
    from siftline.operators import search as module

    c = catalog.documents(spark, sf)
    index, asked = segments.StoredIndex.build(c, str(tmp_path / "i")), []
    many = {p: search(c, p, strategy="scan").count() for p in ("license", "[a-z]he ", ".")}
    monkeypatch.setattr(Index, "matching_ids", lambda self, q: 1 / 0)
    real = segments.StoredIndex._read
    monkeypatch.setattr(segments.StoredIndex, "_read", lambda self, q: asked.append(q) or real(self, q))
    assert all(search(c, p, index=index).count() == n for p, n in many.items()) and not asked  # a small corpus is read
    monkeypatch.setattr(module, "_bytes", lambda df: 1 << 40)
    assert all(search(c, p, index=index).count() == n for p, n in many.items())
    assert len(asked) == 2
    # of a corpus that is read in two lookups' time, a condition that leaves most files saves too little
    asked.clear()
    monkeypatch.setattr(module, "_bytes", lambda df: int(2 * module.LOOKUP_SECONDS * module.MATCHED_BYTES * spark.sparkContext.defaultParallelism))
    assert index.share(for_pattern("the |and ")) > 0.5 > index.share(for_pattern("icense|zzqx")) and index.share(for_pattern("zzq|xqj")) < 0.01
    for p in ("the |and ", "icense|zzqx"):
        search(c, p, index=index).count()
    assert asked == [for_pattern("icense|zzqx")]


def test_context_and_plain_searches_have_no_shuffle(spark):
    c = _corpus(spark, ("a", "x\ny"))
    for options in (SearchOptions(), SearchOptions(before=2, after=1), SearchOptions(only_matching=True), SearchOptions(before=1, only_matching=True)):
        assert "Exchange" not in search(c, "x", options)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("before,after", [(0, 1), (1, 0), (2, 2), (0, 3), (9, 9)])
def test_context_equals_a_plain_reading(spark, before, after):
    r = random.Random(before * 10 + after)
    texts = [(f"p{k}", "\n".join(r.choice(["m", "-", "-", "-"]) for _ in range(r.randint(1, 30)))) for k in range(12)]
    got = {(x["path"], x["line_no"]): (x["is_match"], x["block"]) for x in search(_corpus(spark, *texts), "m", SearchOptions(before=before, after=after)).collect()}
    want = {}
    for path, text in texts:
        lines, block, last = text.split("\n"), -1, None
        for i in range(len(lines)):
            if any("m" in x for x in lines[max(0, i - after) : i + before + 1]):
                block += last is None or i - last > 1
                last = i
                want[path, i + 1] = ("m" in lines[i], block)
    assert got == want


def test_orders_by_path(spark):
    names = ["src/core/a.c", "src/core/test_a.c", "vendor/z.c", "src/b.spec.js", "docs/x", "src/core/deep/q.c"]
    rows = spark.createDataFrame([(n, 1, 0, True) for n in names], "path string, line_no long, ordinal int, is_match boolean")

    def order(key):
        spec = sort.SortSpec(key)
        return [r["path"] for r in sort.order_values(rows, spec).orderBy(*sort.ordering(spec)).collect()]

    assert order("path-kind") == ["docs/x", "src/core/a.c", "src/core/deep/q.c", "src/b.spec.js", "src/core/test_a.c", "vendor/z.c"]
    assert order("in-folder:src/core")[:3] == ["src/core/a.c", "src/core/deep/q.c", "src/core/test_a.c"]
    assert order("folder-distance:src/core") == ["src/core/a.c", "src/core/test_a.c", "src/b.spec.js", "src/core/deep/q.c", "docs/x", "vendor/z.c"]
    with pytest.raises(ValueError):
        sort.SortSpec("in-folder")


def test_relevance(spark):
    ranked = spark.createDataFrame([("r", "q1", "a", 1), ("r", "q1", "b", 2), ("r", "q2", "a", 1), ("r", "q2", "b", 2), ("s", "q1", "b", 1), ("s", "q1", "a", 2), ("s", "q2", "c", 1)], "ranking string, query string, path string, rank int")
    touched = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q9", "a")], "query string, path string")
    got = {r["ranking"]: tuple(r)[1:] for r in rank.relevance(ranked, touched).collect()}
    assert got == {"r": (2, 0.5, 0.75), "s": (2, 0.0, 0.25)}


def test_changes_of_empty_listings(spark):
    none = spark.createDataFrame([], "path string, size long, mtime_ns long")
    some = spark.createDataFrame([("a", 1, 2)], none.schema)
    assert changes(none, none).count() == 0
    assert changes(none, some).first()["kind"] == "new" and changes(some, none).first()["kind"] == "removed"


def test_index_narrows_by_many_trigrams(spark, sf):
    c = catalog.documents(spark, sf)
    index = Index.build(c)
    for pattern in ("(?i)licensed under the", "(alpha|the (quick|slow)|over the)[a-z ]*(and|that)"):
        true = {r[0] for r in search(c, pattern, strategy="scan").select("file_id").distinct().collect()}
        assert true <= {r[0] for r in index.candidates(for_pattern(pattern)).collect()}


def test_find(spark):
    files = _corpus(spark, *[(p, "") for p in ("kelp/3", "reef/1", "kelp/1", "kelp/2", "kelp/4")]).files
    told, key = [], None
    while True:
        got = find_page(files, "kelp", 3, key)
        told.append((got.total, got.start, [r[0] for r in got.paths.collect()]))
        if (key := got.next_after) is None:
            break
    assert told == [(4, 0, ["kelp/1", "kelp/2", "kelp/3"]), (4, 3, ["kelp/4"])]


def test_decode(spark):
    rows = [(b"plain",), ("é".encode("utf-8-sig"),), (b"\xff\xfe" + "wide".encode("utf-16-le"),), (b"\xfe\xff" + "wide".encode("utf-16-be"),), (b"\xff\xfeA",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(decode(F.col("b"))).collect()]
    assert got == ["plain", "é", "wide", "wide", "�", None]


def test_tools(spark):
    c = _corpus(spark, ("a.py", "foo 1\nbar\nfoo 2"), ("b.rs", "foo 3"))
    t = Tools(c, Index.build(c))
    first = t.content_search("foo", page_size=2)
    assert first.splitlines()[:4] == ["[matches 1-2 of 3 in 2 files]", "a.py", "  1: foo 1", "  3: foo 2"]
    token = first.splitlines()[-1].removeprefix("[more: cursor ").removesuffix("]")
    assert t.content_search(cursor=token).splitlines() == ["[matches 3-3 of 3 in 2 files]", "b.rs", "  1: foo 3"]
    assert t.content_search("foo", count=True).splitlines()[1:] == ["a.py: 2", "b.rs: 1"]
    assert t.content_search("foo", types=["rust"], files_only=True).splitlines() == ["[files 1-1 of 1]", "b.rs"]
    ranked = t.content_search(r"(1<lo>|3<hi>)", sort_by="weight", weights="lo:1,hi:2")
    assert ranked.splitlines()[1] == "b.rs"
    for more in ({"pattern": "foo"}, {"word": True}, {"page_size": 2, "before": 1}):
        token = t.content_search("foo", page_size=2).splitlines()[-1].removeprefix("[more: cursor ").removesuffix("]")
        with pytest.raises(ValueError, match="stands alone"):
            t.content_search(cursor=token, **more)
    both = t.content_search(["3<hi>", "1<lo>"], sort_by="weight", weights="lo:1,hi:2")
    assert [x for x in both.splitlines() if x[0] != "["] == ["b.rs", "  1: foo 3", "a.py", "  1: foo 1"]
    old = Tools(_corpus(spark, ("a.py", "foo 1 and more"), ("b.rs", "foo 3")), t.index)
    assert [x for x in old.content_search("foo").splitlines() if "index" in x] == ["a.py (changed since index)"]
    assert t.file_search(".rs").splitlines() == ["[paths 1-1 of 1]", "b.rs"]
    assert "files      2" in t.status()
    call = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "content_search", "arguments": {"pattern": "("}}}
    assert handle(t, call)["error"]["code"] == -32602
    assert handle(t, {"id": 2, "method": "tools/list"})["result"]["tools"][0]["name"] == "content_search"


def test_a_session_of_a_tool_client(spark):
    """Requests as a client sends them, line by line."""
    import io
    import json

    from siftline.tools import serve

    t = Tools(_corpus(spark, ("a.py", "foo 1\nbar"), ("b.rs", "foo 3")))
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [
        ask(0, "initialize", protocolVersion="2025-03-26", capabilities={}, clientInfo={"name": "c", "version": "0"}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}),
        ask(1, "tools/list"), ask(2, "ping"), "", ask(3, "tools/call", name="content_search", arguments={"pattern": "foo", "globs": ["*.rs"], "sort": "path"}),
        ask(4, "tools/call", name="content_search", arguments={"pattern": "foo", "hidden": True}), ask(5, "resources/list"), "{", ask(6, "initialize", protocolVersion="1999-01-01"),
    ]
    out = io.StringIO()
    serve(t, lines, out.write)
    told = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in told] == [0, 1, 2, 3, 4, 5, None, 6]
    assert told[0]["result"]["protocolVersion"] == "2025-03-26" and "tools" in told[0]["result"]["capabilities"] and told[0]["result"]["serverInfo"]["name"]
    tools = {x["name"]: x["inputSchema"] for x in told[1]["result"]["tools"]}
    assert set(tools) == {"content_search", "file_search", "status"} and tools["file_search"]["required"] == ["query"]
    p = tools["content_search"]["properties"]
    assert p["globs"] == {"type": "array", "items": {"type": "string"}} and p["page_size"]["type"] == "integer" and p["hidden"] == {"type": "boolean", "default": False} and "sort" in p and p["pattern"]["anyOf"][0] == {"type": "string"}
    assert told[2]["result"] == {} and told[3]["result"]["content"][0]["text"].splitlines()[1:] == ["b.rs", "  1: foo 3"]
    assert told[4]["error"]["code"] == -32602 and told[5]["error"]["code"] == -32601 and told[6]["error"]["code"] == -32700
    assert told[7]["result"]["protocolVersion"] == "2025-06-18"


def test_a_token_has_one_timer_however_many_requests_it_has():
    import types

    from siftline.streaming.cursors import _Cursors

    timers, told = [], []
    state = types.SimpleNamespace(exists=lambda: bool(told), get=lambda: told[-1], update=told.append, clear=told.clear)
    of = _Cursors(5_000_000)
    of.handle, of.state = types.SimpleNamespace(registerTimer=timers.append), state
    rows = pd.DataFrame({"at_us": [k * 1_000_000 for k in range(200)], "put": [k % 2 == 0 for k in range(200)], "cursor": [str(k) if k % 2 == 0 else None for k in range(200)]})
    assert list(of.handleInputRows(("t",), iter([rows.sample(frac=1, random_state=3)]), None)) == [] and timers == [1]
    due = types.SimpleNamespace(getExpiryTimeInMs=lambda: 1)
    first, = of.handleExpiredTimer(("t",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 100_000), due)
    assert first["cursor"].tolist() == [str(k) for k in range(0, 100, 2)] and timers == [1, 101_001]
    rest, = of.handleExpiredTimer(("t",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 900_000), due)
    assert rest["cursor"].tolist() == [str(k) for k in range(100, 200, 2)] and rest["found"].all() and not told and len(timers) == 2


def test_files_of_a_stream_are_as_many_as_the_table_has_parts(spark, sf):
    assert catalog._several(spark.range(10).repartition(17)) == 17 and catalog._several(spark.range(1).coalesce(1)) == 3
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    assert len(spark.read.parquet(catalog._as_folder(spark, docs, catalog._several(docs))).inputFiles()) == 7


def test_python_workers_of_the_index_and_of_many_searches_get_small_batches(spark):
    from siftline.functions.batches import BATCH_BYTES, stretches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    corpus = Corpus.from_df(spark.createDataFrame([(1, "ab cd " * 3000 + "\nxyz"), (2, None), (3, "cd")], "doc_id long, text string"), "doc_id", "text", F.col("doc_id").cast("string"))
    try:
        for make in (lambda: extract(corpus.files), lambda: segments.staged(corpus.files), lambda: batch.lines_with(corpus.files, np.full(1 << 21, 255, np.uint8))):
            spark.conf.set(name, str(1 << 30))
            rows = make()
            assert int(spark.conf.get(name)) <= BATCH_BYTES
            assert rows.count()
        got = rows.select("file_id", "line_no", F.length("line").alias("n"), "tri").collect()
        got = [r for r in got if 10 not in r["tri"].to_bytes(3, "big")]
        assert {(r["file_id"], r["line_no"], r["n"]) for r in got} == {(1, 1, 18000), (1, 2, 3)} and len(got) == 7
    finally:
        spark.conf.set(name, was)
    sizes = np.array([3, 3, 9, 1, 1, 1, 20, 2])
    parts = list(stretches(sizes, 6))
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 3), (3, 6), (6, 7), (7, 8)]
