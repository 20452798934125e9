"""Walks, data sources, streaming, settings and the command line over small folders."""

import io
import os
import random
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from siftline.cli import main
from siftline.config import EngineConfig
from siftline.functions import udtf
from siftline.functions.formats import shell_quote
from siftline.operators.filters import FileFilter
from siftline.operators.find import git_scoped
from siftline.operators.index import Index
from siftline.operators.search import SearchOptions, search
from siftline.operators.segments import StoredIndex
from siftline.operators.status import Progress, follow as follow_status
from siftline.plans.query import for_pattern
from siftline.sources import frontier, splits
from siftline.sources.corpus import Corpus
from siftline.sources.walk import walk
from siftline.streaming.refresh import bring_up_to_date, folder_listings, follow, matches_of_stream


def _grow(root, files: dict) -> str:
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def _tree(r: random.Random) -> dict:
    folders = ["", "a/", "b/", "a/c/", ".d/", "a/b/c/"]
    return {r.choice(folders) + r.choice(["x", "y.o", "z.txt", ".w", "a", "#k", "x y"]) + r.choice(["", "", "1"]): "" for _ in range(14)}


def _rules(r: random.Random) -> list[str]:
    body = ["x", "*.o", "a/", "/b", "c/*", "**/z.txt", "b/**", "?1", "[xy]*", ".w", "*", "a/b", "\\#k", "x y", "# note", "", "  "]
    return [("!" if r.random() < 0.3 else "") + r.choice(body) for _ in range(r.randrange(0, 4))]


def _of_git(folder) -> list[str]:
    """What git lists of a folder whose files it doesn't know yet."""
    git = lambda *a: subprocess.run(["git", "-c", "core.excludesFile=", *a], cwd=folder, check=True, capture_output=True).stdout
    if not (folder / ".git").exists():
        git("init", "-q")
        (folder / ".git" / "info" / "exclude").write_text("")
    return sorted(x.decode() for x in git("ls-files", "-z", "--others", "--exclude-standard").split(b"\0") if x)


def _tidy(tree: dict) -> dict:
    """A tree without names that are files and folders at once."""
    return {p: t for p, t in tree.items() if not any(q.startswith(p + "/") for q in tree)}


@pytest.mark.parametrize("seed", range(30))
def test_walk_lists_what_git_lists(tmp_path, seed):
    """Random trees with rules in several folders, with dots and without."""
    r = random.Random(seed)
    tree = _tidy(_tree(r))
    tree |= {f: "\n".join(_rules(r)) for f in (".gitignore", "a/.gitignore", "b/.gitignore") if r.random() < 0.7 and f.rpartition("/")[0] not in tree}
    root = _grow(tmp_path, tree)
    want = _of_git(tmp_path)
    told = lambda **flags: [os.path.relpath(p, root) for p in walk(root, **flags)]
    assert told(hidden=True) == want
    assert told() == [p for p in want if not any(x.startswith(".") for x in p.split("/"))]
    assert told(no_ignore=True) == sorted(p for p in tree if not any(x.startswith(".") for x in p.split("/")))


@pytest.mark.parametrize("seed", range(3))
def test_rounds_of_tasks_find_what_one_walk_finds(spark, tmp_path, seed):
    r = random.Random(200 + seed)
    tree = _tidy({f"{'/'.join(r.choice('abcd') for _ in range(r.randrange(0, 6)))}/{r.choice(['x', 'y.o', '.w', 'z'])}".lstrip("/"): "t" for _ in range(60)})
    tree |= {f: "\n".join(_rules(r)) for f in (".ignore", "a/.ignore", "b/.gitignore", ".git/config") if f.rpartition("/")[0] not in tree}
    root = _grow(tmp_path, tree)
    for flags in ({}, {"hidden": True}, {"no_ignore": True}):
        want = {os.path.relpath(p, root) for p in walk(root, **flags)}
        got = frontier.listing(spark, root, first=3, each=4, **flags).collect()
        assert {x["path"] for x in got} == want and len(got) == len(want)
    a, b = (Corpus.from_path(spark, root, frontier=f).files.select("file_id", "path", "text", "size", "mtime_ns").collect() for f in (False, True))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert frontier.listing(spark, str(tmp_path / "nowhere")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_kinds_of_rules_outrank_each_other(tmp_path, seed):
    """Rules of four kinds of file at the root decide as if they stood in one, the stronger ones further down."""
    r = random.Random(100 + seed)
    tree = _tidy(_tree(r))
    order = [".git/info/exclude", ".gitignore", ".ignore", ".rgignore"]  # from the weakest on
    rules = {k: _rules(r) for k in order}
    one, many = tmp_path / "one", tmp_path / "many"
    _grow(one, tree | {".gitignore": "\n".join(x for k in order for x in rules[k])})
    _grow(many, tree)
    want = [p for p in _of_git(one) if p != ".gitignore"]
    _of_git(many)
    _grow(many, {k: "\n".join(v) for k, v in rules.items()})
    told = lambda **flags: [p for p in (os.path.relpath(p, many) for p in walk(str(many), hidden=True, **flags)) if p not in order and not p.startswith(".git/")]
    assert told() == want
    # outside a repository git's own rules count for nothing
    (many / ".git").rename(tmp_path / "gone")
    _grow(one, {".gitignore": "\n".join(x for k in order[2:] for x in rules[k])})
    assert told() == [p for p in _of_git(one) if p != ".gitignore"]


def _paths(rows) -> set[str]:
    return {r["path"] for r in rows.select("path").collect()}


def test_corpus_of_a_folder(spark, tmp_path):
    root = _grow(tmp_path, {"plain.txt": "a heron", "wide.txt": b"\xff\xfe" + "wide heron".encode("utf-16-le"), "raw.bin": b"\0\0heron", "_under.txt": "heron", "day=1/p.txt": "none"})
    c = Corpus.from_path(spark, root)
    assert _paths(search(c, "heron")) == {"plain.txt", "wide.txt", "_under.txt"}
    index = Index.build(c)
    assert _paths(index.candidates(for_pattern("heron"))) == {"plain.txt", "wide.txt", "_under.txt"}
    assert _paths(c.files) == {"plain.txt", "wide.txt", "raw.bin", "_under.txt", "day=1/p.txt"}
    assert c.files.filter(c.files.path.startswith("day=1/")).count() == 1


@pytest.mark.parametrize("each", [1, 7, 5000])
def test_lines_of_ranges_are_the_lines_of_the_files(spark, tmp_path, monkeypatch, each):
    """Ranges of a byte and more, whose borders fall anywhere; some bytes are read at a time."""
    monkeypatch.setattr(splits, "CHUNK_BYTES", 5)
    r = random.Random(each)
    files = {f"f{i}": "".join(r.choice(["a", "é", "\n", "\n\n", "bc"]) for _ in range(r.randrange(0, 60))) for i in range(8)}
    files |= {"nul": "x" * 1100 + "\nseen\ncut\0off\nmore", "binary": "\0a\nb", "bom": b"\xef\xbb\xbfone\ntwo", "wide": b"\xff\xfe" + "w1\nw2\n".encode("utf-16-le"), "none": "", "last": "no feed", "bad": b"\xff\xfd\nok"}
    if each == 1:
        del files["nul"]
    root = _grow(tmp_path, files)
    listed = frontier.listing(spark, root, hidden=True).select("path", "size")
    got = splits.lines(listed, root, each)
    want = Corpus.from_path(spark, root).lines().select("path", "line_no", "line")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hit = lambda df: df.filter(F.contains("line", F.lit("b")))
    shown = splits.with_context(hit(got), got, 1, 2).collect()
    wanted = search(Corpus.from_path(spark, root), "b", SearchOptions(before=1, after=2)).collect()
    assert {(x["path"], x["line_no"], x["is_match"]) for x in shown} == {(x["path"], x["line_no"], x["is_match"]) for x in wanted} and len(shown) == len(wanted)
    begins = {(p, b): min(x["line_no"] for x in wanted if (x["path"], x["block"]) == (p, b)) for p, b in {(x["path"], x["block"]) for x in wanted}}
    assert {(x["path"], x["line_no"]) for x in shown if x["begins"]} == {(p, n) for (p, _), n in begins.items()}


def test_globs_and_scopes_are_relative_to_the_folder(spark, tmp_path):
    c = Corpus.from_path(spark, _grow(tmp_path, {"lib/a.py": "tern", "lib/sub/b.py": "tern", "c.py": "tern", "d.rs": "tern"}))
    found = lambda *globs: _paths(search(c, "tern", SearchOptions(filter=FileFilter(globs=globs))))
    assert found("lib/*") == {"lib/a.py", "lib/sub/b.py"} and found("/c.py") == {"c.py"} and found("!lib/**") == {"c.py", "d.rs"}
    assert found("/*.py") == {"c.py"} and found("lib/*.py") == {"lib/a.py"}
    assert _paths(search(c, "tern", SearchOptions(scope="lib/sub"))) == {"lib/sub/b.py"}


def test_a_file_in_front_changes_no_other(spark, tmp_path):
    root = _grow(tmp_path, {"m.txt": "curlew", "n.txt": "curlew and plover"})
    place = str(tmp_path.parent / f"{tmp_path.name}-index")
    StoredIndex.build(Corpus.from_path(spark, root), place)
    _grow(tmp_path, {"a.txt": "plover first", "m.txt": "plover instead"})
    os.remove(f"{root}/n.txt")
    _grow(tmp_path, {"z.txt": "curlew last"})
    now, stored = Corpus.from_path(spark, root), StoredIndex.open(spark, place)
    after = stored.apply(stored.reconcile(now.files), now)
    for index in (stored, after, Index(after.files, after.postings)):
        for pattern in ("plover", "curlew|first$"):
            assert _paths(search(now, pattern, index=index, strategy="index")) == _paths(search(now, pattern, strategy="scan"))
    assert _paths(search(now, "plover", index=stored)) == {"a.txt", "m.txt"}
    told = {r["path"]: r["changed"] for r in stored.freshness(now.files.select("path"), now).collect()}
    assert told == {"a.txt": True, "m.txt": True, "z.txt": True}


def test_refresh_follows_a_folder(spark, tmp_path):
    root = _grow(tmp_path / "files", {"one.txt": "a GULL"})
    place = str(tmp_path / "index")
    corpus = lambda s: Corpus.from_path(s, root)
    assert bring_up_to_date(spark, place, corpus(spark)) == 1
    assert bring_up_to_date(spark, place, corpus(spark)) == 0
    _grow(tmp_path / "files", {"0.txt": "a GULL too"})
    run = follow(folder_listings(spark, root), place, corpus, str(tmp_path / "checkpoint"))
    try:
        run.processAllAvailable()
        assert _paths(StoredIndex.open(spark, place).candidates(for_pattern("GULL"))) == {"one.txt", "0.txt"}
        os.remove(f"{root}/one.txt")
        run.processAllAvailable()
        index = StoredIndex.open(spark, place)
        assert _paths(search(corpus(spark), "GULL", index=index, strategy="index")) == {"0.txt"}
    finally:
        run.stop()


def test_a_stream_of_documents_is_searched(spark, tmp_path):
    spark.createDataFrame([(1, "x\nowl"), (2, "none"), (3, "owl")], "id long, body string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, body string").parquet(str(tmp_path / "in"))
    run = matches_of_stream(stream, "owl", "id", "body").writeStream.format("memory").queryName("owls").start()
    try:
        run.processAllAvailable()
        assert sorted(map(tuple, spark.sql("select * from owls").collect())) == [(1, 2, "owl"), (3, 1, "owl")]
    finally:
        run.stop()


def test_table_functions(spark):
    udtf.register(spark)
    assert [tuple(r) for r in spark.sql("select * from search_lines('q\\nrat\\nthe rat', 'ra+t')").collect()] == [(2, "rat"), (3, "the rat")]
    assert [r[0] for r in spark.sql("select * from trigrams('wxyz')").collect()] == [0x777879, 0x78797A]
    with pytest.raises(Exception, match="PatternError|backreference|escape"):
        spark.sql(r"select * from search_lines('q', '(q)\\\\1')").collect()
    for bad in ("(?=q)", "[[:alpha:]]", "(?P<n>q)"):
        with pytest.raises(Exception, match="PatternError"):
            spark.sql(f"select * from search_lines('q', '{bad}')").collect()
    d = spark.createDataFrame([(1, "q\nrat\nthe rat\n"), (2, None), (3, "rat\0rat"), (4, "")], "id int, t string")
    found = spark.sql("select id, inline(f) from (select id, matching_lines(t, 'ra+t$') as f from {d})", d=d)
    assert sorted(map(tuple, found.collect())) == [(1, 2, "rat"), (1, 3, "the rat"), (3, 1, "rat")]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and spark.sql("select * from trigrams('xy')").count() == 0


def _run(spark, root):
    def run(*args):
        out = io.StringIO()
        return main([*args], spark, out), out.getvalue().replace(root + "/", "")

    return run


def test_command_line(spark, tmp_path):
    root = _grow(tmp_path, {"m.py": "wren\nlark\nwren lark\n", "deep/n.rs": "WREN\n"})
    run = _run(spark, root)
    assert run("wren", root) == (0, "m.py:1:wren\nm.py:3:wren lark\n")
    assert run("-i", "wren", root, "-t", "rust")[1] == "deep/n.rs:1:WREN\n"
    assert run("-i", "wren", root, "-g", "deep/*")[1] == "deep/n.rs:1:WREN\n"
    assert run("-i", "-s", "-N", "-o", "-e", "wren", "-e", "lark", root)[1] == "m.py:wren\nm.py:lark\nm.py:wren\nm.py:lark\n"
    assert run("wren", f"{root}/m.py") == (0, "1:wren\n3:wren lark\n")
    assert run("absent", root)[0] == 1
    assert run("(", root)[0] == 2 and run("-t", "nope", "x", root)[0] == 2 and run("--sort", "weight", "x", root)[0] == 2
    assert run("--find", ".rs", root) == (0, "deep/n.rs\n")
    assert run("--compact", "-c", "wren", root)[1].startswith("[count 1-1 of 1 file · 2 matches]")
    assert run("-A1", "lark", root)[1] == "m.py:2:lark\nm.py:3:wren lark\n"
    # labels may stand in any of several patterns
    weighed = ("-i", "-e", "lark<low>", "-e", "wren<high>", "--sort", "weight", "--weights", "low:1,high:2")
    assert run("-N", *weighed, root)[1] == "deep/n.rs:WREN\nm.py:wren\nm.py:lark\nm.py:wren lark\n"


def test_command_line_searches_through_a_kept_index(spark, tmp_path, monkeypatch):
    root = _grow(tmp_path / "files", {"m.py": "wren\nlark\n", "n.rs": "WREN\n", ".h": "wren\n", "skip.o": "wren\n", ".ignore": "*.o"})
    run, kept = _run(spark, root), str(tmp_path / "kept")
    asked = []
    real = StoredIndex.may_match
    monkeypatch.setattr(StoredIndex, "may_match", lambda self, q, files: asked.append(q) or real(self, q, files))
    for args in (("-i", "wren"), ("wren", "--hidden", "--no-ignore"), ("-v", "wren")):
        assert run("--index", kept, *args, root) == run(*args, root)
        assert run("--index", kept, "--compact", *args, root) == run("--compact", *args, root)
    assert asked and len(os.listdir(kept)) == 1
    _grow(tmp_path / "files", {"z.txt": "wren again\n"})
    assert run("--index", kept, "wren", root)[1] == "m.py:1:wren\nz.txt:1:wren again\n"
    text = run("--index", kept, "--compact", "--page-size", "1", "wren", root)[1]
    token = text.splitlines()[-1].removeprefix("[more: cursor ").removesuffix("]")
    assert run("--cursor", token, "--index", kept)[1].splitlines()[1:] == ["z.txt", "  1: wren again"]


def test_command_line_paths_are_those_typed(spark, tmp_path, monkeypatch):
    root = _grow(tmp_path, {"deep/n.rs": "wren\n"})
    monkeypatch.chdir(tmp_path)
    run = _run(spark, root)
    assert run("wren")[1] == "deep/n.rs:1:wren\n" and run("wren", "deep")[1] == "deep/n.rs:1:wren\n" and run("wren", "./deep/")[1] == "./deep/n.rs:1:wren\n" and run("wren", ".")[1] == "./deep/n.rs:1:wren\n"


def test_compact_context_is_one_sided_and_cursors_go_on(spark, tmp_path):
    root = _grow(tmp_path, {"p.txt": "before\nwren 1\nafter\n", "q.txt": "wren 2\n", ".r.txt": "wren 3\n"})
    run = _run(spark, root)
    assert run("--compact", "-A1", "wren 1", root)[1].splitlines()[1:] == ["p.txt", "  2: wren 1", "  3- after"]
    assert run("--compact", "-B1", "wren 1", root)[1].splitlines()[1:] == ["p.txt", "  1- before", "  2: wren 1"]
    got, text = [], run("--compact", "--hidden", "--page-size", "1", "--sort", "path", "wren", root)[1]
    for _ in range(3):
        got += text.splitlines()[1:3]
        last = text.splitlines()[-1]
        if not last.startswith("[more: cursor "):
            break
        code, text = run("--cursor", last.removeprefix("[more: cursor ").removesuffix("]"))
        assert code == 0
    assert got == [".r.txt", "  1: wren 3", "p.txt", "  2: wren 1", "q.txt", "  1: wren 2"]
    token = run("--compact", "--page-size", "1", "wren", root)[1].splitlines()[-1].removeprefix("[more: cursor ").removesuffix("]")
    assert run("--cursor", token, "wren")[0] == 2 and run("--cursor", token, "-i")[0] == 2 and run("--cursor", "nonsense")[0] == 2


def test_settings(spark, tmp_path):
    place = tmp_path / "c.toml"
    place.write_text("persist_threshold_ms = 7\n")
    config = EngineConfig.load(str(place), cache_dir="/x")
    assert config == EngineConfig("/x", 7) and config.keep(8) and not config.keep(6)
    for bad in ("odd = 1", "cache_dir = 3"):
        place.write_text(bad)
        with pytest.raises(ValueError):
            EngineConfig.load(str(place))


def test_an_index_is_kept_if_its_build_took_long_enough(spark, tmp_path):
    root = _grow(tmp_path / "files", {"a.txt": "stork"})
    corpus = Corpus.from_path(spark, root)
    for seconds, kept in ((0.1, False), (0.3, True)):
        ticks = iter((0.0, seconds))
        config = EngineConfig(str(tmp_path / "cache"), 200)
        assert _paths(config.open_index(corpus, lambda: next(ticks)).candidates(for_pattern("stork"))) == {"a.txt"}
        assert os.path.exists(config.place(corpus.root)) == kept
    _grow(tmp_path / "files", {"b.txt": "stork"})
    # an index in memory is older than the folder by now
    held = EngineConfig().open_index(corpus)
    _grow(tmp_path / "files", {"0.txt": "stork"})
    assert _paths(search(Corpus.from_path(spark, root), "stork", index=held, strategy="index")) == {"0.txt", "a.txt", "b.txt"}
    os.remove(f"{root}/0.txt")
    again = config.open_index(Corpus.from_path(spark, root))
    assert _paths(again.candidates(for_pattern("stork"))) == {"a.txt", "b.txt"}


def test_progress_and_status_are_followed(spark, tmp_path):
    corpus = Corpus.from_path(spark, _grow(tmp_path, {f"{i}.txt": "x" for i in range(20)}))
    progress, done = Progress(corpus.files), threading.Event()
    assert progress.told() == (0, 20)

    def build():
        Index.build(Corpus(progress.counted())).postings.count()
        done.set()

    worker = threading.Thread(target=build)
    worker.start()
    frames = list(follow_status(progress.told, 0.01, done.is_set))
    worker.join()
    assert frames[0] == (0, 20) and frames[-1] == (20, 20) and len(frames) == len(set(frames))


def test_path_lists_and_quotes(spark):
    files = spark.createDataFrame([("a b",), ("it's",), ("plain",)], "path string")
    assert [r[0] for r in files.select(shell_quote(F.col("path"))).collect()] == ["'a b'", "'it'\\''s'", "plain"]
    assert _paths(git_scoped(files, files.filter("path <> 'plain'"))) == {"a b", "it's"}


def test_files_are_written_by_many_tasks_and_ranges_read_no_more(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "RUN", 3)
    texts = {k: "é" * (k % 5) + "\n" * (k % 2) + str(k) for k in range(-4, 40)}
    rows = [(f"f{k % 2}", k, t) for k, t in texts.items()] + [("f0", 100, None), ("g/h", 5, "")]
    random.Random(1).shuffle(rows)
    files = splits.write_files(spark.createDataFrame(rows, "path string, at long, text string").repartition(5), str(tmp_path))
    wanted = {f"f{k}": "".join(texts[i] + "\n" for i in sorted(texts) if i % 2 == k).encode() for k in (0, 1)} | {"g/h": b"\n"}
    assert {p: (tmp_path / p).read_bytes() for p in wanted} == wanted
    assert {r["path"]: r["size"] for r in files.collect()} == {p: len(x) for p, x in wanted.items()}
    (tmp_path / "long").write_bytes(b"abc\n" * (1 << 20))
    taken = []
    monkeypatch.setattr(splits, "_chunks", lambda *a, f=splits._chunks: (taken.append(len(x)) or x for x in f(*a)))
    got = [r for some in splits._range_lines(str(tmp_path / "long"), "long", 4000, 54_000, None, False, 1000) for r in some]
    assert [r[1] for r in got] == list(range(1001, 13_501)) and sum(taken) < 200_000


def test_lines_are_not_broadcast_for_their_context(spark, tmp_path):
    (tmp_path / "f").write_text("a\nb\nc\n")
    lines = splits.lines(spark.createDataFrame([("f", 6)], "path string, size long"), str(tmp_path))
    shown = splits.with_context(lines.filter("line = 'b'"), lines, 1, 1)
    plan = shown._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r["line"] for r in shown.collect()) == ["a", "b", "c"]
