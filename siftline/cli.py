"""Command line: search a folder, find names, or answer tool requests.

    python -m siftline.cli [flags] PATTERN [PATH]
    python -m siftline.cli --compact [flags] PATTERN [PATH]
    python -m siftline.cli --cursor CURSOR
    python -m siftline.cli --find NEEDLE [PATH]
    python -m siftline.cli --tools [PATH]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession


class _Last(argparse.Action):
    """Flags of one pair: the last one given wins."""

    def __call__(self, parser, namespace, values, option_string=None):
        setattr(namespace, self.dest, self.const)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline", add_help=True)
    mode = p.add_mutually_exclusive_group()
    for name in ("compact", "find", "tools"):
        mode.add_argument(f"--{name}", action="store_true")
    for short, const in (("-i", True), ("-s", False)):
        p.add_argument(short, dest="ignore_case", action=_Last, nargs=0, const=const, default=False)
    for short, const in (("-n", True), ("-N", False)):
        p.add_argument(short, dest="line_numbers", action=_Last, nargs=0, const=const, default=True)
    for short, dest in (("-w", "word"), ("-F", "fixed"), ("-U", "multi_line"), ("-v", "invert"), ("-o", "only_matching"), ("-l", "files_only"), ("-c", "count")):
        p.add_argument(short, dest=dest, action="store_true")
    p.add_argument("-e", "--regexp", action="append", default=[])
    p.add_argument("-A", dest="after", type=int)
    p.add_argument("-B", dest="before", type=int)
    p.add_argument("-C", dest="context", type=int, default=0)
    p.add_argument("-g", "--glob", dest="globs", action="append", default=[])
    p.add_argument("-t", "--type", dest="types", action="append", default=[])
    p.add_argument("-T", "--type-not", dest="type_nots", action="append", default=[])
    p.add_argument("--hidden", action="store_true")
    p.add_argument("--no-ignore", action="store_true")
    p.add_argument("--sort", default="none")
    p.add_argument("--sortr")
    p.add_argument("--weights")
    p.add_argument("--page-size", type=int, default=50)
    p.add_argument("--limit", type=int, default=1000)
    p.add_argument("--after-path")
    p.add_argument("--cursor")
    p.add_argument("--index", metavar="DIR", help="search through an index kept below this folder, brought up to date first")
    p.add_argument("positional", nargs="*")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Run a command; 0 with results, 1 without, 2 for an error."""
    from siftline.config import EngineConfig
    from siftline.operators import page, rank, sort
    from siftline.operators.filters import FileFilter
    from siftline.operators.find import find_page
    from siftline.operators.search import SearchOptions, plan, rendered, search
    from siftline.plans.regex import PatternError, join
    from siftline.sources.corpus import Corpus
    from siftline.tools import Tools, check_sort, serve

    write = (out or sys.stdout).write
    a = parser().parse_intermixed_args(argv)
    rest = list(a.positional)
    patterns = a.regexp or ([rest.pop(0)] if rest and not a.tools and a.cursor is None else [])
    root = rest[0] if rest else "."

    def kept(corpus):
        """The index of a folder, where indexes are kept; hidden files and such that it lacks are read."""
        config = EngineConfig.load(**({"cache_dir": a.index, "persist_threshold_ms": 0} if a.index else {}))
        return config.open_index(corpus) if config.cache_dir else None

    try:
        if a.cursor is not None:
            if a.regexp or rest or a != parser().parse_intermixed_args(["--cursor", a.cursor, *["--compact"] * a.compact, *(["--index", a.index] if a.index else [])]):
                raise ValueError("a cursor stands alone; it holds the search that it continues")
            spark = spark or SparkSession.builder.appName("siftline").getOrCreate()
            at = page.Cursor.decode(a.cursor)
            at.options.setdefault("walk", [False, False])
            corpus = Corpus.from_path(spark, at.root)
            write(Tools(corpus, kept(corpus), cursors=page.OpenCursors()).content_search(cursor=at.encode()) + "\n")
            return 0
        if not patterns and not a.tools:
            raise ValueError("no pattern")
        key, reverse = (a.sortr, True) if a.sortr else (a.sort, False)
        check_sort(key, a.weights)
        spec = sort.SortSpec(key, reverse)
        before, after = (a.context if x is None else x for x in (a.before, a.after))
        options = SearchOptions(a.ignore_case, a.word, a.fixed, a.multi_line, False, a.invert, a.only_matching, before, after, FileFilter(tuple(a.globs), tuple(a.types), tuple(a.type_nots)))
        named = os.path.isfile(root)
        if named:
            options = SearchOptions(**{**options.__dict__, "file": os.path.basename(root)})
        ranking = rank.parse(join(patterns, a.fixed), a.weights, a.fixed) if a.weights else None
        searched = [ranking.plain] if ranking else patterns
        if not (a.find or a.tools):
            plan(searched, options)
        spark = spark or SparkSession.builder.appName("siftline").getOrCreate()
        folder = os.path.dirname(os.path.abspath(root)) if named else root
        corpus = Corpus.from_path(spark, folder, a.hidden or named, a.no_ignore or named)
        # paths are shown below the folder as it was typed
        prefix = "" if named or not rest else root if root.endswith("/") else root + "/"
        if a.tools:
            config = EngineConfig.load()
            serve(Tools(corpus, kept(corpus) or config.open_index(corpus), page.CursorStore(config.cursor_ttl_secs)), sys.stdin, write)
            return 0
        if a.find:
            got = find_page(corpus.files, patterns[0], a.limit, a.after_path)
            for r in got.paths.orderBy("path").collect():
                write(prefix + r["path"] + "\n")
            return 0 if got.total else 1
        if a.compact:
            plain = Corpus.from_path(spark, folder)
            text = Tools(plain, kept(plain), cursors=page.OpenCursors()).content_search(
                patterns, a.ignore_case, a.word, a.fixed, a.multi_line, a.invert, a.only_matching, a.globs, a.types, a.type_nots, a.files_only, a.count, a.page_size, key, reverse, a.weights, 0, None, before, after,
                a.hidden or named, a.no_ignore or named,
            )
            write(text + "\n")
            return 1 if text.startswith("[no") else 0
        if a.files_only or a.count:
            raise ValueError("-l and -c go with --compact")
        index = None if named else kept(Corpus.from_path(spark, folder))
        rows = search(corpus, searched, options, index, "auto" if index is None else "index")
        scores = rank.file_scores(rows, ranking, options.pattern_options()) if ranking else None
        ordered = sort.order_values(rows, spec, corpus.files, scores).orderBy(*sort.ordering(spec))
        shown, last = 0, None
        for r in rendered(ordered, a.line_numbers, not named, prefix).toLocalIterator():
            if (before or after) and spec.key == "none" and last is not None and last != (r["path"], r["block"]):
                write("--\n")
            last = (r["path"], r["block"])
            write(r["rendered"] + "\n")
            shown += 1
        return 0 if shown else 1
    except (ValueError, PatternError) as e:
        sys.stderr.write(f"siftline: {e}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
