"""The engine as three tools with plain arguments and text results: content_search, file_search, status."""

from __future__ import annotations

from dataclasses import dataclass, field

from siftline.operators import page, rank, sort
from siftline.operators.filters import FileFilter
from siftline.operators.find import find_page
from siftline.operators.index import Index
from siftline.operators.search import SearchOptions, search
from siftline.operators.status import Progress
from siftline.operators.status import status as index_status
from siftline.plans import regex
from siftline.sources.corpus import Corpus

#: Paths of a file_search page.
FIND_LIMIT = 200


@dataclass
class Tools:
    """A corpus, its index if there is one, and the cursors that are open."""

    corpus: Corpus
    index: Index | None = None
    cursors: page.CursorStore | page.OpenCursors = field(default_factory=page.CursorStore)
    progress: Progress | None = None

    def content_search(
        self, pattern: str | list[str] | None = None, case_insensitive: bool = False, word: bool = False, fixed_strings: bool = False, multi_line: bool = False,
        invert_match: bool = False, only_matching: bool = False, globs: list[str] = (), types: list[str] = (), type_nots: list[str] = (), files_only: bool = False,
        count: bool = False, page_size: int = page.PAGE_SIZE, sort_by: str = "none", reverse: bool = False, weights: str | None = None, context: int = 0, cursor: str | None = None,
        before: int | None = None, after: int | None = None, hidden: bool = False, no_ignore: bool = False,
    ) -> str:
        """One page of results as text; ``cursor`` continues a page before and stands alone."""
        note = None
        if (hidden or no_ignore) and not self.corpus.root:
            raise ValueError("hidden and no_ignore are for folders")
        if cursor is not None:
            given = (pattern, case_insensitive, word, fixed_strings, multi_line, invert_match, only_matching, list(globs), list(types), list(type_nots), files_only, count, sort_by, reverse, weights, context, before, after, hidden, no_ignore)
            if given != (None, False, False, False, False, False, False, [], [], [], False, False, "none", False, None, 0, None, None, False, False):
                raise ValueError("a cursor stands alone; it holds the search that it continues")
            try:
                at = self.cursors.take(cursor)
            except KeyError:
                raise ValueError("unknown or spent cursor; search again") from None
            if at.root != self.corpus.root:
                raise ValueError("the cursor is of another folder")
        else:
            if pattern is None:
                raise ValueError("no pattern")
            options = {
                "ignore_case": case_insensitive, "word": word, "fixed": fixed_strings, "multi_line": multi_line, "invert": invert_match, "only_matching": only_matching,
                "before": context if before is None else before, "after": context if after is None else after, "globs": list(globs), "types": list(types), "type_nots": list(type_nots), "walk": [hidden, no_ignore],
            }
            mode = "count" if count else "files" if files_only else "matches"
            at = page.Cursor(mode, [pattern] if isinstance(pattern, str) else list(pattern), options, max(1, page_size), sort_by, reverse, weights, root=self.corpus.root)
        check_sort(at.sort, at.weights)
        told = dict(at.options)
        corpus = self.corpus
        if any(walked := told.pop("walk", [False, False])):  # a wider walk than the corpus's own; what the index doesn't know is read
            corpus = Corpus.from_path(corpus.files.sparkSession, corpus.root, *walked)
        chosen = FileFilter(*(tuple(told.pop(k)) for k in ("globs", "types", "type_nots")))
        options = SearchOptions(**told, filter=chosen)
        spec = sort.SortSpec(at.sort, at.reverse)
        scores, patterns = None, at.patterns
        ranking = None
        if at.weights is not None:
            ranking = rank.parse(regex.join(patterns, options.fixed), at.weights, options.fixed)
            patterns = [ranking.plain]
        rows = search(corpus, patterns, options, self.index)
        if ranking is not None:
            scores = rank.file_scores(rows, ranking, options.pattern_options())
        got = page.paged(rows, spec, at.mode, at.page_size, at.last_key, at.shown, corpus.files, scores)
        if cursor is not None:
            note = page.staleness(at, got.total_matches, got.fingerprint)
        body = self._body(at.mode, got, rows, options.before or options.after)
        more = None
        if got.has_more:
            after = page.Cursor(**{**at.__dict__, "last_key": got.last_key, "shown": got.last_index, "prev_total": got.total_matches, "fingerprint": got.fingerprint})
            more = f"[more: cursor {self.cursors.put(after)}]"
        return "\n".join(x for x in (note, got.header, *body, more) if x)

    def _body(self, mode: str, got: page.Page, rows, context: bool) -> list[str]:
        if mode != "matches":
            return [r["path"] + (f": {r['n']}" if mode == "count" else "") for r in got.rows.collect()]  # a page
        order = {}
        for r in got.rows.collect():
            order.setdefault(r["path"], len(order))
        shown = page.with_context_of(got.rows, rows) if context else got.rows
        views = sorted(page.grouped(shown).collect(), key=lambda r: order.get(r["path"], len(order)))
        stale = self._stale(list(order))
        return [line for v in views for line in (v["path"] + (" (changed since index)" if v["path"] in stale else ""), *v["lines"])]

    def _stale(self, paths: list[str]) -> set[str]:
        """Those of a page's files that the index knows in another state."""
        if self.index is None or self.index.of is self.corpus or not paths:
            return set()
        some = self.corpus.files.sparkSession.createDataFrame([(p,) for p in paths], "path string")
        return {r["path"] for r in self.index.freshness(some, self.corpus).filter("changed").collect()}

    def file_search(self, query: str, limit: int = FIND_LIMIT, after: str | None = None) -> str:
        """One page of paths that contain ``query``."""
        files = self.index.files if self.index else self.corpus.files
        got = find_page(files, query, limit, after)
        paths = [r["path"] for r in got.paths.orderBy("path").collect()]
        head = f"[paths {got.start + 1}-{got.start + len(paths)} of {got.total}]" if paths else "[no paths]"
        return "\n".join([head, *paths] + ([f"[more: after {got.next_after}]"] if got.next_after else []))

    def status(self) -> str:
        """What the index holds, or how far its build is."""
        if self.index is None:
            told = self.progress.told() if self.progress else None
            return f"state      building, {told[0]} of {told[1]} files; searches scan" if told else "state      no index; searches scan"
        r = index_status(self.index).first()
        return f"state      {r['state']}\nfiles      {r['files_short']}\ntrigrams   {r['trigrams_short']}\nsize       {r['bytes_short']}"


def check_sort(key: str, weights: str | None) -> None:
    """Weights and the weight order need each other."""
    if key == "weight" and weights is None:
        raise ValueError("sort=weight needs weights")
    if weights is not None and key != "weight":
        raise ValueError("weights go with sort=weight only")


#: Versions of the tool protocol that are spoken, the latest last; fixed values.
PROTOCOLS = ("2024-11-05", "2025-03-26", "2025-06-18")
_KINDS = {"str": "string", "bool": "boolean", "int": "integer", "list[str]": "array"}


def schema(call) -> dict:
    """The JSON schema of a tool's arguments, read off its signature; ``sort_by`` is called sort outside."""
    import inspect

    properties, required = {}, []
    for name, p in inspect.signature(call).parameters.items():
        kinds = [_KINDS[k] for k in (x.strip() for x in str(p.annotation).split("|")) if k in _KINDS]
        each = [{"type": k} | ({"items": {"type": "string"}} if k == "array" else {}) for k in kinds]
        name = "sort" if name == "sort_by" else name
        properties[name] = each[0] if len(each) == 1 else {"anyOf": each}
        if p.default is inspect.Parameter.empty:
            required.append(name)
        elif isinstance(p.default, (bool, int, str)):
            properties[name] = properties[name] | {"default": p.default}
    return {"type": "object", "properties": properties, "additionalProperties": False} | ({"required": required} if required else {})


def handle(tools: Tools, request: dict) -> dict | None:
    """Answer one JSON-RPC 2.0 request; notifications have no answer."""
    name, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    calls = {"content_search": tools.content_search, "file_search": tools.file_search, "status": tools.status}
    if name == "initialize":
        asked = params.get("protocolVersion")
        spoken = asked if asked in PROTOCOLS else PROTOCOLS[-1]
        return reply | {"result": {"protocolVersion": spoken, "capabilities": {"tools": {}}, "serverInfo": {"name": "siftline", "version": "1"}}}
    if name == "ping":
        return reply | {"result": {}}
    if name == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": (f.__doc__ or "").strip(), "inputSchema": schema(f)} for n, f in calls.items()]}}
    if name != "tools/call" or params.get("name") not in calls:
        return reply | {"error": {"code": -32601, "message": "method not found"}}
    arguments = dict(params.get("arguments") or {})
    if "sort" in arguments:
        arguments["sort_by"] = arguments.pop("sort")
    try:
        return reply | {"result": {"content": [{"type": "text", "text": calls[params["name"]](**arguments)}]}}
    except (ValueError, TypeError) as e:
        return reply | {"error": {"code": -32602, "message": str(e)}}


def serve(tools: Tools, lines, write) -> None:
    """Answer newline-delimited requests from an iterable of lines."""
    import json

    for line in lines:
        if line.strip():
            try:
                answer = handle(tools, json.loads(line))
            except json.JSONDecodeError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            if answer is not None:
                write(json.dumps(answer) + "\n")
