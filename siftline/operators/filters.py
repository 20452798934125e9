"""File filters by glob and by type, as one condition over paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types and their globs. A modest public list; extend with ``types=``.
TYPES: dict[str, list[str]] = {
    "c": ["*.c", "*.h"], "cpp": ["*.cc", "*.cpp", "*.cxx", "*.hpp", "*.hh"], "cs": ["*.cs"], "css": ["*.css", "*.scss"], "csv": ["*.csv"], "docker": ["*Dockerfile*"],
    "go": ["*.go"], "html": ["*.htm", "*.html"], "java": ["*.java"], "js": ["*.js", "*.jsx", "*.mjs", "*.cjs"], "json": ["*.json"], "kotlin": ["*.kt", "*.kts"],
    "lock": ["*.lock", "package-lock.json"], "log": ["*.log"], "lua": ["*.lua"], "make": ["Makefile", "*.mk", "GNUmakefile"], "md": ["*.md", "*.markdown"], "php": ["*.php"],
    "proto": ["*.proto"], "py": ["*.py", "*.pyi"], "ruby": ["*.rb", "Rakefile", "Gemfile"], "rust": ["*.rs"], "scala": ["*.scala", "*.sbt"], "sh": ["*.sh", "*.bash", "*.zsh"],
    "sql": ["*.sql"], "swift": ["*.swift"], "toml": ["*.toml"], "ts": ["*.ts", "*.tsx"], "txt": ["*.txt"], "xml": ["*.xml", "*.xsd"], "yaml": ["*.yaml", "*.yml"],
}


@dataclass(frozen=True)
class FileFilter:
    """Globs (``!`` negates; the last that fits decides), types to keep and types to drop."""

    globs: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    type_nots: tuple[str, ...] = ()
    known: dict[str, list[str]] = field(default_factory=lambda: TYPES, compare=False, hash=False)

    def condition(self, path: Column, root: str = "") -> Column:
        """Whether a path stays; raises ValueError for an unknown type or a malformed glob."""
        for name in (*self.types, *self.type_nots):
            if name not in self.known:
                raise ValueError(f"unrecognized file type: {name}")
        below = path if not root else F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)
        keep = F.lit(True)
        if self.globs:
            verdict = F.lit(all(g.startswith("!") for g in self.globs))
            for g in self.globs:
                verdict = F.when(below.rlike(glob_regex(g.removeprefix("!"))), F.lit(not g.startswith("!"))).otherwise(verdict)
            keep = keep & verdict
        of = lambda names: F.lit(False) if not names else below.rlike("|".join(glob_regex(g) for n in names for g in self.known[n]))
        if self.types:
            keep = keep & of(self.types)
        if self.type_nots:
            keep = keep & ~of(self.type_nots)
        return keep

    @property
    def is_empty(self) -> bool:
        return not (self.globs or self.types or self.type_nots)


def glob_regex(glob: str, directory: bool = False) -> str:
    """A regular expression (Java and Python) for relative paths that a glob of ignore files fits.

    Without a slash before its end a glob fits names at any depth; ``*`` and ``?``
    stay within a name, ``**`` crosses folders. A path below a fitting folder fits.
    """
    text = glob
    anchored = "/" in text.rstrip("/")
    text = text.removeprefix("/")
    only_folder = text.endswith("/")
    text = text.rstrip("/")
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if text[i:] == "**" and (i == 0 or text[i - 1] == "/"):
            out.append(".*")
            break
        if c == "*":
            while text.startswith("*", i):
                i += 1
            out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            m = re.compile(r"\[([!^]?)(\]?(?:[^\]\\]|\\.)*)\]").match(text, i)
            if not m:
                raise ValueError(f"unclosed class in glob {glob!r}")
            inner = re.sub(r"\\(.)", r"\1", m[2])
            out.append("[" + "^/" * bool(m[1]) + "".join(f"\\{x}" if x in "[]^\\&" else x for x in inner) + "]")
            i = m.end()
            continue
        elif c == "{":
            end = text.find("}", i)
            if end < 0:
                raise ValueError(f"unclosed alternatives in glob {glob!r}")
            options = [glob_regex("/" + x)[len("(?s)^") : -len("(?:/.*)?$")] for x in text[i + 1 : end].split(",")]
            out.append("(?:" + "|".join(options) + ")")
            i = end + 1
            continue
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out.append(re.escape(text[i]))
        else:
            out.append(re.escape(c))
        i += 1
    body = "".join(out)
    head = "" if anchored or glob.startswith("/") else "(?:.*/)?"
    tail = "/.*" if only_folder and not directory else "(?:/.*)?"
    return f"(?s)^{head}{body}{tail}$"
