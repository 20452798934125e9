"""The files under a folder that ignore rules leave.

Order of authority at a folder, strongest first: .rgignore, .ignore, .gitignore,
.git/info/exclude, the global excludes; deeper folders outrank their parents. Git's
files count only inside a git working tree, whose root ends their reach upwards.
Within one file the last fitting rule decides, and ``!`` takes a path back in.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import cache

from siftline.operators.filters import glob_regex

PLAIN, GIT = (".rgignore", ".ignore"), (".gitignore",)


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file; its expression applies to paths below the file's folder."""

    expression: re.Pattern
    negated: bool
    only_folder: bool


def parse_rules(text: str) -> list[Rule]:
    """The rules of an ignore file; malformed lines are skipped, as they are by git."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        body = re.sub(r"^\\([#!])", r"\1", body)
        if not body.strip("/"):
            continue
        try:
            # a rule names entries; what is below an ignored folder is never reached
            source = glob_regex(body, directory=True).removesuffix("(?:/.*)?$") + "$"
            out.append(Rule(re.compile(source), negated, body.endswith("/")))
        except (ValueError, re.error):
            continue
    return out


def _read(path: str) -> list[Rule]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return parse_rules(f.read().removeprefix("﻿"))
    except OSError:
        return []


def _verdict(rules: list[Rule], relative: str, folder: bool) -> bool | None:
    """True: ignored; False: taken back in; None: no rule fits."""
    for rule in reversed(rules):
        if (folder or not rule.only_folder) and rule.expression.search(relative):
            return not rule.negated
    return None


@cache
def _global_rules() -> tuple[Rule, ...]:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return tuple(_read(os.path.join(base, "git", "ignore")))


class _Levels:
    """Ignore rules from the topmost relevant folder down to the current one."""

    def __init__(self, root: str):
        self.levels: list[tuple[str, list[list[Rule]], list[list[Rule]]]] = []
        parents, at = [], os.path.abspath(root)
        while True:
            parents.append(at)
            if os.path.dirname(at) == at:
                break
            at = os.path.dirname(at)
        self.git_root = next((p for p in parents if _is_git(p)), None)
        for p in reversed(parents):
            self.enter(p)

    def enter(self, folder: str) -> None:
        if _is_git(folder):
            self.git_root = folder
        plain = [_read(os.path.join(folder, n)) for n in PLAIN]
        git = [_read(os.path.join(folder, n)) for n in GIT] if self.git_root else []
        self.levels.append((folder, plain, git))

    def ignored(self, path: str, folder: bool) -> bool:
        """Whether the rules leave out an entry of the deepest level."""
        relative = lambda base: os.path.relpath(path, base).replace(os.sep, "/")
        for k in range(len(PLAIN)):
            for base, plain, _ in reversed(self.levels):
                if (v := _verdict(plain[k], relative(base), folder)) is not None:
                    return v
        if not self.git_root:
            return False
        for base, _, git in reversed(self.levels):
            if len(base) < len(self.git_root):
                break
            for rules in git:
                if (v := _verdict(rules, relative(base), folder)) is not None:
                    return v
        for rules in (_read(os.path.join(self.git_root, ".git", "info", "exclude")), _global_rules()):
            if (v := _verdict(list(rules), relative(self.git_root), folder)) is not None:
                return v
        return False


def _is_git(folder: str) -> bool:
    return any(os.path.exists(os.path.join(folder, n)) for n in (".git", ".jj"))


def walk(root: str, hidden: bool = False, no_ignore: bool = False) -> list[str]:
    """Sorted absolute paths of the files below a folder; symbolic links are not followed."""
    root = os.path.abspath(root)
    return sorted(walk_some([root], root, hidden, no_ignore, None)[0])


def walk_some(folders: list[str], root: str, hidden: bool, no_ignore: bool, most: int | None) -> tuple[list[str], list[str]]:
    """Files below some folders (under ``root``), and folders that were not looked into after ``most`` entries.

    A folder that is given back is walked later as if from the root: its rules are those of all folders above it.
    """
    found: list[str] = []
    rest: list[str] = []
    seen = 0

    def visit(folder: str, levels: _Levels | None) -> None:
        nonlocal seen
        if most is not None and seen > most:
            rest.append(folder)
            return
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            seen += 1
            if not hidden and e.name.startswith("."):
                continue
            is_folder = e.is_dir(follow_symlinks=False)
            if not is_folder and not e.is_file(follow_symlinks=False):
                continue
            if levels and (e.name in (".git", ".jj") and is_folder or levels.ignored(e.path, is_folder)):
                continue
            if is_folder:
                if levels:
                    git_root = levels.git_root
                    levels.enter(e.path)
                visit(e.path, levels)
                if levels:
                    levels.levels.pop()
                    levels.git_root = git_root
            else:
                found.append(e.path)

    for folder in folders:
        visit(folder, None if no_ignore else _Levels(folder))
    return found, rest


def stat(path: str) -> tuple[int, int, int, int]:
    """Size and times (modified, accessed, created) in ns; zeros if the file can't be read."""
    try:
        s = os.stat(path)
    except OSError:
        return 0, 0, 0, 0
    return s.st_size, s.st_mtime_ns, s.st_atime_ns, getattr(s, "st_birthtime_ns", s.st_ctime_ns)
