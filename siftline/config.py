"""Settings: defaults, then a TOML file, then what is given in code."""

from __future__ import annotations

import os
import time
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Where indexes are kept, and from which build time on they are."""

    cache_dir: str = ""
    persist_threshold_ms: int = 200
    cursor_ttl_secs: float = 120.0

    @classmethod
    def load(cls, path: str | None = None, **given) -> EngineConfig:
        """Settings of a file (SIFTLINE_CONFIG, else the user's configuration folder); an unknown key is an error."""
        base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
        place = path or os.environ.get("SIFTLINE_CONFIG") or os.path.join(base, "siftline", "config.toml")
        told: dict = {}
        if os.path.exists(place):
            with open(place, "rb") as f:
                told = tomllib.load(f)
        elif path:
            raise ValueError(f"no such file: {path}")
        known = {f.name: f.type for f in fields(cls)}
        for key, value in told.items():
            if key not in known:
                raise ValueError(f"unknown setting: {key}")
            kind = {"str": str, "int": int, "float": (int, float)}[str(known[key])]
            if not isinstance(value, kind) or isinstance(value, bool):
                raise ValueError(f"setting {key} has the wrong type")
        return replace(cls(**told), **given)

    def place(self, root: str) -> str:
        """The folder of a corpus's index; empty if indexes are not kept."""
        import hashlib

        return f"{self.cache_dir.rstrip('/')}/{hashlib.sha256(root.encode()).hexdigest()[:16]}" if self.cache_dir else ""

    def open_index(self, corpus, clock=time.perf_counter):
        """The index of a corpus: the kept one brought up to date, else a new one, kept if its build took long enough."""
        from siftline.operators.index import Index
        from siftline.operators.segments import StoredIndex
        from siftline.streaming.refresh import bring_up_to_date

        spark, place = corpus.files.sparkSession, self.place(corpus.root)
        if place:
            try:
                StoredIndex.open(spark, place)
            except ValueError:
                pass
            else:
                bring_up_to_date(spark, place, corpus)
                return StoredIndex.open(spark, place)
        start = clock()
        index = Index.build(corpus)
        index = Index(index.files.persist(), index.postings.persist(), index.of, index.numbered)
        index.postings.count()
        if place and self.keep((clock() - start) * 1000):
            return StoredIndex.build(corpus, place)
        return index

    def keep(self, built_in_ms: float) -> bool:
        """Whether an index that took so long to build is worth storing."""
        return built_in_ms >= self.persist_threshold_ms
