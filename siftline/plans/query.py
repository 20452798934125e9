"""Conditions over byte trigrams that every text with a match fulfils.

A pattern's tree is folded into what is known of all its matches: the whole set
of them while it is small, else sets of heads and tails, and a condition. The
condition may hold for texts without a match and never fails for one with a match.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from siftline.plans.regex import Node, Options, PatternError, parse, variants

#: Strings of a set, and characters of each, that the analysis keeps.
SET_SIZE, LENGTH = 48, 24


@dataclass(frozen=True)
class Query:
    """``all``, one trigram, or the conjunction or disjunction of conditions."""

    kind: str  # all tri and or
    tri: int = -1
    items: tuple[Query, ...] = ()

    def accepts(self, trigrams: set[int]) -> bool:
        """Whether a text with these trigrams may match."""
        if self.kind == "all":
            return True
        if self.kind == "tri":
            return self.tri in trigrams
        return (all if self.kind == "and" else any)(q.accepts(trigrams) for q in self.items)

    def leaves(self) -> set[int]:
        """All trigrams of the condition."""
        return {self.tri} if self.kind == "tri" else set().union(*(q.leaves() for q in self.items))

    @property
    def is_all(self) -> bool:
        """Whether the condition narrows nothing."""
        return self.kind == "all"


ALL = Query("all")


def _flat(kind: str, queries) -> list[Query]:
    out: dict[Query, None] = {}
    for q in queries:
        out.update(dict.fromkeys(q.items if q.kind == kind else (q,)))
    return list(out)


def both(*queries: Query) -> Query:
    """Conjunction; ``all`` falls away."""
    items = [q for q in _flat("and", queries) if not q.is_all]
    return ALL if not items else items[0] if len(items) == 1 else Query("and", items=tuple(items))


def either(*queries: Query) -> Query:
    """Disjunction; ``all`` absorbs it, and an empty one is ``all``."""
    items = _flat("or", queries)
    if not items or any(q.is_all for q in items):
        return ALL
    return items[0] if len(items) == 1 else Query("or", items=tuple(items))


def pack(a: int, b: int, c: int) -> int:
    """A trigram's number: its bytes, most significant first."""
    return a << 16 | b << 8 | c


def of_literal(text: str | bytes) -> list[int]:
    """The trigrams of a text in order, repeats included; none below three bytes."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return [pack(*raw[i : i + 3]) for i in range(len(raw) - 2)]


def _grams(strings) -> Query:
    # in order, so that equal sets give equal conditions
    return either(*(both(*(Query("tri", t) for t in of_literal(s))) for s in sorted(strings)))


@dataclass
class _Known:
    """What is known of all matches of a node."""

    exact: frozenset[str] | None
    head: frozenset[str] = frozenset([""])
    tail: frozenset[str] = frozenset([""])
    query: Query = field(default=ALL)

    def heads(self) -> frozenset[str]:
        return self.head if self.exact is None else self.exact

    def tails(self) -> frozenset[str]:
        return self.tail if self.exact is None else self.exact

    def loose(self) -> _Known:
        """The same knowledge without the whole set."""
        if self.exact is None:
            return self
        return _Known(None, _short(self.exact, True), _short(self.exact, False), both(self.query, _grams(self.exact)))


_EMPTY = frozenset([""])


def _short(strings: frozenset[str], head: bool) -> frozenset[str]:
    """Heads (or tails) of bounded length and number; fewer letters each if they are too many."""
    length = LENGTH
    while True:
        out = frozenset(s[:length] if head else s[max(0, len(s) - length) :] for s in strings)
        if len(out) <= SET_SIZE or not length:
            return out
        length //= 2


def _cross(left: frozenset[str], right: frozenset[str]) -> frozenset[str]:
    return frozenset(a + b for a in left for b in right)


def _cat(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= SET_SIZE:
        whole = _cross(a.exact, b.exact)
        if max(map(len, whole), default=0) <= LENGTH:
            return _Known(whole, query=both(a.query, b.query))
    border = _cross(a.tails(), b.heads()) if len(a.tails()) * len(b.heads()) <= SET_SIZE * 4 else _EMPTY
    head, tail = a.head, b.tail
    if a.exact is not None:
        head = _short(_cross(a.exact, b.heads()) if len(a.exact) * len(b.heads()) <= SET_SIZE * 4 else a.exact, True)
    if b.exact is not None:
        tail = _short(_cross(a.tails(), b.exact) if len(a.tails()) * len(b.exact) <= SET_SIZE * 4 else b.exact, False)
    return _Known(None, head, tail, both(a.loose().query, b.loose().query, _grams(border)))


def _alt(known: list[_Known]) -> _Known:
    if all(k.exact is not None for k in known):
        whole = frozenset().union(*(k.exact for k in known))
        if len(whole) <= SET_SIZE:
            return _Known(whole, query=either(*(k.query for k in known)))
    known = [k.loose() for k in known]
    return _Known(None, _short(frozenset().union(*(k.head for k in known)), True), _short(frozenset().union(*(k.tail for k in known)), False), either(*(k.query for k in known)))


def _learn(node: Node, fold: bool) -> tuple[_Known, bool]:
    """Knowledge of a node, and whether case is ignored in what follows it."""
    if node.kind == "flags":
        on, _, off = node.flags.partition("-")
        return _Known(_EMPTY), (fold or "i" in on) and "i" not in off
    if node.kind == "lit":
        return _Known(variants(node.text) if node.fold or fold else frozenset(node.text)), fold
    if node.kind == "assert":
        return _Known(_EMPTY), fold
    if node.kind == "class" and node.members is not None:
        chars = frozenset().union(*map(variants, node.members)) if node.fold or fold else node.members
        return _Known(chars), fold
    if node.kind in ("class", "any"):
        return _Known(None), fold
    if node.kind == "group":
        on, _, off = node.flags.partition("-")
        return _learn(node.items[0], (fold or "i" in on) and "i" not in off)[0], fold
    if node.kind == "cat":
        out = _Known(_EMPTY)
        for n in node.items:
            k, fold = _learn(n, fold)
            out = _cat(out, k)
        return out, fold
    if node.kind == "alt":
        found = []
        for n in node.items:
            k, fold = _learn(n, fold)
            found.append(k)
        return _alt(found), fold
    inner, _ = _learn(node.items[0], fold)
    if node.low == 0:
        if node.high == 1:
            return _alt([inner, _Known(_EMPTY)]), fold
        return (_Known(_EMPTY) if node.high == 0 else _Known(None)), fold
    out = inner
    for _ in range(min(node.low, 6) - 1):
        out = _cat(out, inner)
    if node.low != node.high or node.low > 6:
        loose = out.loose()
        out = _Known(None, loose.head, _short(inner.loose().tail, False), loose.query)
    return out, fold


def for_pattern(pattern: str | Node, options: Options = Options()) -> Query:
    """The condition of a pattern; ``ALL`` where nothing is known or the pattern can't be parsed."""
    try:
        node = parse(pattern, options) if isinstance(pattern, str) else pattern
        known = _learn(node, options.ignore_case)[0].loose()
    except (PatternError, RecursionError):
        return ALL
    return both(known.query, _grams(known.head), _grams(known.tail))
