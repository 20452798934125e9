"""URL rules found through their rarest literal token, with DataFrame functions only.

Host rules and pattern rules are regular expressions alike. An expression is read
as its alternatives; each has literal tokens (runs of a-z and 0-9) that every URL
it fits holds whole. The corpus tells how many URLs hold each token, and a rule is
filed under the rarest token of each of its alternatives. A URL's tokens fetch the
rules filed under them, and only those run their expression on it. A rule with an
alternative that has no token runs on every URL.
"""

from __future__ import annotations

import json
import re
import re._constants as sre
import re._parser as parser
import string
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules (short rows) the index is part of the plan; beyond, it is joined by a shuffle, a URL's rows in so many parts.
BROADCAST_RULES, SPLIT = 20_000, 16
#: Alternatives of a part of an expression that are told apart; what has more counts as unknown.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` decides; each fitting URL holds all ``tokens`` of one alternative; a larger ``weight`` wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[tuple[str, ...], ...]
    weight: int
    kind: str


def host_rule(verdict: str, rule: str) -> Rule:
    """Rule for a host with its subdomains and a path prefix, as in ``example.net/en/``."""
    host, slash, path = rule.partition("/")
    path = slash + path
    literal = "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in host)
    pattern = rf"^(?s:(?:(?!://).)*)://(?:[^/?#]*\.)?{literal}{re.escape(path)}" + ("" if path else "(?:[/?#]|$)")
    tokens = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(rule, verdict, pattern, (tuple(dict.fromkeys(tokens)),), len(rule), "host")


def pattern_rule(verdict: str, name: str, pattern: str) -> Rule:
    """Rule for a case-insensitive expression; its tokens are read off the expression."""
    return Rule(name, verdict, f"(?i){pattern}", literal_tokens(pattern), 0, "pattern")


#: In what an expression fits, beside single characters: any text, and an end of the URL.
_ANY, _END = "any", "end"


def _fits(items) -> list[tuple]:
    """The alternatives of a parsed expression, each as characters, sets of characters, _ANY and _END in a row."""
    out: list[tuple] = [()]
    for op, arg in items:
        one: list[tuple] = [(_ANY,)]
        if op is sre.LITERAL:
            one = [(chr(arg),)]
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            one = [(frozenset(chr(x) for _, x in arg),)]
        elif op is sre.AT and arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING):
            one = [(_END,)]
        elif op is sre.SUBPATTERN:
            one = _fits(arg[3])
        elif op is sre.BRANCH:
            one = [x for branch in arg[1] for x in _fits(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            if most == 1:
                one = _fits(inner) if least else [(), *_fits(inner)]
            elif least:
                one = [(*x, _ANY) for x in _fits(inner)]
        if len(out) * len(one) > ALTERNATIVES:
            one = [(_ANY,)]
        out = [(*x, *y) for x in out for y in one]
    return out


def literal_tokens(pattern: str) -> tuple[tuple[str, ...], ...]:
    """For each alternative of an expression, the tokens that stand whole in all it fits.

    A token is a run of single letters and digits between marks: other ASCII
    characters, sets of these, or an end of the URL.
    """

    def mark(x) -> bool:
        chars = x if isinstance(x, frozenset) else {x} if len(x) == 1 else set()
        return x is _END or bool(chars) and all(c.isascii() and not c.isalnum() for c in chars)

    def tokens(row: tuple) -> tuple[str, ...]:
        found, run, open_ = [], "", False
        for x in (*row, _ANY):
            if isinstance(x, str) and len(x) == 1 and x.isascii() and x.isalnum():
                run += x.lower()
                continue
            if mark(x) and open_ and run:
                found.append(run)
            run, open_ = "", mark(x)
        return tuple(dict.fromkeys(found))

    try:
        return tuple(dict.fromkeys(map(tokens, _fits(parser.parse(pattern)))))
    except re.error:  # an expression that only the engine reads
        return ((),)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def rarest(urls: DataFrame, rules: list[Rule]) -> dict[Rule, tuple[str, ...]]:
    """Under which tokens each rule is filed: of each alternative the one that fewest URLs hold; none for a rule that runs on all.

    Counts cover all rows of ``urls`` (column url); null URLs hold none, repeated ones count each,
    and of equally rare tokens the smaller one is taken, of an empty table too.
    """
    wanted = sorted({t for r in rules for row in r.tokens for t in row})
    if not wanted:
        return dict.fromkeys(rules, ())
    known = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    held = urls.select(F.explode(_tokens(F.col("url"))).alias("token"))
    counts = held.join(F.broadcast(known) if len(wanted) <= BROADCAST_RULES else known, "token").groupBy("token").count()
    count = {r["token"]: r["count"] for r in counts.collect()}  # a row for each token of the rules at most
    rare = lambda row: min(row, key=lambda t: (count.get(t, 0), t))
    return {r: tuple(dict.fromkeys(map(rare, r.tokens))) if r.tokens and all(r.tokens) else () for r in rules}


def _index(filed: dict[Rule, tuple[str, ...]], place: dict[int, int]) -> tuple[Column, int]:
    """The filed rules as one constant, in buckets by the hash of their token, and the number of buckets."""
    size = 1 << max(4, (2 * sum(map(len, filed.values()))).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for i, (rule, tokens) in enumerate(filed.items()):
        for token in tokens:
            buckets[zlib.crc32(token.encode()) % size].append({"token": token, "place": place[i], "pattern": rule.pattern})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<token:string,place:int,pattern:string>>>"), size


def judge(df: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and pattern of every row.

    The longest fitting host rule gives rule and verdict. Without one, rule is
    null, pattern names the first fitting blocking pattern and the verdict is
    ``block`` where there is one, else ``default``. Null and malformed URLs have
    empty host and path. Rows stay as often as they stand; other columns are not read.
    Up to BROADCAST_RULES rules the index goes along with the plan and a row is judged
    by itself, without a shuffle; beyond, rows meet the rules in a join by token.
    """
    pages = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    filed = rarest(pages.filter("url is not null"), rules)
    order = list(filed)
    ranked = sorted(range(len(order)), key=lambda i: (order[i].kind != "host", -order[i].weight, i))
    place = {i: k for k, i in enumerate(ranked)}
    always = [F.when(F.col("url").rlike(order[i].pattern), F.lit(place[i])) for i, tokens in enumerate(filed.values()) if not tokens]
    if len(order) <= BROADCAST_RULES:
        index, size = _index(filed, place)
        at = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int")
        fetched = F.flatten(F.transform(_tokens(F.col("url")), lambda t: F.filter(F.get(index, at(t)), lambda r: r["token"] == t)))
        hit = F.array_min(F.transform(F.filter(fetched, lambda r: F.regexp_like(F.col("url"), r["pattern"])), lambda r: r["place"]))
        found = pages.withColumn("place", hit)
        named = F.from_json(F.lit(json.dumps([{"kind": order[i].kind, "name": order[i].name, "said": order[i].verdict} for i in ranked])), "array<struct<kind:string,name:string,said:string>>")
        told = found.withColumn("best", F.get(named, _least(len(order), [*always, F.col("place")])))
    else:
        told = _joined(pages, filed, place, always)
    host, path = split_url(F.col("url"))
    return told.select(
        "page_id", host.alias("host"), path.alias("path"),
        F.when(F.col("best.kind") == "host", F.col("best.name")).alias("rule"),
        F.coalesce("best.said", F.lit(default)).alias("verdict"),
        F.when(F.col("best.kind") == "pattern", F.col("best.name")).alias("pattern"),
    )


def _least(none: int, places: list[Column]) -> Column:
    return F.least(F.lit(none), F.lit(none), *places)


def _joined(pages: DataFrame, filed: dict[Rule, tuple[str, ...]], place: dict[int, int], always: list[Column]) -> DataFrame:
    """``pages`` with ``best`` (kind, name, said), for more rules than a plan should hold.

    Every distinct URL is judged once; a URL of many rows meets its verdict in SPLIT
    parts, and rows without one in none.
    """
    spark = pages.sparkSession
    rules = [(list(t), place[i], r.pattern, r.kind, r.name, r.verdict) for i, (r, t) in enumerate(filed.items())]
    table = spark.createDataFrame(rules, "tokens array<string>, place int, pattern string, kind string, name string, said string")
    urls = pages.filter("url is not null").select("url").distinct()
    hits = urls.select("url", F.explode(_tokens(F.col("url"))).alias("token")).join(table.select(F.explode("tokens").alias("token"), "place", "pattern"), "token").filter("url rlike pattern").select("url", "place")
    if always:
        hits = hits.unionByName(urls.select("url", _least(len(filed), always).alias("place")).filter(F.col("place") < len(filed)))
    best = hits.groupBy("url").agg(F.min("place").alias("place")).join(table.select("place", F.struct("kind", "name", "said").alias("best")), "place")
    best = best.select("url", "best", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("part"))
    part = F.pmod(F.xxhash64("page_id"), F.lit(SPLIT)).cast("int")
    some = pages.filter("url is not null").withColumn("part", part).join(best, ["url", "part"], "left")
    none = pages.filter("url is null").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return some.select("page_id", "url", "best").unionByName(none)
