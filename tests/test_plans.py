"""Patterns and trigram conditions, without Spark."""

import random
import re

import pytest

from siftline.plans.query import ALL, Query, both, either, for_pattern, of_literal, pack
from siftline.plans.regex import Options, PatternError, escape, join, parse, required_literal, to_java

#: Syllables that patterns are made of; some share letters, one is not ASCII, two hold marks.
SYLLABLES = ["ko", "kol", "ola", "lär", "r-r", "n3", "3n3", "o", "  ", "KO", "Lä"]
ATOMS = [(".", "x"), (r"\d", "7"), (r"\S", "k"), ("[kl]", "l"), ("[^k]", "o"), (r"\b", ""), ("[0-9a-c]", "b"), ("(?:)", "")]


class Grown:
    """Pairs of a pattern and a text that it fits, grown together."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pair(self, size: int) -> tuple[str, str]:
        """The text follows the pattern's left branches and fewest repeats as chance wills."""
        r = self.r
        if size <= 1:
            if r.random() < 0.25:
                return r.choice(ATOMS)
            s = r.choice(SYLLABLES)
            return re.escape(s), s
        cut = r.randint(1, size - 1)
        (p, s), (q, t) = self.pair(cut), self.pair(size - cut)
        shape = r.choice("cccaago*+r")
        if shape == "c":
            return p + q, s + t
        if shape == "a":
            return f"(?:{p}|{q})", r.choice((s, t))
        if shape == "g":
            return f"({p}){q}", s + t
        if shape == "o":
            return f"(?:{p})?{q}", r.choice((s, "")) + t
        if shape == "*":
            return f"(?:{p})*{q}", s * r.randint(0, 2) + t
        if shape == "+":
            return f"(?:{p})+?{q}", s * r.randint(1, 3) + t
        low = r.randint(1, 3)
        return f"(?:{p}){{{low},{low + 2}}}{q}", s * r.randint(low, low + 2) + t

    def noise(self) -> str:
        return "".join(self.r.choice(SYLLABLES + ["\t", "é", ".", "x"]) for _ in range(self.r.randint(0, 6)))


@pytest.mark.parametrize("seed", range(6))
def test_a_text_with_a_match_fulfils_the_condition(seed):
    grown, met, narrow = Grown(seed), 0, 0
    for _ in range(500):
        pattern, text = grown.pair(grown.r.randint(1, 7))
        fold = grown.r.random() < 0.3
        condition = for_pattern(pattern, Options(ignore_case=fold))
        needed = required_literal(parse(pattern))
        narrow += not condition.is_all
        for told in (text, grown.noise() + text + grown.noise(), text.swapcase(), grown.noise()):
            m = re.search(pattern, told, re.IGNORECASE if fold else 0)
            if m:
                met += 1
                assert condition.accepts(set(of_literal(told))), (pattern, told)
                assert fold or needed in m[0], (pattern, needed)
    assert met > 900 and narrow > 100


@pytest.mark.parametrize("pattern", ["qu", ".", r"\S+", "(?:river)*", "stone||lake", "", "[x", "(?<=a)b"])
def test_nothing_is_known_of_some_patterns(pattern):
    assert for_pattern(pattern).is_all


def test_conditions_of_known_patterns():
    assert for_pattern("oak7") == Query("and", items=(Query("tri", pack(111, 97, 107)), Query("tri", pack(97, 107, 55))))
    assert for_pattern("river|stone|lake").kind == "or"
    assert not for_pattern(r".*brook.*").is_all  # an inner literal narrows too
    assert not for_pattern("(?i)meadow").is_all
    assert for_pattern("€").kind == "tri"


def test_algebra():
    a, b = Query("tri", 1), Query("tri", 2)
    assert both(ALL, a) == a and both() == ALL and both(a, a) == a
    assert either(a, ALL) == ALL and either() == ALL and either(a, b).items == (a, b)
    assert of_literal("qz") == [] and of_literal("zzzz") == [pack(122, 122, 122)] * 2


def test_join_and_escape():
    assert join(["q"]) == "q" and join(["q|r", "s"]) == "(?:q|r)|(?:s)"
    assert re.fullmatch(escape("1+1=[2]? {x}"), "1+1=[2]? {x}")
    assert join(["q.r", "s"], fixed=True) == r"(?:q\.r)|(?:s)"


@pytest.mark.parametrize("pattern", ["q(", ")q", "[q", "q{3,2}", r"(q)\1", "(?=q)", "(?<!q)r", r"\y", "q**{", "+q", "[[:odd:]]", r"(?P<9q>x)", "[q--r]", "(?x)q"])
def test_refused(pattern):
    with pytest.raises(PatternError):
        parse(pattern)


CASES = [
    ("(?P<day>[0-9]+)[.]", "on 24.", True), ("[[:alpha:]]+;", "ö;", False), ("[[:alpha:]]+;", "o;", True), (r"^\w$", "ñ", True), (r"(?i)GRÜN", "grün", True),
    (r"(?i)s", "ſ", True), ("q.r", "q\rr", True), ("q.r", "q\nr", False), (r"\x{71}r", "qr", True), (r"q\.r", "qxr", False), ("[]q]", "]", True), (r"[\d-]+!", "1-2!", True),
    (r"\bden\b", "in den.", True), (r"\b{start}en", "den", False), ("q{2}", "qq", True), ("(?-i)q", "Q", False), (r"\p{Cyrillic}", "ж", True), (r"\pN", "٣", True), ("q#r", "q#r", True), ("q&&r", "q&&r", True),
]


@pytest.mark.parametrize(("pattern", "text", "fits"), CASES)
def test_java_translation(spark, pattern, text, fits):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(to_java(pattern)))
    assert row.first()[0] is fits
