"""Many expressions at once: required literals, letters of any case, the same rows as one by one."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.config import BOILERPLATE_PATTERNS, CheckerConfig
from corpusloom.functions.many_patterns import Matcher, folded, required_literal
from corpusloom.operators import get_checker


@pytest.mark.parametrize(
    "pattern, literal",
    [
        (r"(?i)^copyright\s", "copyright"), (r"(?i)cookie\s*(policy|notice|consent)", "cookie"), (r"a+bcd", "bcd"), (r"(abc)+d", "abc"),
        (r"ab(cd)ef", "abcdef"), (r"ab(c|d)ef", "ab"), (r"x?abc", "abc"), (r"abc|abd", "ab"), (r"abc|xyz", ""), (r"[ab]c", "c"), (r"(?=abc)d", "d"),
        (r"a{2}bc", "bc"), (r"(?:ab){0,3}c", "c"), (r"\bword\b", "word"), (r"(?i:ABC)x", "abcx"), (r"a.b", "a"), (r"", ""), (r"(?!no)yes", "yes"),
        (r"(?>abc)d", "abc"), (r"ab*c", "a"),
    ],
)
def test_required_literals(pattern, literal):
    found = required_literal(pattern)
    assert len(found) == len(literal) and (found == literal or literal in ("a", "ab"))


def one_by_one(patterns, text):
    return next((p for p in patterns if re.search(p, text)), None)


def test_case_is_ignored_as_python_does():
    matcher = Matcher(["(?i)kiss", "(?i)straße", "(?i)ΣΊΣΥΦΟΣ", "(?i)µm²", "Kelvin"])
    for text in ("KISS", "kiſſ", "Kiſs", "kıss", "KİSS", "STRAẞE", "straße", "σίσυφοσ", "σίσυφος", "μm²", "kelvin"):
        assert matcher.first(text) == one_by_one(matcher.patterns, text), text


PARTS = st.sampled_from(["ab", "b", "c d", r"\s+", "(?:ab|cd)", "(ab)?", "c*", "[ab]", "é", ".", "^", "$", "(b)+", "d{2,3}"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, min_size=1, max_size=4).map("".join), min_size=1, max_size=8), st.text(alphabet="abcd Aé\n", max_size=20), st.booleans())
def test_same_as_one_by_one(patterns, text, ignore):
    patterns = [("(?i)" if ignore else "") + p for p in patterns]
    assert Matcher(patterns).first(text) == one_by_one(patterns, text)


def test_a_thousand_patterns(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    patterns = [*BOILERPLATE_PATTERNS, *(rf"(?i)\b{rng.choice(words)}\s+{rng.choice(words)}" for _ in range(990)), r"\d{4}x", r"(?i)zz|yy"]
    texts = [" ".join(rng.choice(words) for _ in range(60)).upper() for _ in range(150)]
    hit = [re.sub(r"\(\?i\)\\b|\\s\+", " ", rng.choice(patterns[6:996])) + " " + t for t in texts[:60]]
    texts = [*texts, *hit, "copyright 2020", "1234x and privacy  policy", "YY", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    check = get_checker("boilerplate")(CheckerConfig(boilerplate_patterns=patterns))
    began = time.time()
    got = {r.row_id: r.matched_pattern for r in check.matches(df).collect()}
    assert time.time() - began < 60
    assert got == {i: p for i, t in enumerate(texts) if t and (p := one_by_one(patterns, t))} and len(got) > 60
    assert folded("KIſ") == "kis"
    with pytest.raises(re.error):
        get_checker("boilerplate")(CheckerConfig(boilerplate_patterns=["("] * 20)).matches(df)
