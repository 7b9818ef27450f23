"""The first of many regular expressions that a text matches, at the cost of one scan.

Of each expression a literal is found that every match must hold; one automaton
looks for all these literals at once, and an expression is tried only on texts
that hold its literal.  Expressions without one of ``LEAST`` characters are tried
on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from re import _casefix, _constants, _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 3
#: Letters that match another one when case is ignored, though neither's lower case is the other.
_SAME = {other: code for code, others in _casefix._EXTRA_CASES.items() for other in others if code < other}


def folded(text: str) -> str:
    """A text of which letters that match each other when case is ignored are one; never splits or joins others."""
    return text.replace("\u0130", "i").lower().translate(_SAME)


def _sequences(parsed: Iterable) -> tuple[list[str], bool]:
    """Literal runs that every match of a parsed expression holds, and whether the expression is one such run alone."""
    runs, now, alone = [], "", True

    def cut() -> None:
        nonlocal now, alone
        runs.append(now)
        now, alone = "", False

    for op, value in parsed:
        if op is _constants.LITERAL:
            now += chr(value)
        elif op is _constants.SUBPATTERN:
            inner, one = _sequences(value[-1])
            if one:
                now += inner[0]
            else:
                cut()
                runs += inner
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner, one = _sequences(value[2])
            now += inner[0] if one else ""
            cut()
            runs += inner
        elif op is _constants.ATOMIC_GROUP:
            cut()
            runs += _sequences(value)[0]
        elif op is not _constants.AT:  # anchors take no characters
            cut()
    return [*runs, now], alone


def required_literal(pattern: str) -> str:
    """The longest folded literal that every match of an expression holds; empty if none is sure."""
    return max(map(folded, _sequences(_parser.parse(pattern))[0]), key=len, default="")


class Matcher:
    """Tells the first of some expressions, in their order, that a text matches."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self.patterns = list(patterns)
        self.compiled = [re.compile(p) for p in self.patterns]
        self.always: list[int] = []
        self.automaton = ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for i, p in enumerate(self.patterns):
            literal = required_literal(p)
            if len(literal) >= LEAST:
                of.setdefault(literal, []).append(i)
            else:
                self.always.append(i)
        for literal, own in of.items():
            self.automaton.add_word(literal, own)
        if of:
            self.automaton.make_automaton()

    def first(self, text: str) -> str | None:
        held = set(self.always)
        if len(self.automaton):
            seen = set()
            for _, own in self.automaton.iter(folded(text)):
                if own[0] not in seen:
                    seen.add(own[0])
                    held.update(own)
        return next((self.patterns[i] for i in sorted(held) if self.compiled[i].search(text)), None)


@lru_cache(maxsize=4)
def _matcher(patterns: tuple[str, ...]) -> Matcher:
    return Matcher(patterns)


def first_match(text: Column, patterns: Iterable[str]) -> Column:
    """The first of the expressions, in Python's dialect, that a text matches; null if none."""
    patterns = tuple(patterns)
    _matcher(patterns)  # a bad expression raises here

    def run(texts: pa.Array) -> pa.Array:
        matcher = _matcher(patterns)
        return pa.array([None if t is None else matcher.first(t) for t in texts.to_pylist()], type=pa.string())

    return F.arrow_udf(run, "string")(text)
