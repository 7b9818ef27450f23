"""Scalar functions as column builders; all stay inside the JVM, but for the offsets of matches."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def strip(text: Column) -> Column:
    """Text without white space at either end, any Unicode white space."""
    return F.regexp_replace(text, P.STRIP, "")


def is_blank(text: Column) -> Column:
    """Whether a text is white space alone; told at the first other character."""
    return ~text.rlike(f"[^{P.SPACE}]")


def is_missing(text: Column) -> Column:
    return F.coalesce(is_blank(text), F.lit(True))


def count_html_tags(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.HTML_TAG))


def count_control_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.CONTROL))


def has_excessive_whitespace(text: Column) -> Column:
    return text.rlike(P.LONG_BLANKS) | text.rlike(P.LONG_BREAKS)


def _density(text: Column, pattern: str, needed: tuple[str, ...]) -> Column:
    """Share of characters that belong to matches; each match holds one of the ``needed`` strings."""
    n = F.length(text)
    none = reduce(Column.__and__, [~F.contains(text, F.lit(x)) for x in needed])
    return F.when((n == 0) | none, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(text, pattern, ""))) / n)


def url_density(text: Column) -> Column:
    """Share of a text's characters that belong to URLs."""
    return _density(text, P.URL, ("://", "www."))


def email_density(text: Column) -> Column:
    """Share of a text's characters that belong to e-mail addresses."""
    return _density(text, P.EMAIL, ("@",))


def sha256_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _may_match(text: Column) -> dict[str, Column]:
    """For each kind of personal data a cheap test that every text with a match passes.

    One scan leaves only a text's runs of digits, a blank between them; most
    texts have few, so the tests on what is left cost next to nothing.
    """
    digits = F.regexp_replace(text, P.NOT_DIGITS, " ")
    return {k: F.contains(text, F.lit("@")) if k == "email" else digits.rlike(P.PII_DIGITS[k]) for k in P.PII}


def pii_counts(text: Column) -> dict[str, Column]:
    """Matches of each kind of personal data; an expression is tried only where its cheap test passes."""
    may = _may_match(text)
    return {k: F.when(~may[k], F.lit(0)).otherwise(F.regexp_count(text, F.lit(p))) for k, p in P.PII.items()}


def has_pii(text: Column) -> Column:
    """Whether there is a match of any kind; never null."""
    may = _may_match(text)
    found = reduce(Column.__or__, [may[k] & text.rlike(p) for k, p in P.PII.items()])
    return F.coalesce(found, F.lit(False))


def _once(value: Column, function) -> Column:  # noqa: ANN001
    """``function(value)`` with the value computed once: inside a lambda an expression is computed at each step."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _starts(between: Column, values: Column) -> Column:
    """Where each match starts, from the lengths of what lies between matches and of the matches: running sums."""

    def run(between: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for gaps, own in zip(between, values):
            if own.as_py() is None:
                out.append(None)
                continue
            gaps, own = np.asarray(gaps.values), np.asarray(own.values)
            out.append(np.cumsum(gaps[: len(own)]) + np.cumsum(own) - own)
        return pa.array(out, type=pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(between, values)


def _matches_of(text: Column, kind: str, pattern: str, may: Column) -> Column:
    """array<struct<pii_type, value, start, end>> of one kind.

    Splitting keeps the text between matches, so running sums of lengths give
    the offsets; the work is linear in the text and its matches.
    """
    values = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    lengths = F.transform(F.when(F.size(values) > 0, values), F.length)
    gaps = F.transform(F.when(F.size(values) > 0, F.split(text, pattern, -1)), F.length)

    def one(value: Column, start: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("pii_type"), value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end")
        )

    empty = F.array().cast("array<struct<pii_type:string,value:string,start:int,end:int>>")
    return F.coalesce(F.zip_with(F.when(F.size(values) > 0, values), _starts(gaps, lengths), one), empty)


def detect_pii(text: Column) -> Column:
    """All matches, kind by kind in the fixed order: array<struct<pii_type, value, start, end>>."""
    may = _may_match(text)
    return F.concat(*[_matches_of(text, k, p, may[k]) for k, p in P.PII.items()])


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), rf"[{P.SPACE}]+"), lambda w: w != "")


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of ``k`` words; a shorter text is one run; no words, no runs."""

    def runs(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        none = F.array().cast("array<string>")
        short = F.when(F.size(w) == 0, none).when(F.size(w) < k, F.array(F.array_join(w, " ")))
        return short.otherwise(F.array_distinct(long))

    return _once(words(text), runs)
