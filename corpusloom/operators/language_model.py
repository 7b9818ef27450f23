"""A language model counted from labelled texts: character trigrams, integer weights, an unknown class.

A text is lower-cased, every run of other characters than letters becomes one
blank, and there is a blank at either end.  Spark counts trigrams by language: a
task adds up its own, then a partially aggregated sum.  Of each language the
``KEPT`` most frequent trigrams are kept, so the model is bounded, whatever the
corpus: sorted keys, and a weight for each key and language, round(1000 * ln of
the smoothed share).  A text's score in a language is the sum of the weights of
its known trigrams.

A text has no language where it has fewer than ``LEAST`` known trigrams, where
most of its trigrams are unknown, or where the best language leads the second by
less than ``MARGIN`` thousandths for each known trigram, as mixed texts do.

Defined cases: null texts and texts without letters have no language; null
languages are not learned; ties between languages go to the lesser name (and
have no lead, so no language is told); ties between trigrams at the bound go to
the lesser; of more than ``LANGUAGES`` languages those with most trigrams are
kept; an empty table gives a model that knows none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.session import ship_package

GRAM = 3
KEPT = 8_000
LANGUAGES = 64
LEAST = 3
MARGIN = 800
#: Known trigrams that a score between 0 and 1 rests on at most.
EVIDENCE = 20
_BITS = np.uint64(21)
_BLANK = 32


class _Letters:
    """Whether each code point is a letter; made once in a process."""

    @cached_property
    def flags(self) -> np.ndarray:
        return np.array([chr(c).isalpha() for c in range(0x110000)])


_LETTERS = _Letters()


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text as numbers, in their order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_LETTERS.flags[points], points, _BLANK)
    points = np.concatenate([[_BLANK], points, [_BLANK]])
    blank = points == _BLANK
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)
    if len(points) < GRAM:
        return np.zeros(0, dtype=np.int64)
    return ((points[:-2] << _BITS | points[1:-1]) << _BITS | points[2:]).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(lang, []).append(trigrams(text))
        for lang, grams in found.items():
            g, n = np.unique(np.concatenate(grams), return_counts=True)
            if lang in total:
                old, m = total[lang]
                g, at = np.unique(np.concatenate([old, g]), return_inverse=True)
                n = np.bincount(at.ravel(), np.concatenate([m, n])).astype(np.int64)
            total[lang] = g, n
    for lang, (g, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), type=pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])


class LanguageModel:
    """Sorted trigrams, and weights by trigram and language."""

    def __init__(self, langs: list[str], keys: np.ndarray, weights: np.ndarray) -> None:
        self.langs, self.keys, self.weights = langs, keys, weights

    def measure(self, text: str | None) -> tuple[str | None, float, int, int]:
        """Language, score, known trigrams, and the lead of the best language over the second."""
        grams = trigrams(text) if text else np.zeros(0, dtype=np.int64)
        if not len(self.keys) or not len(grams):
            return None, 0.0, 0, 0
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        at = at[self.keys[at] == grams]
        known = len(at)
        sums = self.weights[at].sum(axis=0, dtype=np.int64)
        order = np.lexsort((np.arange(len(sums)), -sums))  # names are sorted
        lead = int(sums[order[0]] - sums[order[1]]) if len(sums) > 1 else MARGIN * known
        if known < LEAST or 2 * known < len(grams) or lead < MARGIN * known:
            return None, 0.0, known, lead
        mean = (sums - sums[order[0]]) / (1000 * known) * min(known, EVIDENCE)
        return self.langs[order[0]], float(1 / np.exp(mean).sum()), known, lead

    def predict(self, text: Column) -> Column:
        """Column struct<lang, score, known, lead>; null text has a null language."""

        def run(texts: pa.Array) -> pa.Array:
            got = [self.measure(t) for t in texts.to_pylist()]
            kinds = {"lang": pa.string(), "score": pa.float64(), "known": pa.int64(), "lead": pa.int64()}
            return pa.StructArray.from_arrays([pa.array([g[i] for g in got], type=t) for i, t in enumerate(kinds.values())], names=list(kinds))

        return F.arrow_udf(run, "struct<lang:string,score:double,known:bigint,lead:bigint>")(text)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", kept: int = KEPT, languages: int = LANGUAGES) -> LanguageModel:
    """The model of a table of texts with their languages."""
    ship_package(df.sparkSession)
    rows = df.select(df[text_col].alias("text"), df[lang_col].alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Ranks up to a bound are limited in each task before the shuffle; the sum runs over all trigrams of a language.
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("size")).orderBy(F.col("size").desc(), "lang").limit(languages)
    sizes = {r["lang"]: r["size"] for r in sizes.collect()}  # at most ``languages`` rows
    mine = counts.where(F.col("lang").isin(list(sizes))).withColumn("rank", best).where(F.col("rank") <= kept)
    got = mine.select("lang", "gram", "n").toArrow()  # at most ``languages * kept`` rows
    langs = sorted(sizes)
    keys = np.unique(got["gram"].to_numpy())
    whole = np.array([sizes[x] + len(keys) for x in langs], dtype=np.float64)
    count = np.zeros((len(keys), len(langs)))
    lang_at = {x: i for i, x in enumerate(langs)}
    count[np.searchsorted(keys, got["gram"].to_numpy()), [lang_at[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    weights = np.rint(1000 * np.log((count + 1) / whole)) if len(keys) else count
    return LanguageModel(langs, keys, weights.astype(np.int16))
