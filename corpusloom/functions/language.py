"""Language guesses without a model file: scripts, then function words."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent function words of languages in Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem als auch es an werden aus er hat dass",
    "fr": "le la les de des et un une est en que qui dans pour pas du au sur avec ce il elle par plus ne se sont mais ou",
    "es": "el la los las de que y en un una es se no por con para del al su lo como más pero sus le ya este porque esta",
    "it": "il lo la gli di che e è un una in per non con del della sono da si come anche più ma le dei nel alla questo",
    "pt": "o a os as de que e do da em um uma para com não por mais dos das como mas ao ele se na no são foi também",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als bij door naar maar dan zou wat uit",
}
_OF_WORD: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _OF_WORD.setdefault(_w, []).append(_lang)
_SCRIPTS = [
    ("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯ᄀ-ᇿ]")), ("zh", re.compile("[一-鿿]")),
    ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽ]")),
    ("he", re.compile("[֐-׿]")), ("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")),
]
_WORD = re.compile(r"[^\W\d_]+")


def detect(text: str) -> tuple[str | None, float]:
    """Likeliest language and a score between 0 and 1; (None, 0) where nothing tells."""
    letters = sum(map(len, _WORD.findall(text)))
    if not letters:
        return None, 0.0
    counts = {lang: len(p.findall(text)) for lang, p in _SCRIPTS}
    if counts["ja"] and counts["zh"]:
        counts["ja"] += counts["zh"]
        counts["zh"] = 0
    best = max(counts, key=counts.get)
    if counts[best] > 0.3 * letters:
        return best, min(1.0, counts[best] / letters)
    votes: Counter[str] = Counter()
    for w in _WORD.findall(text.lower()):
        langs = _OF_WORD.get(w)
        if langs:
            for lang in langs:
                votes[lang] += 1 / len(langs)
    if not votes:
        return None, 0.0
    lang, n = max(votes.items(), key=lambda x: (x[1], x[0]))
    return lang, n / sum(votes.values())


def predict(text: Column) -> Column:
    """Column struct<lang, score>; null text has a null language, and so has one that the detector fails on."""

    def told(text: str | None) -> tuple[str | None, float]:
        try:
            return detect(text) if text else (None, 0.0)
        except Exception:  # noqa: BLE001  one bad row leaves the others alone
            return None, 0.0

    def run(texts: pa.Array) -> pa.Array:
        got = [told(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.float64())],
            names=["lang", "score"],
        )

    return F.arrow_udf(run, "struct<lang:string,score:double>")(text)
