"""The trained language model: held-out texts, short and mixed ones, odd tables, and the check that uses it."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.config import CheckerConfig
from corpusloom.operators import get_checker
from corpusloom.operators import language_model as lm

DATA = "/root/testdata/sf0.1"


def test_trigrams():
    def told(text):
        return ["".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in lm.trigrams(text)]

    assert told("Aé, 1b") == [" aé", "aé ", "é b", " b "]
    assert told("日") == [" 日 "] and told("") == told("12 !") == []


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = lm.train(docs.where("doc_id % 5 <> 0"))
    assert model.langs == ["de", "en", "es", "fr"] and (np.diff(model.keys) > 0).all()
    rows = [(r.text, r.lang) for r in docs.where("doc_id % 5 = 0").collect()]
    for cut, least in ((None, 0.99), (80, 0.98), (40, 0.95)):  # whole texts, and short ones
        right, seen = Counter(), Counter()
        for text, lang in rows:
            seen[lang] += 1
            right[lang] += model.measure(text[:cut])[0] == lang
        assert all(right[x] >= least * seen[x] for x in seen), (cut, right, seen)
    by = {x: [t for t, lang in rows if lang == x and len(t) > 500] for x in model.langs}
    mixed = [model.measure(a[:240] + " " + b[:240])[0] for x, y in (("de", "en"), ("fr", "es"), ("en", "fr")) for a, b in zip(by[x], by[y])]
    assert sum(m is None for m in mixed) >= 0.7 * len(mixed) >= 20
    assert all(model.measure(t)[0] is None for t in ("", None, "12 34", "日本語の文章です。とても良い天気ですね。", "zzz qqq xxq"))
    config = CheckerConfig(languages=["en", "de"], language_model=model)
    some = docs.select(F.col("doc_id").alias("row_id"), "text", "lang").limit(300)
    told = get_checker("language")(config).check(some, "text", "row_id").stats["language"]
    other = some.where("lang in ('fr', 'es')").count()
    assert abs(told["non_target_count"] - other) <= 3 and told["checked_count"] >= 295


def test_odd_tables(spark):
    rows = [("ein haus", "de", 1), ("a house", "en", 2), (None, "en", 3), ("x", None, 4), ("", "fr", 5), ("ein haus", "de", 1)]
    df = spark.createDataFrame(rows, "text string, lang string, gram int")
    model = lm.train(df)
    assert model.langs == ["de", "en"]  # a language without a trigram is none
    assert model.measure("ein haus")[1:] == (0.0, 8, model.measure("ein haus")[3]) and model.measure("ein haus")[3] > 0  # too small a lead
    none = lm.train(df.limit(0))
    assert none.measure("ein haus") == (None, 0.0, 0, 0)
    got = df.select(none.predict(F.col("text")).alias("p")).collect()
    assert all(r.p.lang is None for r in got)
    alone = lm.train(df.where("lang = 'de'"))
    assert alone.measure("haus haus")[0] == "de" and alone.measure("qqq www")[0] is None
