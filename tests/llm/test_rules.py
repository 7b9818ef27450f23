"""Quality rules: base statistics by brute force, the model against its definition, bands on labels."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import rules

DATA = "/root/testdata/sf0.1"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n#\xa0\x1c\x0b", max_size=120)))
def test_base_statistics(text):
    assert rules.base_rules(text) == brute(text)


def test_model_is_a_distribution():
    text = "the cat sat on the mat and the dog sat on the cat " * 3
    g, c = np.unique(np.concatenate(list(rules.grams(rules.symbols(text)))), return_counts=True)
    tables = rules.kneser_ney(g, c)
    slots = np.concatenate([rules.slot(k, n, 5, x) for (k, n), (x, _) in tables.items()])
    assert len(set(slots.tolist())) == len(slots)
    lm = rules.HashModel(slots, np.concatenate([v for _, v in tables.values()]))
    for context in ("the", "cat", "zzz", "t q"):
        s = rules.symbols(context)[-3:].astype(np.int64)
        whole = ((s[0] * 64 + s[1]) * 64 + s[2]) * 64 + np.arange(64)
        assert abs(np.exp(lm.log_p(whole, 5)).sum() - 1) < 1e-3
    assert lm.log_perplexity("the cat sat", 5) < lm.log_perplexity("zqx wvk jjj", 5)
    assert lm.log_perplexity("", 5) == 0


def test_counts_cover_whole_texts(spark, monkeypatch):
    texts = ["abc" * 20, None, "", "héé ß " * 9, "abc" * 20]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, model int")
    got = {(r.model, r.gram): r.n for r in rules.count_grams(df).collect()}
    want = Counter()
    for i, t in enumerate(texts):
        s = [29] * 3 + rules.symbols(t or "")[3:].tolist()
        for a, b, c, d in zip(s, s[1:], s[2:], s[3:]):
            want[i % 2, ((a * 64 + b) * 64 + c) * 64 + d] += 1
    assert got == dict(want)


def test_documents(spark):
    rows = {r.doc_id: r for r in rules.op8_quality_rules(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs[::20]:
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(d.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [x.doc_id for x in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()]
    clean = [rows[i] for i in good if not rows[i].base_failed]
    assert np.mean([r.kept for r in clean]) >= 0.99


@pytest.mark.parametrize("rows", [[], [(1, None, None), (1, None, None), (2, "", "en"), (3, "a b " * 30_000, "xx")]])
def test_edge_tables(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, id int, log_ppl double")
    got = rules.apply_rules(df).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    assert all(r.base_failed and not r.kept for r in got)


def test_letters_beyond_latin_are_told_apart(spark):
    rng = np.random.default_rng(4)
    words = ["".join(chr(0x430 + c) for c in rng.integers(0, 32, rng.integers(3, 9))) for _ in range(60)]
    text = [" ".join(rng.choice(words, 120)) for _ in range(60)]
    # Letters of the same residue modulo six, drawn anew at each place.
    junk = ["".join(c if c == " " else chr(0x430 + (ord(c) - 0x430 + 6 * int(rng.integers(5))) % 30) for c in t) for t in text[:3]]
    rows = [(i, t, "ru") for i, t in enumerate(text + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.log_ppl for r in rules.apply_rules(df).collect()}
    assert min(got[60 + i] for i in range(3)) > 1.2 * max(got[i] for i in range(60))


def test_each_language_has_its_model(spark):
    rng = np.random.default_rng(6)  # crc32 of "pt" and "hi" is the same modulo 64
    texts = [" ".join(rng.choice([f"{x}{y}{z}" for x in "bcd" for y in "aei" for z in "lmn"], 100)) for _ in range(20)]
    rows = [(i, t, "pt") for i, t in enumerate(texts)]
    more = [(100 + i, "".join(rng.choice(list("fghjkopqrstuvwxyz "), 400)) + " x" * 20, "hi") for i in range(20)]
    schema = "doc_id long, text string, lang string"
    alone = {r.doc_id: r.log_ppl for r in rules.apply_rules(spark.createDataFrame(rows, schema)).collect()}
    both = {r.doc_id: r.log_ppl for r in rules.apply_rules(spark.createDataFrame(rows + more, schema)).collect()}
    assert all(abs(both[i] - alone[i]) < 1e-6 for i in alone)


def test_planted_junk_that_passes_the_base_rules_is_rejected(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeilmnorstu"), rng.integers(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 150))) for i in range(400)]
    signs = list("#*$%&|<>qxzjvk0123456789")
    rows += [(400 + i, " ".join("".join(rng.choice(signs, 6)) for _ in range(120))) for i in range(80)]  # a sixth
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = rules.apply_rules(df).collect()
    assert not any(r.base_failed for r in got)
    assert not any(r.kept for r in got if r.doc_id >= 400)
    assert np.mean([r.kept for r in got if r.doc_id < 400]) >= 0.98


def units(text):
    raw = ("\n\n\n" + text).encode("utf-16-le", "surrogatepass")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


def brute_model(texts):
    """Mean negative log-probability of each text by modified Kneser-Ney, n-gram by n-gram."""
    import math

    counts = {4: Counter()}
    for t in texts:
        u = units(t)
        counts[4].update(tuple(u[i : i + 4]) for i in range(len(u) - 3))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p, back = {}, {}
    for n in (1, 2, 3, 4):
        of = Counter(counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = [min(max(k - (k + 1) * y * of[k + 1] / of[k], 0), k) if of[k] else k / 2 for k in (1, 2, 3)]
        total, freed = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        back |= {x: max(freed[x] / total[x], 1e-9) for x in total}
        for g, c in counts[n].items():
            p[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * (p[g[1:]] if n > 1 else 2**-16)

    def log_p(g):
        if g in p:
            return math.log(p[g])
        return math.log(back.get(g[:-1], 1)) + (log_p(g[1:]) if len(g) > 1 else -16 * math.log(2))

    out = []
    for t in texts:
        u = units(t)
        n = len(u) - 3
        out.append(-sum(log_p(tuple(u[i : i + 4])) for i in range(n)) / max(1, n))
    return out


def test_verdicts_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in rules.op8_quality_rules(spark, data).collect()}
    kept = 0
    for lang in {d.lang for d in docs}:
        own = [d for d in docs if d.lang == lang]
        ppl = dict(zip((d.doc_id for d in own), brute_model([d.text for d in own])))
        assert all(abs(got[i].log_ppl - x) < 1e-4 for i, x in ppl.items())
        base = {d.doc_id: brute(d.text) for d in own}
        failed = {i: b[0] < 20 or 100 * b[4] > 30 * b[0] for i, b in base.items()}
        passed = sorted(x for i, x in ppl.items() if not failed[i])
        low, mid, high = (passed[-(-len(passed) * k // 4) - 1] for k in (1, 2, 3))
        low, high = mid - rules.WIDTH * max(mid - low, 0.01), mid + rules.WIDTH * max(high - mid, 0.01)
        for i, x in ppl.items():
            if min(abs(x - low), abs(x - high)) > 1e-3:
                assert got[i].kept == (not failed[i] and low <= x <= high)
                kept += got[i].kept
    assert 0 < kept < len(docs)


def test_model_of_joins_equals_the_one_in_memory(spark):
    """Grouped sums and joins give each entry that one task over all n-grams would give."""
    rng = np.random.default_rng(6)
    texts = [("".join(rng.choice(list("abcdé \n"), size=200)), m) for m in (3, -7) for _ in range(12)] + [("", 3), ("😀".encode("utf-16", "surrogatepass").decode("utf-16"), 5)]
    df = spark.createDataFrame(texts, "text string, model long").repartition(3)
    counts = rules.count_grams(df, rules.BITS)
    got = {r.slot & ((1 << 64) - 1): r.value for r in rules.model_rows(counts).collect()}
    want = {}
    rows = counts.toPandas()
    for model, own in rows.groupby("model"):
        tables = rules.kneser_ney(own["gram"].to_numpy(), own["n"].to_numpy(), rules.BITS)
        for (kind, n), (grams, values) in tables.items():
            want |= dict(zip(rules.slot(kind, n, model, grams).tolist(), values.tolist()))
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5
