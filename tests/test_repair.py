"""Repair of texts read in wrong code pages: the fixed cases, chains of pages, clean texts, long texts."""

import time

import pytest

from corpusloom.config import CheckerConfig
from corpusloom.functions import repair
from corpusloom.operators import get_checker

# Texts that count as garbled, and texts that don't.
GARBLED = {
    "â\u0080\u009chelloâ\u0080\u009d": '"hello"',
    "Ã©": "é",
    "â€\u009chelloâ€\u009d": '"hello"',
    "　test content with full-width space": " test content with full-width space",
    "﻿Text with byte order mark at start of content.": "Text with byte order mark at start of content.",
}
CLEAN = [
    "This is a perfectly normal English text without any encoding issues.",
    "Another clean text with proper UTF-8 encoding and no garbled characters.",
    "The quick brown fox jumps over the lazy dog.",
    "Café au lait with proper encoding is fine.",
]
WORDS = (
    "Käse Größe Straße über Äpfel élève façon où naïve cœur señor mañana ¿Qué? acción ñandú París Łódź książka žluťoučký kůň Ünlü "
    "şarkı Привет мир Ελλάδα 日本語 한국어 – dash… €5 ça à À É 😀"
)
#: Real texts in which two neighbouring characters would read as UTF-8 in some page.
AMBIGUOUS = [
    "CAFÉ… naïve — Äpfel «ACCIÓ» ¡Él! ¿Óxido? 20 °C ±5 ½ ÷ × £5 50€ © 2020 Ñandú… JÄ… «Éa» –À", "Привет… «Ёлка» №5 — мир",
    "Ελλάδα «Άλφα» …", "日本語、テスト。「かな」", "Žluťoučký kůň – příliš…", "naïf ÉÈ ÀÉ üß ßü öä äö Èéç Èéê", "œuvre Œdipe cœur", "Łódź ŻÓŁĆ…",
]


def garble(text, page):
    """The text's UTF-8 read in a code page; bytes that the page lacks become the control of their number."""
    one = dict(reversed([(b, c) for c, b in repair._PAGES[repair.CODE_PAGES.index(page)].byte_of.items()]))
    return "".join(chr(b) if b < 128 else one[b] for b in text.encode())


def test_fixed_cases(spark):
    texts = [*GARBLED, *CLEAN, None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    found = get_checker("mojibake")(CheckerConfig()).check(df, "text", "row_id")
    assert found.stats["mojibake"] == {"total_rows": len(texts), "mojibake_count": len(GARBLED)}
    assert [list(r.sample) for r in found.records] == [list(range(len(GARBLED)))]
    assert [repair.fix_text(t) for t in GARBLED] == list(GARBLED.values())
    assert [repair.fix_text(t) for t in CLEAN] == CLEAN


@pytest.mark.parametrize("chain", [[p] for p in repair.CODE_PAGES] + [["latin-1"] * 2, ["cp1252"] * 2, ["latin-1"] * 6])
def test_chains_of_pages(chain):
    text = WORDS
    for page in chain:
        text = garble(text, page)
    assert text != WORDS and repair._readable(text) == WORDS


def test_single_words_of_the_common_pages():
    for page in ("cp1252", "latin-1", "cp1251", "cp437"):
        assert [w for w in WORDS.split() if repair._readable(garble(w, page)) != w] == []


def test_clean_texts_stay():
    for text in (*AMBIGUOUS, WORDS):
        assert repair._readable(text) == text


def test_accented_capitals_in_a_row_stay():
    """Three such letters are a rare ideograph in one page; a text that repeats them is no proof of that page."""
    texts = ["Licence.\n" + "Èèç " * 25 + "Èeux, Èeux", "QUE!! ÈÉÇ!! UN.!! ÈÈQUE!! ÈÉÇ,!! UN", "DE!! ÈÇÉ!! Ç!! ÈÇÉ!! SUR!", "ÈÉÉ!! QUE.\nÈÉÉ! " + "ÈÉÇ " * 9]
    for text in texts:
        assert repair.fix_text(text) == text
        for _ in range(3):
            text, plain = text.encode().decode("latin-1"), text
            assert repair.fix_text(text) == repair.fix_text(plain) == texts[texts.index(repair.fix_text(text))]
    told = "日本語、テスト。鏍 Èèç"  # where other runs tell the page, such letters are read by it
    assert repair.fix_text(garble(told[:-4], "mac-roman") + " Èèç") == told[:-3] + "鏍"


def test_words_after_an_ampersand_stay(spark):
    """A word that begins as a reference's name is none; else ``<a. b`` would go as a tag, with all that follows."""
    from corpusloom.operators.cleaner import TextCleaner

    texts = ["adoez&&&lta. b", "iellción&&paraciónosírr es", "ie&&paraññieque", "Stäö&gtz", "a&lta; b", "Q&Amar", "R&D & co", "&"]
    assert [repair.fix_text(t) for t in texts] == texts == [repair.strip_markup(t) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    cleaned, stats = TextCleaner().fix_dataset(df)
    assert sorted(r.text for r in cleaned.collect()) == sorted(texts) and stats["total_fixed"] == 0
    assert repair.fix_text("a &lt; b &amp;&#233;&eacute; &copy") == "a < b &éé &copy"
    assert repair.strip_markup("<p>a &lt; b &amp &copy=&#233;&eacute;</p>") == "a < b & ©=éé"


def test_garbled_beside_clean():
    assert repair.fix_text("Käse und KÃ¤se, naïve und naÃ¯ve") == "Käse und Käse, naïve und naïve"
    mixed = "Größe " + garble("Straße", "latin-1") + " und " + garble(garble("Füße", "cp1252"), "cp1252")
    assert repair.fix_text(mixed) == "Größe Straße und Füße"


def test_long_texts_are_quick():
    began = time.time()
    assert repair.fix_text(garble(WORDS + " ", "latin-1") * 5_000) == repair.fix_text((WORDS + " ") * 5_000)
    assert repair.fix_text("Ã" * 300_000) == "Ã" * 300_000
    assert repair.fix_text("é" * 300_000) == "é" * 300_000
    assert time.time() - began < 60


def test_a_row_on_which_repair_fails_is_passed_over(spark):
    from pyspark.sql import functions as F

    def picky(text):
        if "bad" in text:
            raise ValueError(text)
        return text.upper()

    assert repair._or_same(picky)("bad é") == "bad é" and repair._or_same(picky)("é") == "É"
    df = spark.createDataFrame([("bad é",), ("é",), (None,)], "text string")
    got = df.select(repair._guarded(F.col("text"), F.col("text").rlike("é"), repair._or_same(picky)).alias("t")).collect()
    assert [r.t for r in got] == ["bad é", "É", None]


def every_page(runs):
    """The search of ``ungarble`` with every page tried on every run."""
    import heapq
    from itertools import product

    start, often = tuple(runs), list(runs.values())

    def cost(old, state):
        return sum(n * repair._reading_cost(o, r) for n, o, r in zip(often, old, state))

    best, best_cost, since = start, cost(start, start), 0
    queue, seen = [(best_cost, 0, start)], {start}
    while queue and since < repair.PATIENCE:
        now, _, state = heapq.heappop(queue)
        since += 1
        if now < best_cost - repair.LEAST_GAIN:
            best, best_cost, since = state, now, 0
        for page, whole in product(repair._PAGES, (True, False)):
            new = tuple(repair._step(page, r, whole) for r in state)
            if new not in seen:
                seen.add(new)
                new_cost = cost(state, new)
                if new_cost < now - repair.LEAST_GAIN:
                    heapq.heappush(queue, (new_cost, len(seen), new))
    return dict(zip(start, best))


def test_pages_are_tried_only_where_they_change_a_run(monkeypatch):
    """Every page was tried on every run, and anew for each pair of neighbours."""
    import random

    rng, words = random.Random(4), [w for t in (*AMBIGUOUS, WORDS) for w in t.split()]
    for _ in range(60):
        pages = rng.choices(repair.CODE_PAGES, k=rng.randrange(1, 3))
        runs = {}
        for word in rng.choices(words, k=12):
            for page in pages[: rng.randrange(3)]:
                word = garble(word, page)
            for m in repair._BEYOND_ASCII.finditer(word):
                runs[word[: m.start()][-1:] or rng.choice("xQ .1"), m[0], word[m.end() :][:1]] = rng.randrange(1, 9)
        assert repair.ungarble(runs) == every_page(runs)

    steps, step = [], repair._step
    monkeypatch.setattr(repair, "_step", lambda *a: steps.append(a) or step(*a))
    text = " ".join(f"{a}{garble(w, 'latin-1')}{b}" for w in "éöñ" for a in "bcdfghjklm" for b in "npqrstvwxy")
    assert repair.fix_text(text).count("é") == 100 and len(steps) < 1_000


def test_a_text_is_repaired_once_for_both_columns(spark):
    from corpusloom.plans import catalogue

    df = catalogue.QUERIES["mojibake_repaired"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("run(") == 1
