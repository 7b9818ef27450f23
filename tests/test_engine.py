"""Checks, cleaner, row filter, reports and command line on small tables."""

import hashlib
import io
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.config import CheckerConfig, read_settings
from corpusloom.functions import language, minhash, patterns, repair
from corpusloom.functions import text as T
from corpusloom.outcome import ERROR, INFO, WARNING
from corpusloom.operators import BaseChecker, get_all_checkers, get_checker
from corpusloom.operators.cleaner import TextCleaner
from corpusloom.plans import report as reports
from corpusloom.plans.runner import CheckRun, check_table, fix_table
from corpusloom.sources.loader import load_dataset, sample, with_row_id
from corpusloom.sources.session import shared_dir

LONG = "This sentence is long enough to be an ordinary document of the corpus, number {}."
ORDER = "missing_field schema text_length language html mojibake exact_duplicate near_duplicate pii token_length boilerplate"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


def check(spark, name, texts, **settings):
    checker = get_checker(name)(CheckerConfig(**settings))
    return Found(checker.check(table(spark, texts), "text", "row_id"), name)


class Found:
    """One check's part of an outcome."""

    def __init__(self, outcome, name):
        self.issues, self.stats = outcome.of(name).records, outcome.stats[name]


def flagged(found):
    return sorted({i for record in found.issues for i in record.sample})


def test_registry_order():
    assert list(get_all_checkers()) == ORDER.split()
    with pytest.raises(KeyError, match="missing_field"):
        get_checker("none of these")


def test_missing_field(spark):
    r = check(spark, "missing_field", [None, "", "a", " 　\x1c", "b"])
    assert flagged(r) == [0, 1, 3] and r.stats == {"total_rows": 5, "missing_count": 3, "missing_ratio": 0.6}
    assert r.issues[0].severity == ERROR
    assert check(spark, "missing_field", []).stats == {"total_rows": 0, "missing_count": 0, "missing_ratio": 0.0}


def test_text_length(spark):
    r = check(spark, "text_length", ["x" * 49, "é" * 50, None, "x" * 101], max_length=100)
    assert [(i.message, i.sample) for i in r.issues] == [
        ("Found 1 rows with text shorter than 50 characters", [0]),
        ("Found 1 rows with text longer than 100 characters", [3]),
    ]


def test_html_and_language(spark):
    r = check(spark, "html", ["<p>text</p><b>bold</b><br>", "<p>text</p><b>bold</b>", "Array.<number> a < b <*>", None])
    assert flagged(r) == [0] and r.stats["html_detected_count"] == 1
    texts = ["The cat and the dog are in the house of the man.", "これは日本語の文章です。とても良い天気ですね。", "12 34", None]
    r = check(spark, "language", texts)
    assert flagged(r) == [1] and r.stats == {"checked_count": 2, "non_target_count": 1}
    assert not check(spark, "language", texts, languages=["en", "ja"]).issues
    assert language.detect("Der Hund und die Katze sind nicht in dem Haus.")[0] == "de"


def test_mojibake(spark):
    bad = ["â\u0080\u009chelloâ\u0080\u009d", "Ã©", "â€\u009chelloâ€\u009d", "　x", "﻿Text"]
    r = check(spark, "mojibake", [*bad, "Café au lait", "plain", None])
    assert flagged(r) == [0, 1, 2, 3, 4]


def test_exact_duplicates(spark):
    r = check(spark, "exact_duplicate", ["same", "Same", "same", "", None, "", "same", "one"])
    assert flagged(r) == [0, 2, 3, 5, 6] and r.stats == {"total_rows": 8, "duplicate_count": 5, "unique_count": 4}
    assert check(spark, "exact_duplicate", ["a", "a"], skip_duplicates=True).stats == {"skipped": True}


def test_near_duplicates(spark):
    words = " ".join(f"word{i}" for i in range(87))
    r = check(spark, "near_duplicate", [words, words.replace("word40 ", "other "), "quite another text of words here", "", None])
    assert flagged(r) == [0, 1] and r.stats["near_duplicate_count"] == 2
    assert [minhash.band_shape(t, 128) for t in (0.5, 0.7, 0.8, 0.9, 0.95)] == [(25, 5), (14, 9), (9, 13), (5, 25), (3, 42)]


def test_pii(spark):
    texts = ["user@example.com", "555-123-4567", "03-1234-5678", "123-45-6789", "1234-5678-9012-3456", "192.168.1.100", "none", None]
    r = check(spark, "pii", texts)
    assert flagged(r) == [0, 1, 2, 3, 4, 5]
    assert r.stats["pii_email_count"] == 1 and r.stats["pii_ssn_count"] == 1 and r.issues[0].details["pii_types"]["email"] == 1
    assert check(spark, "pii", texts, detect_pii=False).stats == {"skipped": True}


PYTHON = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone_us": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "phone_jp": r"0\d{1,4}-\d{1,4}-\d{3,4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}


def test_java_patterns_equal_python_s(spark):
    texts = [
        "a@b.co, x@y.zz; (555) 123-4567 +1 555.123.4567", "é123-45-6789 123-45-6789é 123-45-6789", "1.2.3.4.5.6.7.8 _1.2.3.4",
        "1234 5678　9012 3456 and ٣٤٥-١٢-٦٧٨٩", "03-1234-5678 0312-1-123", "", "\n\r\t", "@@ .. --", "1 2 3",
    ]
    got = table(spark, texts).select("row_id", T.detect_pii(F.col("text")).alias("m")).orderBy("row_id").collect()
    for text, row in zip(texts, got):
        want = [(k, m[0], *m.span()) for k, p in PYTHON.items() for m in re.finditer(p, text)]
        assert [tuple(x) for x in row.m] == want
    user = [r"^a\s+b$", r"[\w-]+x", r"a.b", r"\bword\b", r"(?i)É\d", r"[^]a]z"]
    lines = ["a  b", "a b\n", "é-x", "a\rb", "a\nb", "a word.", "awordé", "é4", "É٣", "bz", "]z"]
    df = table(spark, lines)
    for p in user:
        hit = [r.row_id for r in df.where(F.col("text").rlike(patterns.to_java(p))).collect()]
        assert sorted(hit) == [i for i, t in enumerate(lines) if re.search(p, t)], p


def test_boilerplate(spark):
    texts = ["Copyright 2023 Example Corp and others", "see https://example.com/a and www.example.org", "mail me@example.com", "x", None]
    r = check(spark, "boilerplate", texts)
    assert [(i.severity, i.sample) for i in r.issues] == [("info", [0]), ("warning", [1]), ("warning", [2])]


def test_token_length(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    r = check(spark, "token_length", [" a" * 20, " a" * 21, None], token_encoding=path, max_token_length=20)
    assert flagged(r) == [1] and r.stats == {"total_rows": 3, "over_limit_count": 1}


def test_one_bad_check_leaves_the_others(spark):
    config = CheckerConfig(boilerplate_patterns=["("], token_encoding="no such encoding")
    outcome = CheckRun(table(spark, ["a", None]), "text", config, "row_id").outcome
    assert list(outcome.stats) == ORDER.split()
    results = {name: Found(outcome, name) for name in outcome.stats}
    for name in ("boilerplate", "token_length"):
        assert results[name].issues[0].message.startswith("Checker raised an exception: ")
    assert results["missing_field"].stats["missing_count"] == 1


def test_schema(spark):
    df = spark.createDataFrame([(0, 5), (1, None)], "row_id long, text long")
    outcome = CheckRun(df, "text", CheckerConfig(skip_checkers=["token_length"]), "row_id").outcome
    run = {name: Found(outcome, name) for name in outcome.stats}
    assert run["schema"].issues[0].severity == WARNING and run["missing_field"].stats["missing_count"] == 1
    assert run["text_length"].issues == []
    gone = CheckRun(df, "body", CheckerConfig(), "row_id").outcome
    assert list(gone.stats) == ["missing_field", "schema"] and gone.of("schema").count(ERROR) == 1


CASES = ["<p>Hello <b>world</b></p>", "A\x00B\x08C", "a    b\n\n\n\n\nc", "x<script>no</script>&amp;", "plain", None, "Ã©", " 　edge ", "tab\tcr\rend"]


def test_cleaner(spark):
    cleaner = TextCleaner()
    df = table(spark, CASES).withColumn("label", F.lit("kept"))
    fixed, stats = cleaner.fix_dataset(df)
    got = [r.text for r in fixed.orderBy("row_id").collect()]
    assert got == [cleaner.fix_text(t) for t in CASES]
    assert got[:5] == ["Hello world", "ABC", "a  b\n\n\nc", "x&", "plain"] and fixed.columns == df.columns
    assert stats["total_rows"] == len(CASES)
    assert stats["total_fixed"] == sum(a != b for a, b in zip(got, CASES))
    assert repair.strip_markup("<style>p{}</style>a<!-- b -->c") == "ac"


def test_fix_keeps_the_first(spark):
    other = "Another text, which has no run of five words in common with any of the texts beside it."
    mail = "Please write to someone@example.com if there is anything else that you would like to know."
    texts = [LONG.format(1), LONG.format(1), "short", other, LONG.format(1), mail]
    df = table(spark, texts)
    config = CheckerConfig(skip_checkers=["token_length"])
    fixed, stats, after = fix_table(df, "text", config, "row_id")
    assert sorted(r.row_id for r in fixed.collect()) == [0, 3]
    f = stats["filter_stats"]
    assert f["exact_duplicate"] == 2 and f["text_length"] == 1 and f["pii"] == 1
    assert f["total_rows_removed"] == 4 and f["rows_after_filter"] == 2 == after.total_rows
    assert f["total_rows_removed"] <= sum(v for k, v in f.items() if k not in ("total_rows_removed", "rows_after_filter"))


def test_fix_leaves_sound_texts_alone(spark):
    """Repeated capitals with accents are no damage, in the fix pipeline either."""
    texts = ["Licence publique, version trois.\n" + "Èèç " * 25 + "Èeux", "QUE!! ÈÉÇ!! UN.!! ÈÈQUE!! ÈÉÇ,!! ET!! DE!! ÈÉÇ!! QUEEAUTION"]
    fixed, stats, after = fix_table(table(spark, texts), "text", CheckerConfig(skip_checkers=["token_length"]), "row_id")
    assert [r.text for r in fixed.orderBy("row_id").collect()] == texts and stats["total_fixed"] == 0
    assert after.outcome.stats["mojibake"]["mojibake_count"] == 0


def test_signatures_against_whole_numbers():
    """The least values by numpy are those by Python's integers, for short, repeated and long texts."""
    rng = random.Random(8)
    texts = ["", " \u3000\n", "One", "É\u00a0é  straße 日本", "a b c d e", "a b c d e F", "x " * 700, " ".join(f"w{rng.randrange(90)}ß" for _ in range(600))]
    a, c = minhash.family(128)
    for text in texts:
        want = sorted(int(hashlib.md5(r.encode()).hexdigest()[:7], 16) for r in minhash.word_runs(text))
        h = minhash.run_hashes(text)
        assert sorted(set(h.tolist())) == sorted(set(want))
        if want:
            got = minhash._least(h, np.array(a)[:, None], np.array(c)[:, None])
            assert got.tolist() == [min((x * v + y) % minhash.PRIME for v in want) for x, y in zip(a, c)]


def test_quick_tests_change_no_measure(spark):
    """Blank texts and densities, by tests that come before the expressions."""
    texts = ["", " \u3000\x1f\n", "\n.", "see www.a.b now", "see http://a.b/c?d", "no http here", "HTTPS://x", "a@b.co", "a @ b", None, "x" * 9]
    df = table(spark, texts)
    t = F.col("text")
    n = F.length(t)
    plain = [F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(t, p, ""))) / n) for p in (patterns.URL, patterns.EMAIL)]
    got = df.select((T.strip(t) == "").alias("a"), *[x.alias(f"p{i}") for i, x in enumerate(plain)], T.is_blank(t).alias("b"),
                    T.url_density(t).alias("u"), T.email_density(t).alias("e")).collect()
    assert [(r.a, r.p0, r.p1) for r in got] == [(r.b, r.u, r.e) for r in got] and {r.b for r in got} == {True, False, None}
    assert patterns.STRIP not in str(T.is_missing(t))


def test_clusters_sign_texts_once(spark, monkeypatch):
    from corpusloom.plans import catalogue

    asked = []
    own = minhash.signature
    monkeypatch.setattr(minhash, "signature", lambda *a: asked.append(a) or own(*a))
    catalogue.near_dup_keep_clusters(spark, "/root/testdata/sf0.001").count()
    assert len(asked) == 1


def test_shingles_are_sorted_without_a_function(spark):
    from corpusloom.plans import catalogue

    plan = catalogue.shingle_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan and plan.count("split(") == 1


def test_near_duplicate_policies(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = table(spark, [a, a + " end", b, b + " end", b + " end"])
    base = {"skip_checkers": ["token_length", "exact_duplicate"]}
    for policy, stay in (("global_min", [0]), ("per_cluster", [0, 2])):
        fixed, _, _ = fix_table(df, "text", CheckerConfig(near_dup_keep=policy, **base), "row_id")
        assert sorted(r.row_id for r in fixed.collect()) == stay


def test_rows_and_samples(spark):
    df = spark.range(0, 1100, 1, 7).select(F.concat(F.lit("t"), "id").alias("text"))
    ids = [r.row_id for r in with_row_id(df).collect()]
    assert sorted(ids) == list(range(1100))
    one, two = (sorted(r.text for r in sample(df, 100).collect()) for _ in range(2))
    assert one == two and len(one) == 100
    assert sample(df, 0).count() == sample(df, 5000).count() == 1100


def test_sources(spark, tmp_path):
    df = table(spark, ["a", "b", None])
    for split in ("train", "test"):
        os.makedirs(tmp_path / "t", exist_ok=True)
        df.where("row_id < 2" if split == "test" else "true").toPandas().to_parquet(tmp_path / "t" / f"{split}-00000-of-00001.parquet")
    assert load_dataset(spark, str(tmp_path / "t")).count() == 3
    assert load_dataset(spark, str(tmp_path / "t"), split="test").count() == 2
    with pytest.raises(ValueError, match="body"):
        load_dataset(spark, str(tmp_path / "t"), text_field="body")
    (tmp_path / "x.jsonl").write_text('{"text": "one"}\n{"text": "two"}\n')
    (tmp_path / "x.csv").write_text('text,n\n"a, b",1\n')
    assert load_dataset(spark, str(tmp_path / "x.jsonl")).count() == 2
    assert load_dataset(spark, str(tmp_path / "x.csv")).first().text == "a, b"


def run_cli(spark, capsys, *argv):
    code = cli.main(list(argv), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    shared = os.path.join(shared_dir(spark).removeprefix("file://"), "corpusloom")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    skip = ["--skip-checker", "token_length"]
    for name, texts, want in (
        ("clean", [f"The house of the man and the dog is on the hill, and it is a good one. Document {w}." for w in ("one", "two")], 0),
        ("warning", ["Short", LONG], 1),
        ("error", [None, LONG], 2),
    ):
        table(spark, texts).select("text").coalesce(1).write.parquet(str(tmp_path / name))
        code, out, _ = run_cli(spark, capsys, str(tmp_path / name), *skip, "--skip-checker", "near_duplicate")
        assert code == want, (name, out)
        assert list(json.loads(out)) == ["dataset_id", "split", "total_rows", "text_field", "summary", "results"]
    code, out, _ = run_cli(spark, capsys, str(tmp_path / "warning"), *skip, "--fix", "--fix-output", str(tmp_path / "out"))
    shape = json.loads(out)
    assert list(shape) == ["dataset_id", "split", "total_rows", "text_field", "before", "fix_stats", "after"] and code == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == shape["fix_stats"]["filter_stats"]["rows_after_filter"] == 1
    assert set(os.listdir(shared)) == before  # a run leaves none of its tables behind
    assert run_cli(spark, capsys, str(tmp_path / "warning"), "--fix", "--fix-output", "/elsewhere")[0] == 3
    code, _, err = run_cli(spark, capsys, str(tmp_path / "nothing"))
    assert code == 3 and json.loads(err)["error"].startswith("Failed to load dataset")
    assert run_cli(spark, capsys, "bad\x07name")[0] == 1
    (tmp_path / "c.yaml").write_text("min_length: 3\nunknown: 1\nskip_checkers: [language]\n")
    config = read_settings(str(tmp_path / "c.yaml"))
    assert config.min_length == 3 and config.max_length == 100_000 and config.skip_checkers == ["language"]


def test_reports(spark):
    report = check_table(table(spark, ["Short", None, LONG]), "text", CheckerConfig(skip_checkers=["token_length"]), "row_id", "name")
    words = reports.text(report)
    assert "missing_field" in words and "FAIL" in words and "ERRORS FOUND" in words and "(sample: [1])" in words
    both = reports.text(report, {"total_fixed": 2, "filter_stats": {"pii": 1, "total_rows_removed": 1, "rows_after_filter": 2}}, report)
    assert "Rows removed: 1 (1 pii)" in both and "Rows remaining: 2" in both
    out = io.StringIO()
    reports.write_json(out, report)
    assert json.loads(out.getvalue())["summary"]["errors"] == 1


def test_own_check(spark):
    from corpusloom.operators import Finding

    class Shouting(BaseChecker):
        name = "shouting"

        def measures(self, text):
            return {"loud": F.coalesce(text == F.upper(text), F.lit(False))}

        def findings(self, text_field):
            return [Finding("loud", INFO, "Found {n} loud rows")]

    r = Found(Shouting().check(table(spark, ["HEY", "hey", None]), "text", "row_id"), "shouting")
    assert flagged(r) == [0] and r.issues[0].message == "Found 1 loud rows"


def test_streams(spark, tmp_path):
    from corpusloom.streaming import check_stream, clean_stream

    table(spark, ["short", "<p>x</p>" * 9, None]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, text string").parquet(str(tmp_path / "in"))
    checked = check_stream(clean_stream(stream), config=CheckerConfig(skip_checkers=["token_length"]))
    query = checked.writeStream.format("memory").queryName("checked").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.sql("select row_id, text, `text_length.short` as short from checked order by row_id").collect()
    assert [(r.text, r.short) for r in rows] == [("short", True), ("x" * 9, True), (None, False)]


def test_token_counts_of_documents(spark):
    import public_tokenizers as P
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from corpusloom.plans.catalogue import QUERIES

    ranks = load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = "/root/testdata/sf0.001"
    counts = {r.doc_id: len(theirs.encode_ordinary(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.token_count for r in QUERIES["token_length_over"](spark, data).collect()}
    assert got == {i: n for i, n in counts.items() if n > 1000} and got


def test_cleaning_counts_of_pages(spark):
    from corpusloom.plans.catalogue import QUERIES

    data = "/root/testdata/sf0.001"
    row = QUERIES["fix_stats"](spark, data).first()
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    changed = sum(TextCleaner().fix_text(p) != p for p in pages)
    assert (row.total_rows, row.total_fixed) == (len(pages), changed) and row.html_stripped > 0
