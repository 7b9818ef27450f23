"""Queries of the engine's own operators, and SQL that gives the same rows.

Every query runs over its whole table.  Where SQL has no form (text repair,
language guesses) there is none, and tests hold the query to given cases.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import BOILERPLATE_PATTERNS, CheckerConfig
from corpusloom.functions import language, minhash, patterns, repair
from corpusloom.functions import text as T
from corpusloom.operators.checks import (
    BoilerplateChecker,
    ExactDuplicateChecker,
    HtmlChecker,
    LanguageChecker,
    MissingFieldChecker,
    MojibakeChecker,
    NearDuplicateChecker,
    PiiChecker,
    TextLengthChecker,
    TokenLengthChecker,
)
from corpusloom.operators import language_model
from corpusloom.operators.cleaner import TextCleaner
from corpusloom.operators.row_filter import REMOVING, RowFilter
from corpusloom.plans.runner import annotate, check_table, fix_table, summarise, text_rows
from corpusloom.sources.loader import load_dataset, sample, with_row_id
from corpusloom.sources.session import materialise, ship_package

#: Patterns of phrases that the test tables have; the defaults seldom occur in them.
PHRASES = [r"(?i)all rights reserved", r"(?i)licensed? under", *BOILERPLATE_PATTERNS]
SMALL = CheckerConfig(max_length=10_000, boilerplate_patterns=PHRASES)
#: Words of a benchmark item that make a phrase.
PHRASE_WORDS = 8
#: Checks whose results SQL can express.
_SQL_CHECKS = (MissingFieldChecker, TextLengthChecker, HtmlChecker, ExactDuplicateChecker, PiiChecker, BoilerplateChecker)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{d}/pages.parquet")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return text_rows(_docs(spark, d), "text", "doc_id")


def _long(*names: str):  # noqa: ANN202
    return [F.col(f"`{n}`").cast("long").alias(n) for n in names]


def scan_project(spark: SparkSession, d: str) -> DataFrame:
    """Scan of some columns, and a length."""
    return _docs(spark, d).select("doc_id", "lang", "source", F.length("text").cast("long").alias("length"))


def sample_n(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator: 100 rows, the same each time."""
    return sample(_docs(spark, d), 100, "doc_id").select("doc_id", "source")


def missing_field_stats(spark: SparkSession, d: str) -> DataFrame:
    flag = T.is_missing(F.col("text"))
    agg = _docs(spark, d).agg(F.count("*").alias("total_rows"), F.count_if(flag).alias("missing_count"))
    return agg.withColumn("missing_ratio", F.round(F.col("missing_count") / F.greatest("total_rows", F.lit(1)), 6))


def missing_field_flags(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns without text."""
    ship_package(spark)
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    return turns.select("conv_id", "turn", T.is_missing(F.col("text")).alias("missing"))


def text_length_flags(spark: SparkSession, d: str) -> DataFrame:
    m = TextLengthChecker(SMALL).measures(F.col("text"))
    return _docs(spark, d).select("doc_id", m["short"].alias("too_short"), m["long"].alias("too_long"))


def text_length_stats(spark: SparkSession, d: str) -> DataFrame:
    f = text_length_flags(spark, d)
    return f.groupBy().agg(
        F.count("*").alias("total_rows"), F.count_if("too_short").alias("too_short_count"), F.count_if("too_long").alias("too_long_count")
    )


def html_flags(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select(
        "page_id", T.count_html_tags(F.col("html")).cast("long").alias("tags"),
        HtmlChecker().measures(F.col("html"))["tagged"].alias("flagged"),
    )


def html_stats(spark: SparkSession, d: str) -> DataFrame:
    f = html_flags(spark, d)
    return f.agg(F.count("*").alias("total_rows"), F.count_if("flagged").alias("html_detected_count"), F.sum("tags").alias("tags"))


def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    cols = [c.cast("long").alias(k) for k, c in T.pii_counts(F.col("text")).items()]
    return _docs(spark, d).select("doc_id", *cols)


def pii_types(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of personal data by kind."""
    counted = _docs(spark, d).agg(*[F.sum(c.cast("long")).alias(k) for k, c in T.pii_counts(F.col("text")).items()])
    return counted.unpivot([], list(patterns.PII), "pii_type", "n").where("n > 0")


def pii_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each match with its place."""
    m = PiiChecker.matches(_rows(spark, d))
    return m.select(F.col("row_id").alias("doc_id"), "pii_type", "value", *_long("start", "end"))


def pii_values(spark: SparkSession, d: str) -> DataFrame:
    """Matched values, counted."""
    return PiiChecker.matches(_rows(spark, d)).groupBy("pii_type", "value").agg(F.count("*").alias("n"))


def boilerplate_first_match(spark: SparkSession, d: str) -> DataFrame:
    return BoilerplateChecker(SMALL).matches(_rows(spark, d)).withColumnRenamed("row_id", "doc_id")


def benchmark_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The boilerplate check with a phrase of every benchmark item: the first that a document has."""
    ship_package(spark)
    items = spark.read.parquet(f"{d}/benchmark.parquet").where("text is not null").orderBy("item_id")
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, PHRASE_WORDS)
    own = items.select(words.alias("w")).where(F.size("w") == PHRASE_WORDS).collect()  # the check's settings
    phrases = ["(?i)" + r"\s+".join(map(re.escape, r["w"])) for r in own]
    check = BoilerplateChecker(replace(SMALL, boilerplate_patterns=phrases))
    found = check.matches(_rows(spark, d))
    words = F.regexp_replace(F.substring("matched_pattern", 5, 1 << 20), r"\\s\+", " ")
    return found.select(F.col("row_id").alias("doc_id"), F.regexp_replace(words, r"\\(.)", "$1").alias("phrase"))


def url_density(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.round(T.url_density(F.col("html")), 6).alias("density"))


def email_density(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(T.email_density(F.col("text")), 6).alias("density"))


def control_whitespace(spark: SparkSession, d: str) -> DataFrame:
    """Control characters and overlong white space."""
    return _pages(spark, d).select(
        "page_id", T.count_control_chars(F.col("html")).cast("long").alias("controls"),
        T.has_excessive_whitespace(F.col("html")).alias("excessive"),
    )


def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.sha256_hash(F.col("text")).alias("hash"))


def _twins(spark: SparkSession, d: str) -> DataFrame:
    _, table = ExactDuplicateChecker().group_measures(_rows(spark, d))
    return table


def exact_dup_flags(spark: SparkSession, d: str) -> DataFrame:
    return _twins(spark, d).select(F.col("row_id").alias("doc_id"))


def exact_dup_stats(spark: SparkSession, d: str) -> DataFrame:
    hashed = _docs(spark, d).select(T.sha256_hash(F.col("text")).alias("h")).groupBy("h").count()
    return hashed.agg(
        F.sum("count").alias("total_rows"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_count"),
        F.count("*").alias("unique_count"),
    )


def exact_dup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Rows that go when the first of each group of equal texts stays."""
    return _twins(spark, d).where("later").select(F.col("row_id").alias("doc_id"))


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    runs = _docs(spark, d).select("doc_id", T.shingles(F.col("text")).alias("runs"))  # made once
    # sort_array compares strings themselves; array_sort calls a function for each two.
    return runs.select("doc_id", F.size("runs").cast("long").alias("n"), F.md5(F.array_join(F.sort_array("runs"), "|").cast("binary")).alias("digest"))


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    s = minhash.signature(F.col("text"), 128)
    return _docs(spark, d).select("doc_id", F.array_join(s.cast("array<string>"), ",").alias("signature"))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each row that shares a band, with the least row of a band it shares."""
    return NearDuplicateChecker().candidates(_rows(spark, d)).select("first", F.col("row_id").alias("doc_id"))


def near_dup_flags(spark: SparkSession, d: str) -> DataFrame:
    _, table = NearDuplicateChecker().group_measures(_rows(spark, d))
    return table.select(F.col("row_id").alias("doc_id"))


def near_dup_keep(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate rows that go when the least of all stays."""
    rows = _rows(spark, d)
    removed = RowFilter().removals(materialise(annotate(rows, [NearDuplicateChecker()]), "annotated"))
    return removed.where("near_duplicate").select(F.col("row_id").alias("doc_id"))


def near_dup_keep_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate rows that go when the least of each cluster stays."""
    rows, check = _rows(spark, d), NearDuplicateChecker()
    config = replace(CheckerConfig(), near_dup_keep="per_cluster")
    shared = check.shared(rows)  # signatures are made once, for the flags and for the links
    annotated = materialise(annotate(rows, [check], {check.name: shared}), "annotated")
    removed = RowFilter(config).removals(annotated, check.links(shared))
    return removed.where("near_duplicate").select(F.col("row_id").alias("doc_id"))


def language_flags(spark: SparkSession, d: str) -> DataFrame:
    """The language predicate with the table's own language as prediction."""
    other = LanguageChecker().is_other(F.col("lang"), F.lit(1.0))
    return _docs(spark, d).select("doc_id", other.alias("non_target"))


def language_model_detect(spark: SparkSession, d: str) -> DataFrame:
    """Languages told by a model counted from the table: the guess, its known trigrams and its lead."""
    docs = _docs(spark, d)
    told = language_model.train(docs).predict(F.col("text"))
    return docs.select("doc_id", told.alias("t")).select("doc_id", F.col("t.lang").alias("guess"), "t.known", "t.lead")


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    """Guessed languages."""
    guess = language.predict(F.col("text"))
    return _docs(spark, d).select("doc_id", "lang", guess.alias("g")).select("doc_id", "lang", F.col("g.lang").alias("guess"), F.round("g.score", 6).alias("score"))


def token_length_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Texts that can have more than 1000 tokens: only these need a tokenizer."""
    return _docs(spark, d).where(F.octet_length("text") > 1000).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


def token_length_over(spark: SparkSession, d: str) -> DataFrame:
    """Texts of more than 1000 tokens of a public vocabulary, and how many they have."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    check = TokenLengthChecker(replace(SMALL, token_encoding=path, max_token_length=1000))
    return check.over_limit(_rows(spark, d)).select(F.col("row_id").alias("doc_id"), *_long("token_count"))


def control_char_clean(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.md5(repair.remove_control_chars(F.col("html")).cast("binary")).alias("digest"))


def whitespace_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(repair.normalize_whitespace(F.col("text")).cast("binary")).alias("digest"))


def clean_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the control-character and white-space steps change."""
    a = _pages(spark, d).select(F.col("html").alias("s0")).withColumn("s1", repair.remove_control_chars(F.col("s0")))
    b = a.withColumn("s2", repair.normalize_whitespace(F.col("s1")))
    return b.agg(
        F.count_if(F.col("s0") != F.col("s1")).alias("control_chars_removed"),
        F.count_if(F.col("s1") != F.col("s2")).alias("whitespace_normalized"),
        F.count_if(F.col("s0") != F.col("s2")).alias("total_fixed"), F.count("*").alias("total_rows"),
    )


def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", repair.strip_html(F.col("html")).alias("text"))


def fix_text(spark: SparkSession, d: str) -> DataFrame:
    """All four cleaning steps."""
    return _pages(spark, d).select("page_id", TextCleaner().clean(F.col("html")).alias("text"))


def mojibake_flags(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", MojibakeChecker().measures(F.col("text"))["garbled"].alias("garbled"))


def mojibake_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every document read in a wrong code page once, twice or three times, then repaired."""
    garbled = F.col("text")
    for turn in range(3):
        wrong = F.decode(F.encode(garbled, "UTF-8"), "ISO-8859-1")
        garbled = F.when(F.col("doc_id") % 3 >= turn, wrong).otherwise(garbled)
    rows = _docs(spark, d).select("doc_id", garbled.alias("garbled"))
    plain = rows.withColumn("plain", repair.fix_mojibake(F.col("garbled")))  # a text is repaired once, for both columns
    return plain.select(
        "doc_id", F.coalesce(F.col("plain") != F.col("garbled"), F.lit(False)).alias("found"), F.md5(F.col("plain").cast("binary")).alias("digest"),
    )


def load_documents(spark: SparkSession, d: str) -> DataFrame:
    """The loader, its column guard, and the position of each row in the file."""
    df = load_dataset(spark, f"{d}/documents.parquet", text_field="text")
    return with_row_id(df).select("doc_id", "row_id", F.length("text").cast("long").alias("length"))


def row_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of a shuffled and joined table: dense, none lost or given twice."""
    ship_package(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    langs = docs.groupBy("lang").agg(F.count("*").alias("of_lang"))  # one short row for each language
    moved = docs.join(F.broadcast(langs), "lang").repartition("doc_id")  # no language's texts go to one task
    placed = with_row_id(moved)
    return placed.agg(
        F.count("*").alias("total_rows"), F.count_distinct("row_id").alias("positions"), F.min("row_id").alias("least"),
        F.max("row_id").alias("greatest"), F.count_distinct("doc_id").alias("documents"),
    )


def fix_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of the fix pipeline: rows that each check flags before and after it, and the first ten."""
    config = replace(SMALL, near_dup_keep="per_cluster", skip_checkers=["language", "mojibake", "token_length"])
    docs = _docs(spark, d)
    before = check_table(docs, "text", config, "doc_id")
    _, _, after = fix_table(docs, "text", config, "doc_id")
    rows = [
        (phase, r.checker, r.severity, r.rows, ",".join(map(str, r.sample)), checked.total_rows)
        for phase, checked in (("before", before), ("after", after)) for r in checked.outcome.records
    ]
    return spark.createDataFrame(rows, "phase string, checker string, severity string, affected_rows long, sample string, total_rows long")


def fix_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many pages each cleaning step changes."""
    _, stats = TextCleaner().fix_dataset(_pages(spark, d), "html")
    return spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} long" for k in stats))


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    checks = [c(SMALL) for c in (*_SQL_CHECKS, NearDuplicateChecker)]
    return materialise(annotate(_rows(spark, d), checks), "annotated")


def _removals(spark: SparkSession, d: str) -> DataFrame:
    return RowFilter(SMALL).removals(_annotated(spark, d))


def row_filter_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the row filter keeps, with their other columns."""
    docs = with_row_id(_docs(spark, d), "doc_id")
    kept, _ = RowFilter(SMALL).filter_dataset(docs, _annotated(spark, d))
    return kept.select("doc_id", "lang", "source", "n_chars")


def row_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each check removes, and all together."""
    any_ = F.greatest(*[F.col(c) for c in REMOVING])
    return _removals(spark, d).agg(
        *[F.count_if(F.col(c)).alias(c) for c in REMOVING], F.count_if(any_).alias("total_rows_removed"),
        F.count_if(~any_).alias("rows_after_filter"),
    )


def row_filter_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay."""
    any_ = F.greatest(*[F.col(c) for c in REMOVING])
    return _removals(spark, d).where(~any_).select(F.col("row_id").alias("doc_id"))


def check_summary(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the checks that SQL can express: one row for each."""
    checks = [c(SMALL) for c in _SQL_CHECKS]
    annotated = annotate(_rows(spark, d), checks)
    flags = [(k.name, f) for k in checks for f in k.findings("text")]
    counted = annotated.agg(*[F.count_if(F.col(f"`{n}.{f.flag}`")).alias(f"{n}.{f.flag}") for n, f in flags])
    told = F.array(*[F.struct(F.lit(n).alias("checker"), F.lit(f.flag).alias("issue"), F.lit(f.severity).alias("severity"), F.col(f"`{n}.{f.flag}`").alias("affected_rows")) for n, f in flags])
    return counted.select(F.explode(told).alias("x")).select("x.*")


def issue_samples(spark: SparkSession, d: str) -> DataFrame:
    """The report's issues, with their first ten rows."""
    checks = [c(SMALL) for c in _SQL_CHECKS]
    annotated = annotate(_rows(spark, d), checks)
    rows = [
        (r.checker, r.severity, r.rows, ",".join(map(str, r.sample)))
        for r in summarise(annotated, checks, "text").records
    ]
    return spark.createDataFrame(rows, "checker string, severity string, affected_rows long, sample string")


def fix_before_after(spark: SparkSession, d: str) -> DataFrame:
    """The whole fix pipeline; rows that it keeps, with their cleaned text's hash."""
    config = replace(SMALL, skip_checkers=["token_length"])
    fixed, _, _ = fix_table(_docs(spark, d), "text", config, "doc_id")
    return fixed.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_ALL = (
    scan_project, sample_n, missing_field_stats, missing_field_flags, text_length_flags, text_length_stats, html_flags,
    html_stats, pii_counts, pii_types, pii_matches, pii_values, boilerplate_first_match, benchmark_phrases, url_density, email_density,
    control_whitespace, text_hash, exact_dup_flags, exact_dup_stats, exact_dup_keep_first, shingle_counts,
    minhash_signature, lsh_candidates, near_dup_flags, near_dup_keep, near_dup_keep_clusters, language_flags,
    language_detect, token_length_candidates, token_length_over, control_char_clean, whitespace_clean, clean_stats, strip_html, fix_text,
    mojibake_flags, mojibake_repaired, language_model_detect, load_documents, row_positions, fix_report, fix_stats, row_filter_stats, row_filter_rows, row_filter_kept, check_summary, issue_samples, fix_before_after,
)


def _shipped(query):  # noqa: ANN001, ANN202
    """The query, run once the executors have the package: functions remember what was shipped when they were made."""

    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return query(spark, d)

    return run


QUERIES = {f.__name__: _shipped(f) for f in _ALL}

# ---- SQL ------------------------------------------------------------------------------------------------------------

_SPACES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_STRIPPED = "regexp_replace(@, '\\A" + _SPACES + "+|" + _SPACES + "+\\z', '', 'g')"
_MISSING = "coalesce(" + _STRIPPED.replace("@", "text") + " = '', true)"
# The same patterns in RE2, which has no look-around and needs none on these tables.
_PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone_us": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "phone_jp": r"0\d{1,4}-\d{1,4}-\d{3,4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
_URL = r"https?://[^\s<>\"'')\]]+|www\.[^\s<>\"'')\]]+"
_TAGS = (
    r"len(regexp_extract_all(regexp_replace(html, '\.<(/?[a-zA-Z])', chr(46) || chr(1) || '\1', 'g'), "
    r"'</?[a-zA-Z][^>]*>|<!--.*?-->'))"
)


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


def _dense(column: str, pattern: str) -> str:
    return (
        f"round(case when length({column}) = 0 then 0.0 else (length({column}) - "
        f"length(regexp_replace({column}, '{pattern}', '', 'g')))::double / length({column}) end, 6)"
    )


_FIRST = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{p}'" for p in PHRASES) + " end"
_HASHED = "with h as (select doc_id, sha256(text) as h from documents where text is not null)"
_TWIN = _HASHED + ", g as (select h, min(doc_id) as first from h group by h having count(*) > 1)"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '" + _SPACES + "+'), lambda x: x <> '')"
_RUNS = (
    f"w as (select doc_id, {_WORDS} as w from documents), s as (select doc_id, case when len(w) = 0 then []::varchar[] "
    "when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), "
    "lambda i: array_to_string(w[i:i + 4], ' '))) end as runs from w)"
)
_A, _C = minhash.family(128)
_FAMILY = f"f as (select unnest({_A}) as a, unnest({_C}) as c, unnest(range(128)) as i)"
_SIGNED = (
    f"with {_RUNS}, {_FAMILY}, r as (select doc_id, ('0x' || md5(unnest(runs))[1:7])::bigint as h from s), "
    f"m as (select doc_id, i, min((a * h + c) % {minhash.PRIME}) as m from r, f group by doc_id, i)"
)
_B, _R = minhash.band_shape(0.8, 128)
_BANDED = (
    _SIGNED + f", k as (select doc_id, i // {_R} as band, string_agg(m::varchar, ',' order by i) as key from m "
    f"where i < {_B * _R} group by doc_id, i // {_R}), sh as (select band, key, min(doc_id) as first from k "
    "group by band, key having count(*) > 1), c as (select distinct first, doc_id from k join sh using (band, key))"
)
_REMOVED = (
    _BANDED + ", nd as (select distinct doc_id from c), ex as (select doc_id from (select doc_id, row_number() over "
    "(partition by sha256(text) order by doc_id) as n from documents where text is not null) where n > 1), "
    "f1 as (select doc_id, doc_id in (select doc_id from ex) as exact_duplicate, doc_id in (select doc_id from nd where "
    "doc_id <> (select min(doc_id) from nd)) as near_duplicate, length(text) < 50 or length(text) > 10000 as text_length, "
    + " + ".join(_n(p) for p in _PII.values())
    + f" > 0 as pii, {_FIRST} is not null or {_dense('text', _URL)} > 0.1 or {_dense('text', _PII['email'])} > 0.05 "
    "as boilerplate from documents)"
)
_CHECKS = [
    ("missing_field", "missing", "error", _MISSING),
    ("text_length", "short", "warning", "length(text) < 50"),
    ("text_length", "long", "warning", "length(text) > 10000"),
    ("html", "tagged", "warning", _TAGS.replace("html", "text") + " >= 5"),
    ("exact_duplicate", "twin", "warning", "doc_id in (select doc_id from h join g using (h))"),
    ("pii", "found", "warning", " + ".join(_n(p) for p in _PII.values()) + " > 0"),
    ("boilerplate", "phrase", "info", f"{_FIRST} is not null"),
    ("boilerplate", "urls", "warning", _dense("text", _URL) + " > 0.1"),
    ("boilerplate", "emails", "warning", _dense("text", _PII["email"]) + " > 0.05"),
]
_NARROW = (
    "regexp_replace(regexp_replace(@, '[ \\t]{3,}', '  ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')"
)
_CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]"


def _narrow(column: str) -> str:
    return _STRIPPED.replace("@", _NARROW.replace("@", column))


#: Texts as the cleaner leaves them: these tables have nothing for its other steps.
_CLEANED = "cleaned as (select * replace (" + _narrow("text") + " as text) from documents), "


def _of_cleaned(sql: str) -> str:
    """A query over documents, over the cleaned texts instead."""
    first = "with recursive " if sql.startswith("with recursive ") else "with "
    return first + _CLEANED + sql.removeprefix(first).replace("from documents", "from cleaned")


_KEPT, _LEAD = language_model.KEPT, language_model.MARGIN
_LANGUAGES = (
    "with t as (select doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' as s from documents), "
    "g as materialized (select doc_id, lang, unnest(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) as g from t), "
    "c as (select lang, g, count(*) as n from g where lang is not null group by lang, g), z as (select lang, sum(n) as z from c group by lang), "
    f"k as (select * from (select *, row_number() over (partition by lang order by n desc, g) as r from c) where r <= {_KEPT}), "
    "u as (select distinct g from k), v as (select count(*) as v from u), "
    "w as materialized (select z.lang, u.g, round(1000 * ln((coalesce(n, 0) + 1)::double / (z + v)::double))::bigint as w "
    "from z cross join u cross join v left join k on k.lang = z.lang and k.g = u.g), "
    "s as (select doc_id, w.lang, sum(w)::bigint as s, count(*) as known from g join w using (g) group by doc_id, w.lang), "
    "m as (select doc_id, count(*) as n from g group by doc_id), "
    "o as (select *, row_number() over (partition by doc_id order by s desc, lang) as r from s), "
    "p as (select doc_id, max(known) as known, max(lang) filter (r = 1) as lang, max(s) filter (r = 1) - max(s) filter (r = 2) as lead from o "
    "group by doc_id) "
    f"select doc_id, case when known >= {language_model.LEAST} and 2 * known >= n and coalesce(lead, {_LEAD} * known) >= {_LEAD} * known "
    f"then p.lang end as guess, coalesce(known, 0) as known, coalesce(lead, coalesce({_LEAD} * known, 0)) as lead "
    "from documents left join m using (doc_id) left join p using (doc_id)"
)

#: Checks of the report before and after a fix, with the SQL of their flags over (doc_id, text).
_REPORTED = [(c, i, v, p) for c, i, v, p in _CHECKS if c not in ("exact_duplicate", "boilerplate", "pii")]
_REPORTED += [("exact_duplicate", "twin", "warning", "doc_id in (select doc_id from tw)")]
_REPORTED += [("near_duplicate", "alike", "warning", "doc_id in (select doc_id from c)")]
_REPORTED += [x for x in _CHECKS if x[0] in ("pii", "boilerplate")]


def _report(phase: str, table: str) -> str:
    """One row for each flag that some row of a table of cleaned or other texts has."""
    twins = f"tw as (select doc_id from (select doc_id, count(*) over (partition by sha256(text)) as n from {table} where text is not null) where n > 1)"
    flags = " union all ".join(
        f"select '{c}' as checker, '{i}' as issue, '{v}' as severity, doc_id from {table} where {p}" for c, i, v, p in _REPORTED
    )
    return (
        f"select * from ({_BANDED.replace('from documents', f'from {table}')}, {twins}, x as ({flags}) select '{phase}' as phase, checker, severity, "
        f"count(*) as affected_rows, array_to_string(list_sort(array_agg(doc_id))[1:10], ',') as sample, (select count(*) from {table}) as total_rows "
        "from x group by checker, issue, severity)"
    )


#: Rows that go when each cluster of near-duplicates keeps its least row.
_CLUSTERS = (
    _REMOVED.replace("with ", "with recursive ", 1)
    .replace(", nd as (select distinct doc_id from c)", ", e as (select first as a, doc_id as b from c union select doc_id, first from c), "
             "reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a), "
             "nd as (select a as doc_id from reach group by a having a > min(b))")
    .replace("doc_id in (select doc_id from nd where doc_id <> (select min(doc_id) from nd)) as near_duplicate", "doc_id in (select doc_id from nd) as near_duplicate")
)
_ANY = " or ".join(REMOVING)

ORACLE_SQL: dict[str, str] = {
    "load_documents": "select doc_id, row_number() over () - 1 as row_id, length(text) as length from documents",
    "row_positions": "select count(*) as total_rows, count(*) as positions, 0::bigint as least, count(*) - 1 as greatest, "
    "count(distinct doc_id) as documents from documents",
    "mojibake_repaired": "select doc_id, coalesce(regexp_matches(text, '[^\\x00-\\x7F]'), false) as found, md5(text) as digest from documents",
    "language_model_detect": _LANGUAGES,
    "fix_before_after": _of_cleaned(_REMOVED + f" select doc_id, md5(text) as digest from cleaned join f1 using (doc_id) where not ({_ANY})"),
    "fix_report": "with " + _CLEANED.removesuffix(", ") + ", kept as materialized (select doc_id, text from cleaned join ("
    + _CLUSTERS.replace("from documents", "from cleaned") + f" select doc_id from f1 where not ({_ANY})) using (doc_id)) "
    + _report("before", "documents") + " union all " + _report("after", "kept"),
    "scan_project": "select doc_id, lang, source, length(text) as length from documents",
    "sample_n": "select doc_id, source from documents order by md5(doc_id::varchar || ':42'), doc_id limit 100",
    "missing_field_stats": f"select count(*) as total_rows, count(*) filter ({_MISSING}) as missing_count, "
    f"round(count(*) filter ({_MISSING})::double / greatest(count(*), 1), 6) as missing_ratio from documents",
    "missing_field_flags": f"select conv_id, turn, {_MISSING} as missing from conversations",
    "text_length_flags": "select doc_id, coalesce(length(text) < 50, false) as too_short, "
    "coalesce(length(text) > 10000, false) as too_long from documents",
    "text_length_stats": "select count(*) as total_rows, count(*) filter (length(text) < 50) as too_short_count, "
    "count(*) filter (length(text) > 10000) as too_long_count from documents",
    "html_flags": f"select page_id, {_TAGS} as tags, {_TAGS} >= 5 as flagged from pages",
    "html_stats": f"select count(*) as total_rows, count(*) filter ({_TAGS} >= 5) as html_detected_count, "
    f"sum({_TAGS})::bigint as tags from pages",
    "pii_counts": "select doc_id, " + ", ".join(f"{_n(p)} as {k}" for k, p in _PII.items()) + " from documents",
    "pii_types": "select pii_type, count(*) as n from ("
    + " union all ".join(f"select '{k}' as pii_type, unnest(regexp_extract_all(text, '{p}')) as v from documents" for k, p in _PII.items())
    + ") group by pii_type",
    "pii_values": "select pii_type, value, count(*) as n from ("
    + " union all ".join(f"select '{k}' as pii_type, unnest(regexp_extract_all(text, '{p}')) as value from documents" for k, p in _PII.items())
    + ") group by pii_type, value",
    "pii_matches": "with m as ("
    + " union all ".join(
        f"select doc_id, '{k}' as pii_type, regexp_extract_all(text, '{p}') as v, regexp_split_to_array(text, '{p}') as b from documents"
        for k, p in _PII.items()
    )
    + "), i as (select *, unnest(range(1, len(v) + 1)) as i from m), s as (select doc_id, pii_type, v[i] as value, "
    "(length(array_to_string(b[1:i], '')) + length(array_to_string(v[1:i - 1], '')))::bigint as start from i) "
    'select doc_id, pii_type, value, start, start + length(value) as "end" from s',
    "boilerplate_first_match": f"select * from (select doc_id, {_FIRST} as matched_pattern from documents) where matched_pattern is not null",
    "benchmark_phrases": "with b as (select item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:"
    + f"{PHRASE_WORDS}] as w from benchmark where text is not null), p as (select item_id, '(?i)' || array_to_string(list_transform(w, "
    f"lambda x: regexp_escape(x)), '\\s+') as p, array_to_string(w, ' ') as phrase from b where len(w) = {PHRASE_WORDS}) "
    "select doc_id, arg_min(phrase, item_id) as phrase from documents join p on regexp_matches(text, p) group by doc_id",
    "url_density": f"select page_id, {_dense('html', _URL)} as density from pages",
    "email_density": f"select doc_id, {_dense('text', _PII['email'])} as density from documents",
    "control_whitespace": f"select page_id, len(regexp_extract_all(html, '{_CONTROL}')) as controls, "
    "regexp_matches(html, '[ \\t]{3,}') or regexp_matches(html, '\\n{4,}') as excessive from pages",
    "text_hash": "select doc_id, sha256(text) as hash from documents",
    "exact_dup_flags": _TWIN + " select doc_id from h join g using (h)",
    "exact_dup_stats": "select sum(n)::bigint as total_rows, coalesce(sum(n) filter (n > 1), 0)::bigint as duplicate_count, "
    "count(*) as unique_count from (select sha256(text), count(*) as n from documents group by 1)",
    "exact_dup_keep_first": "select doc_id from (select doc_id, row_number() over (partition by sha256(text) order by doc_id) "
    "as n from documents where text is not null) where n > 1",
    "shingle_counts": f"with {_RUNS} select doc_id, len(runs) as n, md5(array_to_string(list_sort(runs), '|')) as digest from s",
    "minhash_signature": _SIGNED + " select doc_id, string_agg(m::varchar, ',' order by i) as signature from m group by doc_id",
    "lsh_candidates": _BANDED + " select first, doc_id from c",
    "near_dup_flags": _BANDED + " select distinct doc_id from c",
    "near_dup_keep": _BANDED + ", nd as (select distinct doc_id from c) select doc_id from nd where doc_id <> (select min(doc_id) from nd)",
    "near_dup_keep_clusters": _BANDED.replace("with ", "with recursive ", 1)
    + ", e as (select first as a, doc_id as b from c union select doc_id, first from c), reach(a, b) as (select a, b from e union "
    "select r.a, e.b from reach r join e on r.b = e.a) select a as doc_id from reach group by a having a > min(b)",
    "language_flags": "select doc_id, coalesce(lang not in ('en'), false) as non_target from documents",
    "token_length_candidates": "select doc_id, strlen(text) as n_bytes from documents where strlen(text) > 1000",
    "control_char_clean": f"select page_id, md5(regexp_replace(html, '{_CONTROL}', '', 'g')) as digest from pages",
    "whitespace_clean": f"select doc_id, md5({_narrow('text')}) as digest from documents",
    "clean_stats": f"with s as (select html as s0, regexp_replace(html, '{_CONTROL}', '', 'g') as s1 from pages), "
    f"t as (select *, {_narrow('s1')} as s2 from s) select count(*) filter (s0 <> s1) as control_chars_removed, "
    "count(*) filter (s1 <> s2) as whitespace_normalized, count(*) filter (s0 <> s2) as total_fixed, count(*) as total_rows from t",
    "row_filter_stats": _REMOVED
    + " select "
    + ", ".join(f"count(*) filter ({c}) as {c}" for c in REMOVING)
    + f", count(*) filter ({' or '.join(REMOVING)}) as total_rows_removed, count(*) filter (not ({' or '.join(REMOVING)})) "
    "as rows_after_filter from f1",
    "row_filter_rows": _REMOVED + f" select doc_id from f1 where not ({' or '.join(REMOVING)})",
    "row_filter_kept": _REMOVED
    + f" select doc_id, lang, source, n_chars from documents join f1 using (doc_id) where not ({' or '.join(REMOVING)})",
    "check_summary": _TWIN
    + " "
    + " union all ".join(
        f"select '{c}' as checker, '{i}' as issue, '{s}' as severity, count(*) filter ({p}) as affected_rows from documents"
        for c, i, s, p in _CHECKS
    ),
    "issue_samples": _TWIN
    + ", x as ("
    + " union all ".join(f"select '{c}' as checker, '{i}' as issue, '{s}' as severity, doc_id from documents where {p}" for c, i, s, p in _CHECKS)
    + ") select checker, severity, count(*) as affected_rows, array_to_string(list_sort(array_agg(doc_id))[1:10], ',') as sample "
    "from x group by checker, issue, severity",
}
assert set(patterns.PII) == set(_PII) and set(ORACLE_SQL) <= set(QUERIES)
