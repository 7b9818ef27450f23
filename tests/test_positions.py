"""Positions of rows on any table, and what stands on them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.config import CheckerConfig
from corpusloom.functions import text as T
from corpusloom.operators.cleaner import TextCleaner
from corpusloom.operators.row_filter import RowFilter
from corpusloom.plans.runner import CheckRun, check_table, fix_table
from corpusloom.sources.loader import sample, with_row_id

DATA = "/root/testdata/sf0.1"


@pytest.fixture
def defaults(spark):
    """The session with Spark's own sizes of partitions, and small ones, so that partitions are merged."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "200")
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["64m", "2m", "100k"])
def test_no_row_is_lost_on_any_plan(defaults, size):
    spark = defaults
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    langs = docs.groupBy("lang").agg(F.count("*").alias("count"))
    for df in (docs, docs.repartition("doc_id"), docs.join(langs, "lang"), docs.select("lang", "source", "n_chars").distinct(),
               docs.where("n_chars > 2000"), docs.union(docs), docs.limit(0), docs.withColumnRenamed("source", "row_id")):
        placed = with_row_id(df)
        n, distinct, least, most = placed.agg(F.count("*"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()
        assert n == distinct == df.count() and (n == 0 or (least, most) == (0, n - 1))
        assert [c for c in placed.columns if c != "row_id"] == [c for c in df.columns if c != "row_id"]


def test_positions_are_those_of_the_file(spark, tmp_path):
    rows = [(f"t{i}", i) for i in range(1000)]
    spark.createDataFrame(rows, "text string, of int").coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "one"))
    placed = with_row_id(spark.read.parquet(str(tmp_path / "one")))
    assert all(r.of == r.row_id for r in placed.collect()) and placed.count() == 1000
    again = with_row_id(spark.read.parquet(str(tmp_path / "one")).repartition(7))
    assert {r.of: r.row_id for r in again.collect()} == {r.of: r.row_id for r in again.repartition(3).collect()}  # fixed once


def test_cleaning_and_sampling_keep_rows(defaults):
    spark = defaults
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition("doc_id")
    _, stats = TextCleaner().fix_dataset(with_row_id(docs), "text")
    assert stats["total_rows"] == 10_000
    assert sample(docs, 500).select("doc_id").distinct().count() == 500


def corpus(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 60))) for _ in range(60)]
    texts += texts[:9] + [t + " and a little more" for t in texts[10:25]] + ["short", "short", "", None]
    texts += [f"{t} someone@example.com" for t in texts[30:34]] + ["<p>a</p>" * 9 + texts[3], "Copyright 2020 " + texts[4]]
    rng.shuffle(texts)
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("policy", ["global_min", "per_cluster"])
def test_the_report_after_equals_a_full_run(spark, policy):
    """What is reused and made again after removal is what a run over the kept rows finds."""
    config = CheckerConfig(near_dup_keep=policy, skip_checkers=["token_length"])
    df = corpus(spark)
    fixed, stats, after = fix_table(df, "text", config, "doc_id")
    full = check_table(fixed, "text", config, "doc_id")
    assert after.outcome.stats == full.outcome.stats and after.outcome.records == full.outcome.records
    assert after.total_rows == full.total_rows == stats["filter_stats"]["rows_after_filter"] < df.count()
    # Only some duplicates go: the groups that are left lose members, and single ones are duplicates no more.
    run = CheckRun(df, "text", config, "doc_id")
    gone = df.where("doc_id % 3 = 0").select(F.col("doc_id").alias("row_id"))
    left = run.without(gone)
    again = check_table(df.where("doc_id % 3 <> 0"), "text", config, "doc_id").outcome
    assert left.stats == again.stats and left.records == again.records
    removed, counts = RowFilter(config).removed(run.annotated, run.links() if policy == "per_cluster" else None)
    assert removed.count() == counts["total_rows_removed"]


def test_many_matches_in_one_text_are_linear(spark):
    text = " ".join(f"user{i}@example.com 192.168.{i % 256}.1" for i in range(50_000))
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "at 10.0.0.1 and 123-45-6789")], "row_id long, text string")
    began = time.time()
    got = df.select("row_id", F.explode(T.detect_pii(F.col("text"))).alias("m")).select("row_id", "m.*").collect()
    assert time.time() - began < 60
    assert sum(r.row_id == 1 for r in got) >= 100_000
    texts = {1: text, 4: "at 10.0.0.1 and 123-45-6789"}
    assert all(texts[r.row_id][r.start : r.end] == r.value for r in got)
    assert [(r.pii_type, r.value) for r in got if r.row_id == 4] == [("ssn", "123-45-6789"), ("ip_address", "10.0.0.1")]


def test_no_task_takes_all_texts_of_a_language(spark):
    """Counts of languages are broadcast: texts are never dealt by language."""
    from corpusloom.plans import catalogue

    seen = []
    own = catalogue.with_row_id
    catalogue.with_row_id = lambda df: seen.append(df) or own(df)
    try:
        row = catalogue.row_positions(spark, "/root/testdata/sf0.001").first()
    finally:
        catalogue.with_row_id = own
    assert row["total_rows"] == row["positions"] == row["documents"] and row["least"] == 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
