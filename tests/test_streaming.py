"""Exact duplicates over a stream: equal to the batch answer, bounded in time."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators import get_checker
from corpusloom.streaming import exact_duplicates_stream

SCHEMA = "row_id long, text string, ts timestamp"
START = datetime(2024, 1, 1)


def replay(spark, tmp_path, batches, seconds):
    """What a stream tells that gets one file of rows after the other."""
    where = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/{i:03}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(where)
    told = exact_duplicates_stream(stream, seconds)
    query = told.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    assert query.exception() is None
    return {(r.row_id, r.first, r.later) for r in spark.sql("select * from told").collect()}


def test_batches_equal_the_whole_table(spark, tmp_path):
    rng = random.Random(4)
    texts = [rng.choice(["a", "b", "c d", "", None, f"unique {i}", "É"]) for i in range(120)]
    rows = [(i, t, START + timedelta(minutes=i)) for i, t in enumerate(texts)]
    batches = [rows[a:b] for a, b in ((0, 7), (7, 40), (40, 41), (41, 90), (90, 120))]
    got = replay(spark, tmp_path, batches, 86_400)
    table = spark.createDataFrame(rows, SCHEMA)
    _, flags = get_checker("exact_duplicate")().group_measures(table.select("row_id", "text"))
    later = {r.row_id for r in flags.where("later").collect()}
    assert {i for i, _, is_later in got if is_later} == later
    first = {r.text: r.first for r in table.groupBy("text").agg(F.min("row_id").alias("first")).collect()}
    assert got == {(i, first[t], i in later) for i, t, _ in rows if t is not None}


def test_texts_are_forgotten_after_the_bound(spark, tmp_path):
    hours = lambda n: START + timedelta(hours=n)
    batches = [
        [(1, "x", hours(0)), (2, "y", hours(0))],
        [(3, "x", hours(1))],  # known, and known longer for it
        [(4, "z", hours(3))],
        [(5, "z", hours(9))],  # moves the watermark on
        [(6, "w", hours(10))],
        [(7, "x", hours(11)), (8, "z", hours(10))],  # x was forgotten, z was seen lately
    ]
    got = replay(spark, tmp_path, batches, 7_200)
    assert {(3, 1, True), (8, 4, True)} <= got or {(3, 1, True), (8, 5, True)} <= got
    assert (7, 7, False) in got
