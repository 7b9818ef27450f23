"""Connected components of a table of links, without gathering them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.session import materialise, ship_package

#: Links that one task reduces to a forest; also rows of a written table for each of its files.
LINKS_A_TASK = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's links with the least node that it reaches by them."""
    up: dict = {}

    def root(x):
        at = x
        while up[at] != at:
            at = up[at]
        while up[x] != at:
            up[x], x = at, up[x]
        return at

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(up), type=kind), pa.array([root(x) for x in up], type=kind)], names=["v", "label"]
        )


def connected_components(links: DataFrame) -> DataFrame:
    """(v, label) of each node of a table of links (v1, v2); label is the least node reached.

    Each task first reduces at most about ``LINKS_A_TASK`` links to a forest,
    each node pointing to the least it reaches.  Where one task holds all links
    that is the result.  Otherwise each round gives a node the least label among
    itself and its neighbours: one join and one partially aggregated sum, which
    adaptive execution splits where a node has very many links.  From the third
    round on, a node also takes the label of its label, so that long chains
    shorten to half.  Every round is written to the shared folder, so lineage
    stays short.
    """
    ship_package(links.sparkSession)
    links = links.select("v1", "v2").where("v1 <> v2")
    tasks = max(1, -(-links.count() // LINKS_A_TASK))
    kind = links.schema["v1"].dataType.simpleString()
    forest = links.coalesce(tasks).mapInArrow(_forest, f"v {kind}, label {kind}")
    forest = materialise(forest, "forest")
    if tasks == 1:
        return forest
    both = forest.select(F.col("v").alias("v1"), F.col("label").alias("v2"))
    both = both.union(both.select("v2", "v1")).where("v1 <> v2").distinct()
    edges = materialise(both, "edges")
    first = edges.groupBy(F.col("v1").alias("v")).agg(F.min("v2").alias("near"))
    labels = materialise(first.select("v", F.least("v", "near").alias("label")).coalesce(tasks), "labels")
    turn = 0
    while True:
        turn += 1
        heard = edges.join(labels.withColumnRenamed("v", "v2"), "v2").select(F.col("v1").alias("v"), "label")
        said = heard.withColumn("own", F.lit(None).cast(labels.schema["label"].dataType))
        if turn > 2:
            jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
            far = labels.join(jump, "label").select("v", F.col("far").alias("label"))
            said = said.union(far.withColumn("own", F.lit(None).cast(labels.schema["label"].dataType)))
        said = said.union(labels.select("v", "label", F.col("label").alias("own")))
        stepped = said.groupBy("v").agg(F.min("label").alias("label"), F.min("own").alias("own"))
        stepped = materialise(stepped.coalesce(tasks), "labels")
        labels = stepped.select("v", "label")
        if stepped.where("label <> own").isEmpty():
            return labels
