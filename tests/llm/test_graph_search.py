"""Graph search against brute force: recall, scores, order, and odd vectors."""

import numpy as np

from corpusloom.llm import graph_search as gs

DATA = "/root/testdata/sf0.1"


def test_recall_on_embeddings(spark):
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    got = {}
    for r in gs.op10_graph_search(spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = total = 0
    place = {i: n for n, i in enumerate(ids.tolist())}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        score = x @ x[place[q]]
        assert all(abs(s - score[place[v]]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        order = sorted((i for i in ids.tolist() if i != q), key=lambda i: (-score[place[i]], i))[:20]
        hits += len(set(order) & {v for _, v, _ in found})
        total += 20
    assert hits / total >= 0.95


def test_larger_clustered_shard():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 24)) * 3
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24))
    x *= rng.uniform(0.5, 2, size=(3000, 1))  # norms matter for inner products
    found = gs.Graph(x).search(x[:200])
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(t) & set(f)) / 20 for t, f in zip(truth.tolist(), found.tolist())]) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [
        (100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, [None, 1.0]), (200, []), (None, [1.0, 1.0]),
        (220, [1.0, 0.0, 0.0]), (240, [4.0, 1.0]), (240, [4.0, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, 1.0, 7) for i, v in rows], "vec_id long, embedding array<float>, score double, shard int")
    from pyspark.sql import functions as F

    asks = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    got = {}
    for r in gs.search(df, asks).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40, 240]
    found = sorted(got[20])
    assert [f[1] for f in found] == [240, 240, *range(18)]
    assert gs.search(df.limit(0), asks).count() == 0


def test_recall_over_several_shards(spark, monkeypatch):
    """Clustered vectors of uneven norms, one of them very common, in three shards and more."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    n = 21_000
    x = (rng.normal(size=(60, 16)) * 2)[rng.integers(0, 60, n)] + rng.normal(size=(n, 16))
    x = (x * rng.uniform(0.6, 1.6, size=(n, 1))).astype(np.float32).astype(float)
    common = rng.permutation(n)[:3000]
    x[common] = x[common[0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    monkeypatch.setattr(gs, "QUERIES_A_TASK", 80)  # queries of a shard in several tasks
    out = gs.search(df, F.col("vec_id") % 100 == 0, shard_nodes=6000)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == list(range(0, n, 100))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        truth = np.lexsort((np.arange(n), -score))[:20]
        hits += len(set(truth.tolist()) & {v for _, v in found})
    assert hits / (20 * len(got)) >= 0.9
