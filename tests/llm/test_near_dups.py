"""Near-duplicates against all pairs by brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import near_dups as nd

DATA = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        up = row[:]
        for j, y in enumerate(b):
            row[j + 1] = up[j] + 1 if x == y else max(up[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.integers(0, 30), st.integers(0, 30), st.floats(0.5, 0.95))
def test_alignment(a, i, j, threshold):
    for b in (a[:i] + a[i + 1 :], a[:i] + [9] + a[i:], a[j:] + a[:j], a[:i] + [7, 7] + a[j:]):
        got = nd.aligned(a, b, threshold)
        m = lcs(a, b)
        want = m / (len(a) + len(b) - m) if a and b else 0.0
        assert (got >= threshold) == (want >= threshold)
        assert got in (0.0, want) or want < threshold


def brute(rows):
    """Classes by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    grams = []
    for t in texts:
        w = t.lower().split()
        grams.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)) > 0:
                m = lcs(a, b)
                if m >= 0.8 * (len(a) + len(b) - m):
                    up[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    ids = {}
    for i, t in rows:
        if i is not None:
            ids[at[t or ""]] = min(i, ids.get(at[t or ""], i))
    return [(i, ids.get(at[t or ""])) for i, t in rows]


def test_documents_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.class_id) for r in nd.op1_near_duplicates(spark, DATA).collect())
    assert got == sorted(brute(rows))
    assert any(i != c for i, c in got)


def test_families_whose_copies_link_only_through_others(spark):
    rng = random.Random(3)
    rows = []
    for f in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(50):
            w = base[:]
            for _ in range(2):
                w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (1, None), (2, ""), (None, ""), (None, "a b c"), (None, "A  b c"), (7, "x " * 30_000), (7, "x " * 30_000)],
        [(None, "one"), (3, "two"), (3, "two"), (4, "two")],
    ],
)
def test_edge_tables(spark, rows):
    df = spark.createDataFrame([(i, t, "v", 1.5) for i, t in rows], "doc_id long, text string, v string, n double")
    got = [(r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    classes = len({" ".join((t or "").lower().split()) for _, t in rows})
    assert len(texts) == classes


def test_sketch_keeps_order():
    import numpy as np

    a = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = (nd.order_minhash(a) == nd.order_minhash(a.copy())).mean()
    turned = (nd.order_minhash(a) == nd.order_minhash(a[::-1].copy())).mean()
    assert same == 1 and turned < 0.3


def test_pairs_among_many_documents_of_one_template(spark):
    rng = random.Random(5)
    template = [f"t{i}" for i in range(204)]
    rows, twins = [], {}
    for i in range(1000):
        own = [f"o{rng.randrange(10**9)}" for _ in range(28)]
        if i >= 900:  # shares five words with one other document: 205 of 251 grams, other pairs 200 of 256
            twins[i] = i - 900
            own[:5] = rows[i - 900][1].split()[204:209]
        rows.append((i, " ".join(template + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    assert got == {i: twins.get(i, i) for i in range(1000)}


def test_bound_never_excludes_a_link():
    import numpy as np

    rng = random.Random(9)
    for n in (6, 40, 300, 9000):
        base = [f"w{rng.randrange(n // 2)}" for _ in range(n)]
        for edits in (1, n // 60, n // 45, n // 20):
            w = base[:]
            for _ in range(edits):
                w[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            if nd.similarity(" ".join(base), " ".join(w)) >= 0.8:
                x, y = (np.frombuffer(nd.parity(" ".join(t)), dtype=np.uint8) for t in (base, w))
                assert np.bitwise_count(x ^ y).sum() <= (2 * n - 8) * 0.2 / 1.8 + 1e-6


def test_sketch_of_a_text_and_its_copy_with_a_doubled_sentence(spark):
    rng = random.Random(2)
    rows = []
    for f in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(2 * f, " ".join(words)), (2 * f + 1, " ".join(words[:40] + words[28:40] + words[40:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(nd.similarity(rows[2 * f][1], rows[2 * f + 1][1]) >= 0.8 for f in range(10))
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == {i: i - i % 2 for i in range(20)}


@pytest.mark.parametrize("block", [nd.BLOCK, 100])
def test_pairs_that_meet_only_in_one_large_bucket(spark, block):
    """300 pairs among texts that all share one long passage, which fills the sketches."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(170)]
    rows = []
    for i in range(300):
        both = [f"b{rng.randrange(10**9)}" for _ in range(14)]
        rows += [(2 * i + k, " ".join(passage + both + [f"o{rng.randrange(10**9)}" for _ in range(20)])) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = nd.node_classes(df, block=block).select(nd._id_of(nd.F.col("v")), nd._id_of(nd.F.col("label"))).collect()
    assert {i: c for i, c in found} == {i: i - i % 2 for i in range(600)}


def test_names_of_nodes_sort_by_id(spark):
    ids = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1, None]
    df = spark.createDataFrame([(i, b"\1" * 16) for i in ids], "i long, d binary")
    got = df.select("i", nd._node(nd.F.col("i"), nd.F.col("d")).alias("v")).orderBy("v").select("i", nd._id_of(nd.F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(i, i) for i in ids]
