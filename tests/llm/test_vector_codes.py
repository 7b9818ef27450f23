"""Vector codes against brute force: trees, ties, great values, odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import vector_codes as vc


def brute(points, x):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for p in points] for q in x]
    return [r.index(min(r)) for r in d], [min(r) for r in d]


@pytest.mark.parametrize(("n", "spread"), [(1, 5), (7, 2), (40, 1), (200, 3), (256, 400)])
def test_tree_finds_the_first_nearest(n, spread):
    rng = np.random.default_rng(n)
    points = rng.integers(-spread, spread + 1, (n, 5)).astype(np.float64)  # small spreads give many ties
    x = rng.integers(-spread, spread + 1, (120, 5)).astype(np.float64)
    index, far = vc.VantageTree(points).nearest(x)
    want = brute(points, x)
    assert index.tolist() == want[0] and far.tolist() == want[1]


def test_tree_of_equal_points_and_of_great_integers():
    same = np.zeros((50, 3))
    index, far = vc.VantageTree(same).nearest(np.ones((4, 3)))
    assert index.tolist() == [0] * 4 and far.tolist() == [3] * 4
    rng = np.random.default_rng(3)
    points = np.array([[10**18 + int(v) for v in row] for row in rng.integers(-3, 4, (60, 3))], dtype=object)
    index, far = vc.VantageTree(points).nearest(points[:20])
    assert (index.tolist(), far.tolist()) == brute(points, points[:20])


def test_integers_floor_and_hold():
    assert vc.integers(np.array([[0.5, -0.0001, -1.0]])).tolist() == [[512, -1, -1024]]
    assert vc.integers(np.array([[1e38, -1e38, 1.0]])).tolist() == [[vc.HELD, -vc.HELD, 1024]]
    assert vc.cuts(10, 4) == [0, 3, 6, 8, 10]


def reference(rows, entries, rounds):
    """(vec_id, code, error, label_error, digest), by loops over Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(1024 * float(v))) for v in r[1]] for r in rows]
    at = vc.cuts(len(x[0]), 4)
    parts = [[v[a:b] for v in x] for a, b in zip(at, at[1:])]
    books = [p[:entries] for p in parts]
    for turn in range(rounds + 1):
        found = [brute(b, p) for b, p in zip(books, parts)]
        if turn == rounds:
            break
        for i, (book, part, (codes, _)) in enumerate(zip(books, parts, found)):
            own = defaultdict(list)
            for c, v in zip(codes, part):
                own[c].append(v)
            books[i] = [[sum(col) // len(own[e]) for col in zip(*own[e])] if e in own else book[e] for e in range(len(book))]
    code = ["".join(f"{f[0][i]:02x}" for f in found) for i in range(len(rows))]
    error = [sum(f[1][i] for f in found) for i in range(len(rows))]
    by = defaultdict(int)
    for r, e in zip(rows, error):
        by[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(r[0]), c, e, by[r[2]], digest) for r, c, e in zip(rows, code, error))


def test_whole_operator(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.normal(size=9), 2).astype(np.float32).tolist(), int(i % 3) if i % 4 else None) for i in range(90)]
    rows += [rows[5], rows[5], (None, rows[7][1], 1), (3, [0.0] * 9, 2)]
    odd = [(200, None, 1), (201, [float("nan")] * 9, 1), (202, [None] + [1.0] * 8, 1), (203, [float("inf")] * 9, 1)]
    df = spark.createDataFrame(
        [(i, v, lab, "x", 1) for i, v, lab in rows + odd], "vec_id long, embedding array<float>, label int, code string, of int"
    ).repartition(3)
    got = vc.compress(df, entries=20, rounds=3)
    assert got.columns == ["id", "label", "code", "error", "codebooks_sha256", "label_error"]
    found = sorted((str(r["id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())
    assert found == reference(rows, 20, 3)
    assert vc.compress(df.limit(0)).count() == 0


def test_lengths_apart_and_great_values(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.5], 0), (3, [], 0), (4, [3e38, -3e38, 1.0, 1.0], 1), (5, [0.0, 0.0, 0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["id"]: r for r in vc.compress(df, entries=1).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[3]["code"] == "00000000" and got[3]["error"] == 0 and got[3]["codebooks_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["error"] == vc.GREATEST and got[4]["label_error"] == vc.GREATEST
    assert got[1]["error"] + got[2]["error"] == 256**2 * 2
