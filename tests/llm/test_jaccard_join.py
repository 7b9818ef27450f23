"""Jaccard components against brute force: signatures, streaming runs, hot groups, odd rows."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import jaccard_join as jj


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(
        ((d, len(s), min(least[root(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str
    )


def found(df, **kw):
    got = jj.components(df, **kw)
    assert got.columns == ["id", "n_shingles", "component_id"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("percent", [60, 85, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    bands = jj.Bands(percent)
    for size in [*range(1, 60), 97, 150, 400, 1000]:
        for _ in range(6):
            one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            # As many changes as the measure allows: some taken away, some put in.
            gone = int(rng.integers(0, size))
            fresh = rng.integers(0, 1 << 63, int(rng.integers(0, size + 1))).astype(np.uint64)
            while True:
                two = np.unique(np.concatenate([one[gone:], fresh]))
                both = len(np.intersect1d(one, two))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    break
                gone, fresh = (gone - 1, fresh) if gone and rng.integers(0, 2) else (gone, fresh[:-1]) if len(fresh) else (gone - 1, fresh)
            assert set(jj.signatures(one, bands).tolist()) & set(jj.signatures(two, bands).tolist()), (size, len(two), both)


def test_bands_cover_all_similar_sizes():
    bands = jj.Bands()
    for a in range(1, 700):
        for b in range(a, a * 100 // 85 + 1):
            assert set(bands.of(a)) & set(bands.of(b)), (a, b)
            for band in set(bands.of(a)) & set(bands.of(b)):
                most = min(a, (a + b) * 85 // 185 + 1)
                while 100 * most >= 85 * (a + b - most):
                    most -= 1
                assert a + b - 2 * (most + 1) <= bands.differ(band)


def test_runs_over_batches():
    rng = np.random.default_rng(0)
    rows = sorted({(int(s), int(v)) for s, v in rng.integers(0, 12, (90, 2))} | {(99, 1), (100, 5), (101, 1), (101, 2)})
    rows = sorted(rows + rows[3:9] + [(s + 200, v) for s, v in rows if s < 5])  # rows and runs again
    runs = defaultdict(set)
    for s, v in rows:
        runs[s].add(v)
    want = {(min(vs), frozenset(vs)) for vs in runs.values() if len(vs) > 1}
    for step in (1, 2, 7, 40, 200):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a : a + step]], type=pa.int64()) for i in (0, 1)], names=["sig", "v"])
            for a in range(0, len(rows), step)
        ]
        got = defaultdict(list)
        for r in (r for b in jj._shared(iter(batches)) for r in b.to_pylist()):
            got[r["key"], r["first"]].append(r["v"])
        assert all(len(vs) == len(set(vs)) for vs in got.values())
        assert {(first, frozenset(vs)) for (_, first), vs in got.items()} == want
    assert len(got) < len([r for r in runs.values() if len(r) > 1])  # equal runs are told once


def test_sketches_never_exclude_similar_sets():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 700, 40_000):
        one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for share in (0.0, 0.05, 0.14, 0.5, 1.0):
            two = np.unique(np.concatenate([one[int(share * size) :], rng.integers(0, 1 << 63, int(share * size / 3)).astype(np.uint64)]))
            x, y = jj.folded([jj.sketch(one), jj.sketch(two)])
            differ = len(np.setxor1d(one, two))
            assert np.bitwise_count(x ^ y).sum() <= differ
            both = len(np.intersect1d(one, two))
            if 100 * both >= 85 * (len(one) + len(two) - both):
                assert differ <= jj.may_differ(np.int64(len(one) + len(two)), 85)
    assert jj.may_differ(np.int64(185), 85) == 15


def test_overlap_counts_words():
    assert jj.overlap(b"a b c d e", b"A B\tC d x") == (1, 3)
    assert jj.overlap(b"a b", b"a b") == (1, 1)
    assert jj.overlap(b"a b c", b"a b c d") == (0, 2)
    assert jj.overlap(b"", b"a") == (0, 1)


def edited(rng, words, vocab, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(vocab)
    return " ".join(words)


def test_components_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):  # an original and edits of it, some of them edits of edits
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 160))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 7)):
            base = edited(rng, base, vocab, rng.randrange(0, 4)).split()
            rows.append(" ".join(base))
    rows += [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(40)]
    rows = list(enumerate(rows, 10))
    rows += [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one\x0bTWO"), (6, "one two three"), (7, "x" * 5000), (8, "É é"),
             (9, "é É"), (None, rows[0][1]), (None, "nobody else"), (None, None), (12, rows[5][1]), (12, rows[5][1]), (12, "a b c d e f")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, label string, v int, sig int")
    assert found(df.repartition(4)) == brute(rows)
    assert jj.components(df.limit(0)).count() == 0


def test_hot_runs_of_texts_that_do_not_link(spark):
    """A template shared by many texts: close below the threshold, at it, and linked only by a chain."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(90):
        own = [f"own{i}_{j}" for j in range(rng.choice([6, 9, 14, 25]))]
        rows.append(" ".join(template + own))
    for i in range(20):  # a chain: each next text drops some and adds some
        rows.append(" ".join(template[i:] + [f"c{j}" for j in range(2 * i)]))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert found(df, block=4) == want
    assert found(df) == want
    assert len({c for _, _, c in want}) > 40
