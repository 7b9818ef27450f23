"""Repeated strings against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import substrings as ss


def brute(texts, span=400):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if times[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6))
def test_suffix_array_and_prefixes(parts):
    s = ss.SuffixShard(parts, span=5)
    suffixes = [(parts[p][i:], p) for p in range(len(parts)) for i in range(len(parts[p]))]
    order = sorted(range(len(suffixes)), key=lambda i: (suffixes[i][0], suffixes[i][1]))
    assert s.sorted.tolist() == order
    common = s.prefixes().tolist()
    for r in range(1, len(order)):
        a, b = suffixes[order[r - 1]][0], suffixes[order[r]][0]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[r] == min(n, 5)
    times = Counter(p[i : i + 5] for p in parts for i in range(len(p) - 4))
    want = [len(x) >= 5 and times[x[:5]] > 1 for x, _ in suffixes]
    assert s.repeated().tolist() == want


@settings(max_examples=200, deadline=None)
@given(*[st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=4)] * 2)
def test_merging_by_binary_search(one, two):
    a, b = ss.SuffixShard(one, span=5), ss.SuffixShard(two, span=5)
    there = {p[i : i + 5] for p in two for i in range(len(p) - 4)}
    want = [len(p) - i >= 5 and p[i : i + 5] in there for p in one for i in range(len(p))]
    assert a.found_in(b).tolist() == want


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    passage = bytes(rng.randrange(256) for _ in range(900))
    one = bytes(rng.randrange(256) for _ in range(777)) + passage + b"end"
    two = passage + bytes(rng.randrange(256) for _ in range(500))
    by = []
    for d in (one, two):
        h, a, b = ss.anchors(d)
        assert a[0] == 0 and b[-1] == len(d) - 400 and (a[1:] == b[:-1] + 1).all()
        by.append({s: x for x, f, t in zip(h.tolist(), a, b) for s in range(f, t + 1)})
    assert all(by[0][777 + s] == by[1][s] for s in range(501))


def make_texts():
    rng = random.Random(5)

    def word():
        return "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))

    def prose(n):
        return " ".join(word() for _ in range(n))

    shared = [prose(90), prose(150), prose(300)]
    whole = prose(200)
    texts = [None, "", "short", "short", whole, whole, whole, prose(40), "x" * 1500, "ab" * 900, shared[0][:399]]
    for i in range(40):
        s = shared[i % 3]
        texts.append(prose(rng.randrange(5, 80)) + s[rng.randrange(30) :] + prose(rng.randrange(5, 80)) + (s if i % 5 == 0 else ""))
    return texts


@pytest.mark.parametrize("shard_bytes", [2 << 20, 3000])
def test_table_against_all_windows(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(ss, "SHARD_BYTES", shard_bytes)
    texts = make_texts()
    df = spark.createDataFrame([(i if i != 7 else None, t, "v", 1) for i, t in enumerate(texts)], "doc_id long, text string, v string, ranges int")
    cut = ss.cut_repeats(df, "cut").collect()
    got = [
        (r.doc_id, len((r.text or "").encode()), r.cut.n_removed, r.cut.n_spans, hashlib.sha256(bytes(r.cut.kept)).hexdigest())
        for r in cut
    ]
    want = [(i if i != 7 else None, *w) for i, w in enumerate(brute(texts))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_in_steps(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 5000, dtype=np.uint8).tobytes()
    whole = ss.anchors(data)
    monkeypatch.setattr(ss, "STEP", 700)
    stepped = ss.anchors(data)
    for x in (whole, stepped):
        assert x[1][0] == 0 and x[2][-1] == len(data) - 400
    at = [{s: h for h, a, b in zip(*map(np.ndarray.tolist, x)) for s in range(a, b + 1)} for x in (whole, stepped)]
    assert at[0] == at[1]


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (2, "é" * 300), (2, "é" * 300), (None, "é" * 299 + "x")]])
def test_edge_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ss.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    if rows:
        assert sorted((r.text for r in out.collect()), key=str) == sorted([None, None, "", "", "x"], key=str)


def brute_rows(rows):
    return sorted((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows])))


DATA = "/root/testdata/sf0.001"


def test_query_against_all_windows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = ss.op2_suffix_array(spark, DATA)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute_rows(rows)


@pytest.mark.parametrize("merge_shards, grids", [(1000, ()), (2, (42, 6, 1)), (0, (42, 6, 1)), (0, (1,))])
def test_documents_in_many_shards(spark, merge_shards, grids):
    """Small shards, so that contexts are merged in pairs, and cut in classes."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    cut = ss.cut_repeats(docs, "cut", shard_bytes=1500, merge_shards=merge_shards, grids=grids).collect()
    got = [
        (r.doc_id, len(r.text.encode()), r.cut.n_removed, r.cut.n_spans, hashlib.sha256(bytes(r.cut.kept)).hexdigest())
        for r in cut
    ]
    assert sorted(got) == brute_rows(rows)


def test_hot_passage_with_many_edges(spark):
    """One passage in many texts, cut off at any place: many contexts of each of its anchors."""
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passage = prose(110)
    texts = [prose(rng.randrange(30)) + passage[rng.randrange(150) : 560 + rng.randrange(120)] + prose(30) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shards in ({}, {"shard_bytes": 4000, "merge_shards": 2}):
        cut = ss.cut_repeats(df, "cut", **shards).collect()
        got = [(r.doc_id, len(r.text), r.cut.n_removed, r.cut.n_spans, hashlib.sha256(bytes(r.cut.kept)).hexdigest()) for r in cut]
        assert sorted(got) == brute_rows(list(enumerate(texts)))


def test_very_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcd ") for _ in range(1_300_000))
    df = spark.createDataFrame([(1, long), (2, "x" + long[700_000:701_000] + "y")], "doc_id long, text string")
    got = {r.doc_id: (r.cut.n_removed, r.cut.n_spans) for r in ss.cut_repeats(df, "cut").collect()}
    assert got == {1: (1000, 1), 2: (1000, 1)}


def brute_passages(texts, span=400, words=50):
    """(n_removed, n_spans, sha256) once equal strings and the words of equal runs are gone."""
    data = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    runs = [[tuple(d[a:b] for a, b in w[i : i + words]) for i in range(len(w) - words + 1)] for d, w in zip(data, at)]
    strings = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    passages = Counter(r for of in runs for r in of)
    out = []
    for d, w, of in zip(data, at, runs):
        ranges = [(i, i + span) for i in range(len(d) - span + 1) if strings[d[i : i + span]] > 1]
        held = {i + k for i, r in enumerate(of) if passages[r] > 1 for k in range(words)}
        ranges += [(w[i][0], w[i + 1 if i + 1 in held else i][1]) for i in held]  # with the white space between two
        gone = bytearray(len(d))
        for a, b in ranges:
            gone[a:b] = b"\1" * (b - a)
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def make_passages():
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    passages = [prose(n) for n in (49, 50, 51, 60)]
    twice = prose(55)
    texts = [None, "", "one", "one", "a " * 130, prose(50), f"{twice} x {twice}", "  " + "\n".join(passages[3].split()) + "\x0b"]
    texts += [texts[5]] * 2  # a whole text of 50 words and fewer than 400 bytes
    texts += [f"{prose(k)} {passages[k % 4]} {prose(3)}" for k in range(16)]
    texts += [f"z{passages[1]}", "\xa0".join(passages[2].split()), prose(300), "w" * 1000]
    return texts


@pytest.mark.parametrize("shards", [{}, {"shard_bytes": 1500, "merge_shards": 2}])
def test_passages_of_words(spark, shards):
    """Passages of 50 words go with ``words``, below 400 bytes too; those of 49 stay."""
    texts = make_passages()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.cut for r in ss.cut_repeats(df, "cut", words=True, **shards).collect()}
    want = brute_passages(texts)
    assert [(got[i].n_removed, got[i].n_spans, hashlib.sha256(bytes(got[i].kept)).hexdigest()) for i in range(len(texts))] == want
    assert want[5][0] and want[11][0] and not want[10][0] and len(texts[11].encode()) < 400


def test_passages_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 9000")
    rows = docs.collect()
    got = {r.doc_id: (r.cut.n_removed, r.cut.n_spans, hashlib.sha256(bytes(r.cut.kept)).hexdigest()) for r in ss.cut_repeats(docs, "cut", words=True).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, brute_passages([r.text for r in rows]))}


def test_words_as_symbols():
    """Suffix arrays over words' digests, shared places of words, and digests that agree where words do."""
    rng = random.Random(3)
    texts = [b"".join(rng.choice([b"a", b"b", b"word", b"eight888", b"longer than", b"\x00", b"\xc2\xa0", b" ", b"\t\n", b"z" * 130]) for _ in range(rng.randrange(40))) for _ in range(200)]
    told = {}
    for d, coded in zip(texts, ss._coded(texts)):
        assert coded.tolist() == ss.word_digests(d)[0].tolist() and len(coded) == len(d.split())
        assert [d[a:b] for a, b in zip(*ss.word_places(np.frombuffer(d, dtype=np.uint8)))] == d.split()
        assert all(told.setdefault(w, h) == h for w, h in zip(d.split(), coded.tolist()))
    assert len(set(told.values())) == len(told)
    words = [[rng.randrange(3) << 60 for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    parts = [np.array(w, dtype="<u8").tobytes() for w in words]
    s, other = ss.SuffixShard(parts[:6], 4, 8), ss.SuffixShard(parts[6:], 4, 8)
    windows = [[tuple(w[i : i + 4]) if i + 4 <= len(w) else None for i in range(len(w))] for w in words]
    times = Counter(x for of in windows[:6] for x in of)
    assert s.repeated().tolist() == [x is not None and times[x] > 1 for of in windows[:6] for x in of]
    there = {x for of in windows[6:] for x in of} - {None}
    assert s.found_in(other).tolist() == [x in there for of in windows[:6] for x in of]


def test_query_tells_passages(spark):
    """Columns beyond the contract's: what is left once passages of 50 words are gone too, short ones among them."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = ss.op2_suffix_array(spark, DATA)
    assert got.columns[5:] == ["n_removed_words", "n_spans_words", "kept_words_sha256"]
    got = sorted(tuple(r) for r in got.collect())
    assert [g[:1] + g[5:] for g in got] == sorted((i, *w) for (i, _), w in zip(rows, brute_passages([t for _, t in rows])))
    assert [g[:5] for g in got] == brute_rows(rows) and any(g[5] > g[2] for g in got)
