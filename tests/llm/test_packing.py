"""Packing: ids against the library, placements against their definition."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(both, monkeypatch):
    ours, library = both

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=40), st.text(alphabet="abÀÉß1'S ,\ńΣ²\x1c<|startoftext|>", max_size=40)))
    def run(text):
        assert ours.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    run()
    monkeypatch.setattr(packing, "WORD_CACHE", 5)
    run()


def rule_by_rule(lengths, capacity):
    """The same rule, with every sum of squares counted afresh."""
    bins, places = [], []
    for s in lengths:
        best = None
        for g in sorted({capacity - b for b in bins if b < capacity}):
            if g >= s:
                gaps = [capacity - b for b in bins if b < capacity]
                gaps.remove(g)
                if g > s:
                    gaps.append(g - s)
                total = sum(gaps.count(x) ** 2 for x in set(gaps))
                if best is None or total < best[0]:
                    best = (total, g)
        if best is None:
            bins.append(s)
            places.append(0)
        else:
            b = max(i for i, x in enumerate(bins) if capacity - x == best[1])
            places.append(bins[b])
            bins[b] += s
    return len(bins), places


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_places_follow_the_rule(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, dtype=int), 20)
    want_bins, want_offsets = rule_by_rule(lengths, 20)
    assert (bins.max() + 1 if len(bins) else 0) == want_bins
    assert offsets.tolist() == want_offsets


def check_packing(rows, texts, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((i, n, start, len(part), zlib.crc32(part.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    return len(by_sequence), sum(w[3] for w in want)


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    texts = [(1, None), (1, None), (2, ""), (None, "some words"), (3, "long " * 1000)] + [
        (i, "word " * (i % 37)) for i in range(10, 200)
    ]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in texts], "doc_id long, text string, shard string, length int")
    n, tokens = check_packing(packing.pack(df, PATH, 64).collect(), texts, 64)
    assert n <= 1.1 * tokens / 64 + 8
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_documents_are_packed_tightly(spark):
    from corpusloom.llm.packing import op7_pack

    rows = op7_pack(spark, "/root/testdata/sf0.01").collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.01 * total / 4096 + 1
