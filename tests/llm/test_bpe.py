"""Byte-level BPE against the reference library, and exact round trips."""

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe

PATHS = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    ranks = bpe.load_ranks(P.path(request.param))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Codec(ranks, P.PATTERN), theirs


def same(both, text):
    ours, theirs = both
    got = ours.encode(text).tolist()
    assert got == theirs.encode_ordinary(text), text
    assert ours.decode(got) == text.encode()


def test_any_text(both):
    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'sré\n\t 1.漢🎉", max_size=60)))
    def run(text):
        same(both, text)

    run()


def test_long_and_odd_texts(both):
    for text in ("", " ", "  a", "a  b", "a \n b", "\n", "ab" * 30_000, " " * 5000, "é" * 9999, "<|endoftext|>", "a b " * 2000):
        same(both, text)


def test_caches_may_start_anew(both, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CACHE", 3)
    monkeypatch.setattr(bpe, "PIECE_CACHE", 3)
    monkeypatch.setattr(bpe, "PAIR_CACHE", 3)
    same(both, "these are some words, and these are words again; some " * 20)


def test_columns(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "one two  three"), (None, "x" * 20_000)]
    path = P.path(PATHS[0])
    for data in (rows, []):
        df = spark.createDataFrame([(i, t, t) for i, t in data], "doc_id long, text string, ids string")
        out = df.select("*", bpe.encode(df["text"], path, P.PATTERN).alias("tokens"))
        got = out.select("text", bpe.decode(out["tokens"], path, P.PATTERN).alias("back")).collect()
        assert len(got) == len(data)
        assert all(bytes(r.back) == (r.text or "").encode() for r in got)
        trip = df.select(bpe.round_trip(df["text"], path, P.PATTERN).alias("r")).collect()
        assert sorted(bytes(r.r.decoded) for r in trip) == sorted((t or "").encode() for _, t in data)


def test_white_space_after_chunks_are_known(both):
    texts = ["a  b", "a \n b", " \x1c !\x1c x", "foo  \n\n  foo", " foo bar", "foo bar ", "!\x1c \x1c! a"]
    for _ in range(2):
        for text in texts:
            same(both, text)


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"\p{L}+| +|[^\p{L} ]+", r"(?s:.+)"])
def test_other_patterns(pattern):
    ranks = bpe.load_ranks(P.path(PATHS[1]))
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Codec(ranks, pattern)
    for text in ("some words and some words, again", "a  b c", " x y ", "it's they've"):
        assert ours.encode(text).tolist() == theirs.encode_ordinary(text)


def test_query_against_the_library(spark):
    import hashlib

    data = "/root/testdata/sf0.001"
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(PATHS[0])), special_tokens={})
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = theirs.encode_ordinary(r.text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), theirs.decode_bytes(ids))]
        want.append((r.doc_id, len(ids), *digests))
    got = bpe.op4_byte_bpe(spark, data)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
