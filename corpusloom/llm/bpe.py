"""Byte-level BPE: exact encoding in linear time, and decoding.

The rank file is a parameter; nothing of it is stored here.  Each pre-token is
encoded separately, by the method of longest matches with backtracking:

* an Aho-Corasick automaton over the vocabulary (bytes as Latin-1 characters)
  gives the longest token that starts at each place;
* tokens are taken greedily; two adjacent tokens must be *compatible*, that is,
  the merges applied to their joined bytes give just these two (memoised);
* where a token is not compatible with the one before, the next shorter token
  that is its prefix is tried; where none is left, the place is marked dead and
  the previous token is shortened.  Each place dies at most once, so the time
  is linear in the pre-token's length.

A sequence whose adjacent tokens are all compatible is the one that the merges
give, so the result equals theirs exactly.  As with the original merges, a
pre-token that is itself in the vocabulary is that single token.

Columns are row-local Arrow functions: no shuffle, nothing gathered.  Repeated
chunks between spaces are remembered in tables of bounded size in each worker
(about 100 MB in all when full, the vocabulary's own tables included).

Defined cases: null text is empty and has no tokens; an empty table gives no
rows; repeated rows each get their own result; texts and pre-tokens of any
length are encoded whole; of equal merges the leftmost comes first; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, text_of

#: Entries of each worker's tables of known chunks, pieces, pairs and edges; a table starts anew when full.
CHUNK_CACHE = 120_000
PIECE_CACHE = 50_000
PAIR_CACHE = 200_000
EDGE_CACHE = 20_000
#: A pre-token pattern (fixed value) by which a single space between other characters always starts a pre-token.
SPACE_STARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a tiktoken rank file; any path that Arrow can open."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            data = f.read()
    else:
        fs, where = pa.fs.FileSystem.from_uri(path)
        with fs.open_input_stream(where) as f:
            data = f.read()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.at_spaces = pattern == SPACE_STARTS
        self.of_rank = {r: t for t, r in ranks.items()}
        self.size_of = {r: len(t) for t, r in ranks.items()}
        self.decimal = {r: b"%d" % r for r in ranks.values()}
        self._automaton = None
        self._edges: tuple[dict, dict] = ({}, {})
        self._compatible: dict[int, bool] = {}
        self._prefix: dict[int, int] = {}
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}  # ids of a space and the chunk
        self._old_chunks: dict[str, bytes] = {}

    # -- the merges themselves, for single tokens only ----------------------------------------

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """Parts that the ranked merges leave of a short byte string, ``least`` of them or more."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, rank: int, side: int) -> list[tuple[bytes, int, int]]:
        """Parts at one edge of a token, largest first: bytes, own rank, rank of the merge that ends it.

        side 0 is the left edge, side 1 the right edge.
        """
        known = self._edges[side].get(rank)
        if known is None:
            token, known, ends = self.of_rank[rank], [], NEVER
            while True:
                own = self.ranks[token] if len(token) > 1 else -1
                known.append((token, own, ends))
                if len(token) == 1:
                    break
                ends, token = own, self.merge(token, 2)[-side]
            if len(self._edges[side]) >= EDGE_CACHE:
                self._edges[side].clear()
            self._edges[side][rank] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the joined bytes of two tokens as these two.

        They do unless some part at the right edge of the one and some part at
        the left edge of the other merge while both exist.  Of equal merges the
        leftmost comes first, hence the one-sided equality.
        """
        key = left * 1_000_003 + right
        known = self._compatible.get(key)
        if known is None:
            known, ranks = True, self.ranks
            for x, x_own, x_ends in self._edge(left, 1):
                for y, y_own, y_ends in self._edge(right, 0):
                    merged = ranks.get(x + y)
                    if merged is not None:
                        when = max(merged, x_own, y_own)
                        if when < x_ends and (when < y_ends or when == merged == y_ends):
                            known = False
                            break
                if not known:
                    break
            if len(self._compatible) >= PAIR_CACHE:
                self._compatible.clear()
            self._compatible[key] = known
        return known

    def _machine(self):
        if self._automaton is None:
            machine = ahocorasick.Automaton()
            for token, rank in self.ranks.items():
                if len(token) == 1 or self.merge(token) == [token]:  # others are never made by merges
                    machine.add_word(token.decode("latin-1"), (rank, len(token)))
            machine.make_automaton()
            self._automaton = machine
        return self._automaton

    def shorter(self, rank: int) -> int:
        """The longest token that is a proper prefix of a token; -1 if none."""
        known = self._prefix.get(rank)
        if known is None:
            token, machine, known = self.of_rank[rank], self._machine(), -1
            for n in range(len(token) - 1, 0, -1):
                found = machine.get(token[:n].decode("latin-1"), None)
                if found:
                    known = found[0]
                    break
            self._prefix[rank] = known
        return known

    # -- encoding ----------------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [-1] * n
        for end, (rank, size) in self._machine().iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # later ends overwrite: the longest stays
        size_of, pairs, dead = self.size_of, self._compatible, bytearray(n + 1)
        out: list[int] = []
        at, before = 0, -1
        token = longest[0]
        while True:
            if token < 0:  # nothing is left to try here
                if before < 0:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = self.shorter(out.pop())
                at -= size_of[before]
                before = out[-1] if out else -1
                continue
            end = at + size_of[token]
            fits = not dead[end]
            if fits and before >= 0:
                fits = pairs.get(before * 1_000_003 + token)
                if fits is None:
                    fits = self.compatible(before, token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, before, token = end, token, longest[end]
            else:
                token = self.shorter(token)

    def _known(self, chunk: str) -> bytes | None:
        """What is remembered for a chunk after a space, also from before the table last started anew."""
        got = self._chunks.get(chunk)
        if got is None:
            got = self._old_chunks.get(chunk)
            if got is not None:
                self._remember(chunk, got)
        return got

    def _remember(self, chunk: str, got: bytes) -> None:
        if len(chunk) < 48:
            if len(self._chunks) >= CHUNK_CACHE:
                self._old_chunks, self._chunks = self._chunks, {}
            self._chunks[chunk] = got

    def _packed(self, text: str) -> bytes:
        """Token ids of a text, matched as a whole, as 32-bit integers."""
        known, parts = self._pieces, []
        for piece in self.pattern.findall(text):
            spaced = piece[0] == " " and not piece[1:2].isspace() and len(piece) > 1
            got = self._known(piece[1:]) if spaced else known.get(piece)
            if got is None:
                got = array("i", self.encode_piece(piece.encode())).tobytes()
                if spaced:
                    self._remember(piece[1:], got)
                elif len(piece) < 48:
                    if len(known) >= PIECE_CACHE:
                        known.clear()
                    known[piece] = got
            parts.append(got)
        return b"".join(parts)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text.

        Where by the pattern a single space between two characters that are not
        white space always starts a pre-token, what lies between such spaces is
        encoded once and remembered.  Texts with other white space beside a
        space, and other patterns, are matched as a whole.
        """
        first, *rest = text.split(" ")
        if not self.at_spaces or first and first[-1].isspace():
            return np.frombuffer(self._packed(text), dtype=np.int32)
        parts = [self._packed(first)]
        for chunk in rest:
            got = self._chunks.get(chunk)
            if got is None:
                if not chunk or not first or chunk[0].isspace() or chunk[-1].isspace():
                    return np.frombuffer(self._packed(text), dtype=np.int32)
                got = self._known(chunk)
                if got is None:
                    got = self._packed(" " + chunk)
                    self._remember(chunk, got)
            parts.append(got)
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.of_rank.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    return Codec(load_ranks(path), pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Column ``array<int>`` of token ids."""

    def run(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return _id_lists([c.encode(t or "") for t in texts.to_pylist()])

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Column of the bytes that token ids stand for; null ids are null."""

    def run(lists: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([None if x is None else c.decode(x) for x in lists.to_pylist()], type=pa.binary())

    return F.arrow_udf(run, "binary")(ids)


def _id_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate(lists) if lists else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Column ``struct<ids, decoded>``: encoding, and the decoding of its ids."""

    def run(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        ids, decoded = [], []
        for t in texts.to_pylist():
            ids.append(c.encode(t or ""))
            decoded.append(c.decode(ids[-1].tolist()))
        return pa.StructArray.from_arrays(
            [_id_lists(ids), pa.array(decoded, type=pa.binary())], names=["ids", "decoded"]
        )

    return F.arrow_udf(run, "struct<ids:array<int>,decoded:binary>")(text)


def round_trip_digests(text: Column, path: str, pattern: str) -> Column:
    """Column ``struct<n_tokens, ids_sha256, decoded_sha256>`` of what ``round_trip`` gives, one text at a time."""

    def run(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        rows = []
        for t in texts:
            ids = c.encode(t.as_py() or "").tolist()
            listed = b",".join(map(c.decimal.__getitem__, ids))
            rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        columns = zip(*rows) if rows else ([], [], [])
        return pa.StructArray.from_arrays(
            [pa.array(x, type=k) for x, k in zip(columns, (pa.int64(), pa.string(), pa.string()))],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")(text)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's token ids and of their decoding."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    coded = round_trip_digests(
        text_of(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return docs.select("doc_id", coded.alias("c")).select("doc_id", "c.*")


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
