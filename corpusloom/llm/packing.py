"""Packing of documents into sequences by the sum-of-squares rule.

Tokenising is row-local: each text becomes pieces of at most ``capacity``
tokens, with a checksum; only those few numbers go on.  They are written once
into the shared folder, so that a lost executor never costs tokenising again.

Packing is split over shards of about ``SHARD_PIECES`` pieces, dealt by a hash
of document and piece, so each shard sees the same mix of lengths and no key
can make one large.  In a shard, pieces are placed longest first.  N(g) counts
the open bins with residual gap g; a piece of length s goes where the sum over
g of N(g)**2 becomes smallest.  A new bin is not among the places compared
where a piece fits an open one: a deviation from the plain rule, which would
open bins early.  On the 10267 pieces of sf0.1 (2269.2 sequences of tokens) it
needs 2270 sequences, the plain rule 2272.  Filled bins no longer count.  A
shard leaves a handful of bins part-filled, whatever its size.

Defined cases: null text is empty (one piece with the end mark alone); repeated
rows are packed each for itself; a document of more than ``capacity`` tokens is
cut into full pieces and a rest, however long it is; ties of the rule go to the
smallest gap, of bins with one gap to the last; pieces of one length are placed
by id, piece and checksum; a null id is kept; an empty table gives no rows;
further columns play no part, whatever their names.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import give_back, table, text_of
from corpusloom.sources.session import materialise, ship_package

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 16_384
#: Words each worker remembers, about 170 bytes each; the table starts anew when full.
WORD_CACHE = 600_000
PIECES_TYPE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
_ARROW = pa.list_(
    pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
)
#: Texts of these characters alone normalise character by character, so their words are independent.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«¬®-±´¶-¸»¿-įı-žƀ-ȳ]*")


class WordTokenizer:
    """Ids of texts by a word-level BPE file, repeated words looked up.

    Words of plain text are encoded by the library once and remembered in a
    table of bounded size.  Any other text, and text with special tokens in it,
    goes to the library as a whole, so ids are always the library's own.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._pack(self.library.encode(text, add_special_tokens=False).ids)
        words, known = text.lower().split(), self._known
        missing = list(set(words).difference(known))
        if len(known) + len(missing) > WORD_CACHE:
            known.clear()
            missing = list(set(words))
        if missing:
            encoded = self.library.encode_batch_fast(missing, add_special_tokens=False)
            known.update(zip(missing, [self._pack(e.ids) for e in encoded]))
        return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces_of(packed: bytes, capacity: int) -> list[dict]:
    """Pieces of a document's packed ids, its end mark included."""
    n, out = len(packed) // 4, []
    for i, start in enumerate(range(0, n, capacity)):
        length = min(capacity, n - start)
        crc = zlib.crc32(packed[4 * start : 4 * (start + length)])
        out.append({"piece": i, "start": start, "length": length, "ids_crc32": crc})
    return out


def token_ids(text: Column, path: str) -> Column:
    """Column ``array<int>`` of a text's ids, without the end mark."""

    def run(texts: pa.Array) -> pa.Array:
        t = tokenizer(path)
        ids = [np.frombuffer(t.encode(x or ""), dtype="<u4").astype(np.int32) for x in texts.to_pylist()]
        return pa.array(ids, type=pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def token_pieces(text: Column, path: str, capacity: int = CAPACITY) -> Column:
    """Column of the pieces into which a text is cut."""

    def run(texts: pa.Array) -> pa.Array:
        t, end = tokenizer(path), END_ID.to_bytes(4, "little")
        out = pa.array([pieces_of(t.encode(x.as_py() or "") + end, capacity) for x in texts], type=_ARROW)
        give_back()
        return out

    return F.arrow_udf(run, PIECES_TYPE)(text)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # N(g); N(0) stays 0
    open_bins: dict[int, list[int]] = {}
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    n_bins = 0
    for i, s in enumerate(lengths.tolist()):
        gap = capacity
        if s < capacity:
            here, there = count[s:capacity], count[: capacity - s]
            # The sum grows by 2 * (N(g-s) - N(g)) + 2, or by 1 - 2 * N(s) where the bin is filled.
            growth = 2 * (there - here) + 2
            growth[0] -= 1
            growth[here == 0] = 1 << 40
            best = int(growth.argmin())
            if here[best]:
                gap = s + best
        if gap == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins.setdefault(gap - s, []).append(b)
    return bins, offsets


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One shard's pieces with their sequence and offset."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
    bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
    return pdf.assign(sequence_id=(pdf["shard"].to_numpy(dtype=np.int64) << 32) | bins, offset=offsets).drop(
        columns="shard"
    )


PACKED_TYPE = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)


def pack(
    df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece of each row of ``df``, and its place in a sequence."""
    ship_package(df.sparkSession)
    cut = df.select(
        df[id_col].cast("long").alias("doc_id"), token_pieces(text_of(df, text_col), path, capacity).alias("p")
    )
    # Every document has a piece.  For the outer form no filter on the array is inferred, which would tokenise twice.
    pieces = materialise(cut.select("doc_id", F.explode_outer("p").alias("p")).select("doc_id", "p.*"), "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    dealt = pieces.withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(7)), F.lit(shards)).cast("long")
    )
    return dealt.groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity), PACKED_TYPE)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_pack": op7_pack}
ORACLE_SQL: dict[str, str] = {}
