"""Token counts by pluggable encodings.

An encoding is named, or is the path of a rank file (``.tiktoken``).  A named
one needs its vocabulary on disk or a network; where neither is there, making
it raises, and the check that asked for it reports the exception.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how texts are split before merges, for rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(name: str):  # noqa: ANN201
    """The encoder of that name or rank file."""
    import tiktoken

    if name.endswith(".tiktoken"):
        with open(name, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f.read().splitlines() if line)}
        return tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return tiktoken.get_encoding(name)


def count_tokens(text: Column, name: str, limit: int) -> Column:
    """Tokens of each text that may have more than ``limit``; null for others.

    Every token has a byte at least, so a text of at most ``limit`` bytes needs
    no encoder.  Special tokens in texts count as plain text.
    """

    def run(texts: pa.Array) -> pa.Array:
        enc = encoding(name)
        return pa.array([None if t is None else len(enc.encode_ordinary(t)) for t in texts.to_pylist()], type=pa.int64())

    return F.arrow_udf(run, "bigint")(F.when(F.octet_length(text) > limit, text))
