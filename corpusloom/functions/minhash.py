"""MinHash signatures of word runs, and the band shape of LSH.

The family is portable: h is the first seven hex digits of md5, and the i-th
value is the least of (a_i * h + c_i) mod (2**31 - 1).  The multipliers are
powers of two fixed generators, so any SQL engine can compute the same.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def family(num_perm: int) -> tuple[list[int], list[int]]:
    """Multipliers and offsets."""
    return [pow(48271, i + 1, PRIME) for i in range(num_perm)], [pow(69621, i + 1, PRIME) for i in range(num_perm)]


@lru_cache(maxsize=64)
def band_shape(threshold: float, num_perm: int) -> tuple[int, int]:
    """Bands and rows that make half the false positives plus half the false negatives least."""
    step = 0.001
    s = np.arange(0.0, 1.0, step) + step / 2
    best = (np.inf, 1, 1)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            caught = 1 - (1 - s**r) ** b
            error = 0.5 * caught[s < threshold].sum() + 0.5 * (1 - caught[s >= threshold]).sum()
            if error < best[0] - 1e-9:
                best = (error, b, r)
    return best[1], best[2]


def word_runs(text: str, k: int = 5) -> set[str]:
    """Distinct runs of ``k`` lower-case words; a shorter text is one run."""
    words = text.lower().split()
    if len(words) <= k:
        return {" ".join(words)} if words else set()
    return set(map(" ".join, zip(*(words[i:] for i in range(k)))))


def run_hashes(text: str, k: int = 5) -> np.ndarray:
    """h of each run of ``word_runs``, equal ones as often as they occur: they change no least value."""
    words = " ".join(text.lower().split()).encode()
    if not words:
        return np.zeros(0, dtype=np.int64)
    ends = list(accumulate(len(w) + 1 for w in words.split(b" ")))
    digest = hashlib.md5
    raw = b"".join([digest(words[a : b - 1]).digest() for a, b in zip([0, *ends], ends[k - 1 :] or ends[-1:])])
    return (np.frombuffer(raw, dtype=">u4")[::4] >> 4).astype(np.int64)  # seven hex digits


#: Word runs whose values are made together, so that they stay in a core's cache.
_STEP = 256


def _least(h: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The least of (a * h + c) modulo ``PRIME`` over h below 2**28, for each a and c below ``PRIME``.

    The prime is one below a power of two, so there is no division: the upper and
    the lower bits add up to less than twice the prime.
    """
    least = np.full(len(a), PRIME, dtype=np.uint32)
    x = np.empty((len(a), min(len(h), _STEP)), dtype=np.int64)
    for at in range(0, len(h), _STEP):  # bounded memory for long texts
        part = h[at : at + _STEP]
        now = x[:, : len(part)]
        np.multiply(a, part, out=now)
        now += c
        high = now >> 31
        now &= PRIME
        now += high
        low = now.astype(np.uint32)
        np.minimum(low, low - np.uint32(PRIME), out=low)  # what is below the prime wraps around to more
        np.minimum(least, low.min(axis=1), out=least)
    return least.astype(np.int64)


def signature(text: Column, num_perm: int) -> Column:
    """Column array<bigint> of a text's word runs; empty where it has none.

    It is marked as not deterministic so that it is never copied into a lambda
    or computed twice.
    """

    def run(texts: pa.Array) -> pa.Array:
        a, c = (np.array(x, dtype=np.int64)[:, None] for x in family(num_perm))
        out = []
        for text in texts.to_pylist():
            h = run_hashes(text or "")
            out.append(_least(h, a, c) if len(h) else [])
        return pa.array(out, type=pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>").asNondeterministic()(text)


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    """One key for each band of a signature."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.md5(F.array_join(F.slice(sig, i * rows + 1, F.lit(rows)).cast("array<string>"), ",").cast("binary")),
    )
