"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``SPAN`` (400) bytes that also starts anywhere
else is removed.  Strings are judged on the input; matches never cross texts.

1. Anchors.  In each window of 400 bytes the 128-byte string of least hash is
   its anchor (leftmost on ties), so equal windows have equal anchors at equal
   places.  Only anchors (about one for 140 bytes) are shuffled, and those that
   occur once fall away with all their windows: no repeated window is lost.
2. Contexts.  For each anchor that occurs again, the bytes of the windows it
   anchors.  All contexts of an anchor meet.
3. Suffix arrays.  Contexts, sorted by anchor, stream into shards that are
   closed by a running sum of bytes, at ``SHARD_BYTES`` at most.  Each shard
   sorts its suffixes by Larsson-Sadakane refinement in numpy (groups not yet
   sorted are refined by the ranks ``h`` and 2h places on, h tripling) and gets common
   prefixes by Kasai's rule, all contexts side by side.  A window is repeated
   where a neighbour shares 400 bytes.
4. Merging.  An anchor with more contexts than a shard may hold is dealt over
   several shards; each pair of these is merged by binary search of the one's
   windows in the other's suffix array.  Above ``MERGE_SHARDS`` shards, the
   contexts are first cut by the place of the anchor in the window, in classes
   of ``GRIDS`` places: windows of a class share all bytes but so many, and only
   classes that agree in these bytes stay together.  So the work of a hot anchor
   is linear in its contexts.
5. Cutting.  Covered ranges go back to the texts, and are cut out.

Passages.  On request (``words``) every word in a run of 50 words that starts
again elsewhere goes too, with the white space between two such words, however
few bytes the run has and whatever white space parts it.  Steps 1 to 4 then take
texts a second time in which each word is its digest of eight bytes, one symbol,
so that 400 bytes are 50 words.  Both go through the same shuffles; the lowest
bit of an anchor keeps them apart.

Shortcuts by digest, all of equal strings only: texts equal as wholes are
compared once; equal contexts are one, repeated as a whole; an anchor with one
distinct context has nothing to sort.  Everything else is decided by suffix
arrays.

Memory: a sort holds about 45 bytes for each byte of a shard, a merge two
shards, the search for anchors ``STEP`` windows, whatever the texts' lengths.

Defined cases: null text is empty; repeated rows are copies of each other; an
empty table gives no rows; texts below 400 bytes (and 50 words) lose nothing; texts of any
length are taken whole, in steps; ties between equal anchors go to the leftmost;
rows without id are told apart by their text; further columns are kept, whatever
their names; the remaining bytes are exact, and as text a character that was cut
through is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import give_back, table, text_of
from corpusloom.llm.hashing import BASE, BASE_INVERSE, mixed, powers
from corpusloom.sources.session import fresh_name, materialise, ship_package

SPAN = 400
ANCHOR = 128
#: Bytes of contexts whose suffixes are sorted together.
SHARD_BYTES = 1 << 20
#: Shards of one anchor that are merged in pairs; beyond, its contexts are cut by ``GRIDS``.
MERGE_SHARDS = 6
GRIDS = (42, 6, 1)
#: Windows looked at together; texts of any length are taken in such steps.
STEP = 1 << 19
#: Symbols of short texts looked at together.
TOGETHER = 1 << 16
#: Bytes of a word's digest: a window of ``SPAN`` bytes is a passage of 50 words.
WORD_BYTES = 8
PASSAGE = SPAN // WORD_BYTES
WORD_ANCHOR = 8
#: Words above these bytes are digested one by one.
LONG_WORD = 128
#: What ends a word.
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Digests that a task remembers to give equal strings once; others are given again.
KNOWN = 200_000


def anchor_places(symbols: np.ndarray, span: int = SPAN, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last window start, and place of the anchor, of each run of windows with one anchor."""
    n = len(symbols) - span + 1  # window starts
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    found = []
    for at in range(0, n, STEP):
        h, *places = _anchors(symbols[at : at + STEP + span - 1], span, size)
        found.append((h, *(p + at for p in places)))
    return tuple(np.concatenate(x) for x in zip(*found))


def anchors(data: bytes, span: int = SPAN, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last window start of each run of windows with one anchor."""
    return anchor_places(np.frombuffer(data, dtype=np.uint8), span, size)[:3]


def _anchors(symbols: np.ndarray, span: int, size: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """As ``anchor_places``; ``ends``, one for each place, are those of several texts that no window crosses."""
    raw = symbols.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw * powers(BASE, len(raw)), out=total[1:])
    grams = mixed((total[size:] - total[:-size]) * powers(BASE_INVERSE, len(raw) - size + 1))
    # The order key is the upper part of the hash, then the place.
    key = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    wide = span - size + 1
    full = -(-len(key) // wide) * wide
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    square = padded.reshape(-1, wide)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(key) - wide + 1
    least = np.minimum(after[:starts], before[wide - 1 : wide - 1 + starts])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    window = np.arange(starts) if ends is None else np.flatnonzero(np.arange(starts) + span <= ends[:starts])
    at = at[window]
    run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([run[1:], [len(window)]]) - 1
    return grams[at[run]], window[run], window[last], at[run]


def _text_anchors(texts: Iterable[np.ndarray], span: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the text, hash, first, last, place) of the anchors of many texts; short ones are looked at together."""
    held: list[tuple[int, np.ndarray]] = []
    total = 0

    def close() -> tuple[np.ndarray, ...]:
        sizes = np.array([len(x) for _, x in held])
        end = np.cumsum(sizes)
        h, *places = _anchors(np.concatenate([x for _, x in held]), span, size, np.repeat(end, sizes))
        which = np.searchsorted(end, places[0], side="right")
        return np.array([i for i, _ in held])[which], h, *(p - (end - sizes)[which] for p in places)

    for i, symbols in enumerate(texts):
        if len(symbols) < span:
            continue
        if held and total + len(symbols) > TOGETHER:
            yield close()
            held, total = [], 0
        if len(symbols) > TOGETHER:
            found = anchor_places(symbols, span, size)
            yield np.full(len(found[0]), i), *found
        else:
            held.append((i, symbols))
            total += len(symbols)
    if held:
        yield close()


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a text's bytes."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~_WHITE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_digests(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Eight-byte digests of a text's words, all words together eight bytes at a time, and the words' starts."""
    start, end = word_places(np.frombuffer(data, dtype=np.uint8))
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=data + bytes(8), strides=(1,))
    size = end - start
    out = mixed(size.astype(np.uint64) + np.uint64(BASE))
    going = np.flatnonzero(size <= LONG_WORD)
    at, left = start[going], size[going]
    while len(going):
        block = eight[at] & (~np.uint64(0) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64))
        out[going] = mixed((out[going] ^ block) + np.uint64(BASE))
        more = left > 8
        going, at, left = going[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=WORD_BYTES).digest(), "little")
    return out, start


def _coded(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The words' digests of each text; those of short texts are made together."""
    held: list[bytes] = []
    total = 0

    def close() -> list[np.ndarray]:
        digests, start = word_digests(b" ".join(held))
        ends = np.cumsum([len(x) + 1 for x in held])
        return np.split(digests, np.searchsorted(start, ends[:-1]))

    for data in texts:
        if held and total + len(data) > TOGETHER:
            yield from close()
            held, total = [], 0
        held.append(data)
        total += len(data)
    if held:
        yield from close()


def _texts_of(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    """The texts of a batch as bytes, one at a time."""
    return (x.as_py() for x in batch.column(column).cast(pa.binary()))


def _unit(anchor: int) -> int:
    """Bytes of a symbol of the strings under an anchor: its lowest bit tells words' digests from bytes."""
    return WORD_BYTES if anchor & 1 else 1


#: By the bytes of a symbol, how far before its anchor a window can start, in symbols.
_BEFORE = {1: SPAN - ANCHOR, WORD_BYTES: PASSAGE - WORD_ANCHOR}


def _anchor_rows(batches: Iterator[pa.RecordBatch], words: bool = False) -> Iterator[pa.RecordBatch]:
    """Anchors of texts (v, text): their first window, and the last and the place, in symbols from there."""
    seen: set[bytes] = set()
    least = 2 * PASSAGE - 1 if words else SPAN  # bytes of 50 words of one byte
    for batch in batches:
        texts: dict[bytes, bytes] = {}
        for v, data in zip(batch.column(0).to_pylist(), _texts_of(batch, 1)):
            if len(data) < least or v in seen:  # a copy: its windows are known
                continue
            if len(seen) < KNOWN:
                seen.add(v)
            texts[v] = data
        keys = pa.array(list(texts), type=pa.binary())
        found = [(0, x) for x in _text_anchors((np.frombuffer(d, dtype=np.uint8) for d in texts.values()), SPAN, ANCHOR)]
        if words:
            found += [(1, x) for x in _text_anchors(_coded(texts.values()), PASSAGE, WORD_ANCHOR)]
        for kind, (which, h, a, b, at) in found:
            h = h & ~np.uint64(1) | np.uint64(kind)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(which)), pa.array(h.view(np.int64)),
                    *(pa.array(x.astype(np.int32)) for x in (a, b - a, at - a)),
                ],
                names=["v", "anchor", "first", "last", "at"],
            )
    give_back()


#: cid: digest of the bytes under the anchor; at: the anchor's place in the bytes; owner, first: where they stand.
_CONTEXT = {"cid": pa.binary(), "anchor": pa.int64(), "at": pa.int64(), "bytes": pa.binary(), "owner": pa.binary(), "first": pa.int64(), "n": pa.int64()}
_CONTEXT_TYPE = "cid binary, anchor long, at long, bytes binary, owner binary, first long, n long"


def _context_batches(pieces: Iterator[tuple[int, int, bytes, bytes, int]]) -> Iterator[pa.RecordBatch]:
    """Batches of contexts (anchor, at, bytes, owner, first); a task gives the bytes of equal contexts once."""
    seen: set[bytes] = set()
    rows, held = [[] for _ in _CONTEXT], 0
    for anchor, at, piece, owner, first in pieces:
        salt = anchor.to_bytes(8, "little", signed=True) + at.to_bytes(8, "little")
        cid = hashlib.blake2b(piece, digest_size=16, salt=salt).digest()
        new = cid not in seen
        if new and len(seen) < KNOWN:
            seen.add(cid)
        held += 300 + (len(piece) if new else 0)
        for column, value in zip(rows, (cid, anchor, at, piece if new else None, owner, first, len(piece))):
            column.append(value)
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(rows, _CONTEXT.values())], names=list(_CONTEXT))
            rows, held = [[] for _ in _CONTEXT], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(rows, _CONTEXT.values())], names=list(_CONTEXT))
    give_back()


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors of texts (v, text, places)."""

    def pieces() -> Iterator[tuple[int, int, bytes, bytes, int]]:
        for batch in batches:
            flat = batch.column(2).flatten()
            places = zip(*(flat.field(flat.type.get_field_index(c)).to_pylist() for c in ("anchor", "first", "last", "at")))
            sizes = batch.column(2).value_lengths().to_pylist()
            for v, data, n in zip(batch.column(0).to_pylist(), _texts_of(batch, 1), sizes):
                coded = None
                for anchor, first, last, at in islice(places, n):
                    unit, of = _unit(anchor), data
                    if unit > 1:
                        of = coded = word_digests(data)[0].tobytes() if coded is None else coded
                    yield anchor, at * unit, of[first * unit : (first + last) * unit + SPAN], v, first * unit

    return _context_batches(pieces())


def _class_rows(batches: Iterator[pa.RecordBatch], grid: int) -> Iterator[pa.RecordBatch]:
    """Contexts (cid, anchor, at, bytes) cut in classes of ``grid`` places of the anchor in the window.

    Windows of a class share all but ``grid`` - 1 bytes around the anchor; with
    the old anchor and the class these bytes are the new anchor.
    """

    def pieces() -> Iterator[tuple[int, int, bytes, bytes, int]]:
        for batch in batches:
            for cid, anchor, at, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                u = _unit(anchor)
                at, last = at // u, (len(data) - SPAN) // u
                for c in range((at - last) // grid, at // grid + 1):
                    # Windows that start ``low`` to ``high`` places before the anchor, as far as they are here.
                    low, high = c * grid, min((c + 1) * grid - 1, _BEFORE[u])
                    a, b = max(0, at - high), min(last, at - low)
                    core = data[(at - low) * u : (at - high) * u + SPAN]
                    salt = anchor.to_bytes(8, "little", signed=True) + c.to_bytes(2, "little")
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=salt).digest(), "little", signed=True)
                    yield key & ~1 | anchor & 1, (at - a) * u, data[a * u : b * u + SPAN], cid, a * u

    return _context_batches(pieces())


def _common(
    one: np.ndarray, i: np.ndarray, two: np.ndarray, j: np.ndarray, h: np.ndarray, room: np.ndarray, shift: int
) -> np.ndarray:
    """Common prefixes, at most ``room`` symbols, of places i and j; h symbols are known to agree.

    one and two hold the eight bytes at each place as a little-endian number, so
    the lowest bit that differs tells the first symbol, of two to the ``shift``
    bits, that does.
    """
    h = h.copy()
    going = np.flatnonzero(h < room)
    while len(going):
        differ = one[i[going] + h[going]] ^ two[j[going] + h[going]]
        low = differ & (~differ + np.uint64(1))
        h[going] += (np.bitwise_count(low - np.uint64(1)) >> shift).astype(h.dtype)
        going = going[(differ == 0) & (h[going] < room[going])]
    return np.minimum(h, room)


class SuffixShard:
    """Suffix array and clipped common prefixes of some strings of symbols of ``unit`` bytes (1 or 8)."""

    def __init__(self, parts: list[bytes], span: int = SPAN, unit: int = 1) -> None:
        self.span, self.unit = span, unit
        self.shift = 3 if unit == 1 else 6
        self.size = np.array([len(p) // unit for p in parts], dtype=np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        n = int(self.size.sum())
        self.text = np.zeros(n + span + 8, dtype=f"<u{unit}")
        self.text[:n] = np.frombuffer(b"".join(parts), dtype=self.text.dtype)
        self.words = np.lib.stride_tricks.sliding_window_view(self.text, 8 // unit).copy().view("<u8").ravel()
        self.part = np.repeat(np.arange(len(parts), dtype=np.int32), self.size)
        self.end = np.repeat(self.start + self.size, self.size)
        self.sorted = self._sort(n)
        self.place = np.empty(n, dtype=np.int32)
        self.place[self.sorted] = np.arange(n, dtype=np.int32)

    def _sort(self, n: int) -> np.ndarray:
        """Larsson-Sadakane refinement; a part's end is below every symbol and ordered by part."""
        if not n:
            return np.zeros(0, dtype=np.int32)
        at = np.arange(n, dtype=np.int32)
        if self.unit == 1:  # seven bytes, then how many of them are there
            h = 7
            left = np.minimum(self.end - at, h)
            beyond = (8 * (h - left)).astype(np.uint64)
            key = self.words[:n].byteswap() >> np.uint64(8) >> beyond << beyond << np.uint64(3) | left.astype(np.uint64)
        else:  # ranks of symbols
            ranks = np.zeros(n + 7, dtype=np.int64)
            own, ranks[:n] = np.unique(self.text[:n], return_inverse=True)
            bits = max(9, len(own).bit_length())
            h, key = 63 // bits, np.zeros(n, dtype=np.int64)
            for j in range(h):
                key <<= bits
                key += (ranks[j : n + j] + 1) * (at + j < self.end)
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        rank = np.empty(n, dtype=np.int32)  # a group's rank is its first place
        group = np.maximum.accumulate(np.where(head, at, 0))
        rank[order] = group
        n_parts = len(self.size)
        m = n + n_parts
        three = n * m * m < 1 << 63  # whether a group and two ranks fit a key
        while True:
            alone = head & np.concatenate([head[1:], [True]])
            loose = np.flatnonzero(~alone).astype(np.int32)
            if not len(loose):
                return order
            suffix = order[loose]
            end, part = self.end[suffix], self.part[suffix]
            combined = group[loose].astype(np.int64)
            past = np.zeros(len(loose), dtype=bool)
            for step in (h, 2 * h) if three else (h,):
                ended = past  # before this step: that is told already
                past = suffix + step >= end
                ahead = np.where(past, part, n_parts + rank[np.where(past, 0, suffix + step)])
                combined = combined * m + np.where(ended, 0, ahead)
            by = np.argsort(combined)
            order[loose] = suffix[by]
            combined = combined[by]
            new = np.concatenate([[True], combined[1:] != combined[:-1]])
            head[loose] |= new  # an old group's first place stays a head
            group = np.maximum.accumulate(np.where(head, at, 0))
            rank[order[loose]] = group[loose]
            h *= 3 if three else 2

    def prefixes(self, windows: bool = False) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order, at most ``span``; or only of those that long.

        Kasai's rule: going one place on in a part loses at most one symbol.  All
        parts advance together.
        """
        n = len(self.sorted)
        out = np.zeros(n, dtype=np.int32)
        steps = np.maximum(self.size - self.span + 1, 0) if windows else self.size
        lane = np.argsort(-steps, kind="stable")
        held = np.zeros(len(self.size), dtype=np.int32)
        for t in range(int(steps.max()) if n else 0):
            while len(lane) and steps[lane[-1]] <= t:
                lane = lane[steps[lane] > t]
            i = self.start[lane] + t
            place = self.place[i]
            j = self.sorted[np.maximum(place - 1, 0)]
            room = np.minimum(np.minimum(self.end[i] - i, self.end[j] - j), self.span)
            room[place == 0] = 0
            h = _common(self.words, i, self.words, j, np.minimum(held[lane], room), room, self.shift)
            out[place] = h
            held[lane] = np.maximum(h - 1, 0)
        return out

    def repeated(self) -> np.ndarray:
        """Whether the window at each place is elsewhere in this shard."""
        common = self.prefixes(windows=True) >= self.span
        out = np.zeros(len(self.sorted), dtype=bool)
        out[self.sorted[common]] = True
        out[self.sorted[:-1][common[1:]]] = True
        return out

    def found_in(self, other: SuffixShard) -> np.ndarray:
        """Whether the window at each place is in another shard: binary search in its suffix array."""
        out = np.zeros(len(self.sorted), dtype=bool)
        mine = np.flatnonzero(np.arange(len(out)) + self.span <= self.end)
        low, high = np.zeros(len(mine), dtype=np.int64), np.full(len(mine), len(other.sorted), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            less = self._compare(mine[open_], other, other.sorted[mid]) > 0
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        inside = np.flatnonzero(low < len(other.sorted))
        equal = self._compare(mine[inside], other, other.sorted[low[inside]]) == 0
        out[mine[inside[equal]]] = True
        return out

    def _compare(self, mine: np.ndarray, other: SuffixShard, theirs: np.ndarray) -> np.ndarray:
        """Sign of my window against the start of their suffix; an ended suffix is less."""
        room = np.minimum(other.end[theirs] - theirs, self.span)
        h = _common(self.words, mine, other.words, theirs, np.zeros_like(room), room, self.shift)
        a, b = self.text[mine + h], other.text[theirs + h]
        return np.where(h < room, (a > b).astype(np.int8) - (a < b), room < self.span).astype(np.int8)


def _covered(flags: np.ndarray, unit: int) -> list[dict]:
    """Byte ranges covered by windows at the flagged places."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > SPAN // unit)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [{"start": int(a) * unit, "end": int(b) * unit + SPAN} for a, b in zip(first, last)]


_RANGES = "array<struct<start:bigint,end:bigint>>"


_RANGES_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _ranges_batch(cids: list[bytes], shard: SuffixShard, flags: np.ndarray) -> pa.RecordBatch:
    """(cid, ranges) of the contexts with repeated windows."""
    out = []
    for cid, a, n in zip(cids, shard.start.tolist(), shard.size.tolist()):
        ranges = _covered(flags[a : a + n], shard.unit)
        if ranges:
            out.append((cid, ranges))
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in out], type=pa.binary()), pa.array([r for _, r in out], type=_RANGES_ARROW)],
        names=["cid", "ranges"],
    )


def _shard(contexts: dict[bytes, bytes], unit: int) -> SuffixShard:
    return SuffixShard([contexts[c] for c in sorted(contexts)], SPAN // unit, unit)


def _own_shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of contexts (anchor, size of all its contexts, cid, bytes) that come sorted by anchor."""
    held: dict[int, dict[bytes, bytes]] = {1: {}, WORD_BYTES: {}}  # bytes and words apart
    total, last = dict.fromkeys(held, 0), None

    def close(unit: int) -> pa.RecordBatch:
        s = _shard(held[unit], unit)
        return _ranges_batch(sorted(held[unit]), s, s.repeated())

    for batch in batches:
        for anchor, size, cid, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
            unit = _unit(anchor)
            if anchor != last:
                if held[unit] and total[unit] + size > shard_bytes:
                    yield close(unit)
                    held[unit], total[unit] = {}, 0
                total[unit], last = total[unit] + size, anchor
            held[unit][cid] = piece
    for unit in held:
        if held[unit]:
            yield close(unit)
    give_back()


def _merged_shards(rows: pa.Table) -> pa.Table:
    """Repeated ranges in one shard of an anchor or, of two shards, across them."""
    sides: dict[int, dict[bytes, bytes]] = {}
    for side, cid, piece in zip(*(rows[c].to_pylist() for c in ("side", "cid", "bytes"))):
        sides.setdefault(side, {})[cid] = piece
    unit = _unit(rows["anchor"][0].as_py())
    cids = [sorted(s) for _, s in sorted(sides.items())]
    shards = [_shard(s, unit) for _, s in sorted(sides.items())]
    if len(shards) == 2:
        flags = [shards[0].found_in(shards[1]), shards[1].found_in(shards[0])]
    elif rows["inside"][0].as_py():
        flags = [shards[0].repeated()]
    else:  # a pair of which one side has no contexts
        flags = [np.zeros(len(s.sorted), dtype=bool) for s in shards]
    return pa.Table.from_batches([_ranges_batch(own, s, f) for own, s, f in zip(cids, shards, flags)])


def _sorted_ranges(contexts: DataFrame, shard_bytes: int, merge_shards: int, grids: tuple[int, ...]) -> DataFrame:
    """(cid, ranges) of the windows of contexts that another context holds too, and of contexts that occur again."""
    given = contexts.where("bytes is not null").select("anchor", "cid", "at", "bytes")
    per_anchor = contexts.where("bytes is not null").groupBy("anchor")
    # Where an anchor has one context, all its windows are equal to each other and to no others: nothing to sort.
    per_anchor = per_anchor.agg(F.sum("n").alias("size"), F.min(F.xxhash64("cid")).alias("lo"), F.max(F.xxhash64("cid")).alias("hi"))
    per_anchor = materialise(per_anchor.where("lo <> hi").select("anchor", "size"), "sizes")
    twice = contexts.groupBy("cid").agg(F.count("*").alias("times"), F.max("n").alias("n")).where("times > 1")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    dealt = given.join(per_anchor.hint("shuffle_hash"), "anchor")
    one = dealt.where(F.col("size") <= shard_bytes).select("anchor", "size", "cid", "bytes")
    one = one.repartition("anchor").sortWithinPartitions("anchor")
    out = [
        twice.select("cid", whole.alias("ranges")),
        one.mapInArrow(lambda it: _own_shards(it, shard_bytes), f"cid binary, ranges {_RANGES}"),
    ]
    most = per_anchor.agg(F.max("size")).first()[0] or 0
    if most > shard_bytes:
        blocks = F.ceil(F.col("size") / shard_bytes).cast("int")
        many = dealt.where(F.col("size") > shard_bytes).withColumn("blocks", blocks)
        if grids:
            many = many.where(F.col("blocks") <= merge_shards)
        block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        many = (
            many.withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                F.concat_ws(":", "anchor", F.least("block", "other"), F.greatest("block", "other")).alias("shard"),
                F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
                "anchor", "cid", "bytes", (F.col("block") == F.col("other")).alias("inside"),
            )
        )
        out.append(many.groupBy("shard").applyInArrow(_merged_shards, f"cid binary, ranges {_RANGES}"))
        if grids and most > shard_bytes * merge_shards:
            grid, *finer = grids
            hot = dealt.where(F.col("size") > shard_bytes * merge_shards)
            hot = hot.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("anchor", "at", "bytes")])
            cut = materialise(hot.mapInArrow(lambda it: _class_rows(it, grid), _CONTEXT_TYPE), "classes")
            found = _sorted_ranges(cut, shard_bytes, merge_shards, tuple(finer))
            out.append(_placed(cut, found).withColumnRenamed("owner", "cid"))
    return reduce(DataFrame.union, out)


def _placed(contexts: DataFrame, ranges: DataFrame, words: bool = False) -> DataFrame:
    """(owner, ranges): the ranges of contexts as ranges of what they were taken from, all of an owner in one array.

    With ``words`` those of words are in an array of their own, ``coded``.
    """
    each = ranges.groupBy("cid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    each = materialise(each, "ranges")  # as a table, so that the join can be split at a context in very many texts

    def moved(r: Column) -> Column:
        return F.struct((F.col("first") + r["start"]).alias("start"), (F.col("first") + r["end"]).alias("end"))

    joined = contexts.select("cid", "owner", "first", F.col("anchor").bitwiseAND(1).alias("kind")).join(each, "cid")
    by = joined.select("owner", "kind", F.transform("ranges", moved).alias("r")).groupBy("owner")
    if not words:
        return by.agg(F.flatten(F.collect_list("r")).alias("ranges"))
    of = [F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("r")))) for k in (0, 1)]
    return by.agg(of[0].alias("ranges"), of[1].alias("coded"))


def repeated_ranges(
    texts: DataFrame,
    shard_bytes: int = SHARD_BYTES,
    merge_shards: int = MERGE_SHARDS,
    grids: tuple[int, ...] = GRIDS,
    words: bool = False,
) -> DataFrame:
    """(v, ranges) of the texts of a table (v, id, text) of which v is the hash; copies of a text once.

    Ranges may overlap.  Only texts with repeated ranges have a row.  With
    ``words`` there are ranges of the words' digests too, in a column ``coded``.
    """
    places = texts.select("v", "text").mapInArrow(
        lambda it: _anchor_rows(it, words), "v binary, anchor long, first int, last int, at int"
    )
    places = materialise(places, "anchors")
    occurrence = F.xxhash64("v", "first")  # the same for a copy
    again = (
        places.groupBy("anchor")
        .agg(F.min(occurrence).alias("lo"), F.max(occurrence).alias("hi"))
        .where("lo <> hi")
        .select("anchor")
    )
    again = materialise(again, "again")  # as a table, so that the join can be split at a hot anchor
    kept = places.join(again.hint("shuffle_hash"), "anchor").groupBy("v").agg(
        F.collect_set(F.struct("anchor", "first", "last", "at")).alias("places")  # of one text
    )
    first_id = texts.groupBy("v").agg(F.min("id").alias("id"))
    wanted = kept.join(first_id, "v")
    carried = texts.select("v", "id", "text").join(wanted, ["v", "id"]).select("v", "text", "places")
    contexts = materialise(carried.mapInArrow(_context_rows, _CONTEXT_TYPE), "contexts")
    found = _placed(contexts, _sorted_ranges(contexts, shard_bytes, merge_shards, grids), words)
    return found.withColumnRenamed("owner", "v")


def _merged(ranges: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _passages(data: bytes, coded: list[dict]) -> list[dict]:
    """Byte ranges of a text from ranges of its words' digests."""
    start, end = word_places(np.frombuffer(data, dtype=np.uint8))
    if len(start) < PASSAGE:  # a copy of a short text
        return []
    runs = ((a // WORD_BYTES, min(b // WORD_BYTES, len(start))) for a, b in _merged(coded))
    return [{"start": int(start[i]), "end": int(end[j - 1])} for i, j in runs]


def _cut_batch(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    return _cut(zip((x.as_py() for x in texts.cast(pa.binary())), ranges.to_pylist()))


def _cut_passages(texts: pa.Array, ranges: pa.Array, coded: pa.Array) -> pa.Array:
    data, found = [x.as_py() for x in texts.cast(pa.binary())], ranges.to_pylist()
    more = [_passages(d, c) if c else [] for d, c in zip(data, coded.to_pylist())]
    cut = _cut((d, (f or []) + m) for d, f, m in zip(data, found, more))
    strings = _cut((d, f) for d, f, m in zip(data, found, more) if m)
    at = iter(range(len(strings)))
    strings = strings.take(pa.array([next(at) if m else None for m in more], type=pa.int64()))
    return pa.StructArray.from_arrays([*cut.flatten(), strings], names=["kept", "n_removed", "n_spans", "strings"])


def _cut(rows: Iterable[tuple[bytes, list[dict] | None]]) -> pa.Array:
    kept, removed, spans = [], [], []
    for data, found in rows:
        runs = _merged(found) if found else []
        at, parts = 0, []
        for a, b in runs:
            parts.append(data[at:a])
            at = b
        parts.append(data[at:])
        kept.append(b"".join(parts))
        removed.append(len(data) - len(kept[-1]))
        spans.append(len(runs))
    return pa.StructArray.from_arrays(
        [pa.array(kept, type=pa.binary()), pa.array(removed, type=pa.int64()), pa.array(spans, type=pa.int64())],
        names=["kept", "n_removed", "n_spans"],
    )


def cut_repeats(
    df: DataFrame,
    result: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int | None = None,
    words: bool = False,
    **shards,
) -> DataFrame:
    """``df`` with a column ``result``: struct<kept binary, n_removed, n_spans>; ``words``: without repeated passages too.

    With ``words`` the struct ends in such a struct ``strings`` of what strings
    of 400 bytes alone take away; it is null where no passage goes.
    """
    ship_package(df.sparkSession)
    v, i, r, c = (fresh_name(df, x) for x in ("v", "id", "ranges", "coded"))
    text = text_of(df, text_col)
    keyed = df.withColumns({v: F.unhex(F.md5(text.cast("binary"))), i: F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63)))})
    texts = keyed.select(F.col(v).alias("v"), F.col(i).alias("id"), text_of(keyed, text_col).alias("text"))
    ranges = materialise(repeated_ranges(texts, shard_bytes or SHARD_BYTES, words=words, **shards), "ranges")
    found = {"ranges": r, "coded": c} if words else {"ranges": r}
    rows = texts.select("v", "id", F.octet_length("text").cast("long").alias("n"))
    copies = rows.groupBy("v").agg(F.count("*").alias("copies"), F.max("n").alias("n")).where("copies > 1")

    def whole(n: Column, least: int) -> Column:
        return F.when(F.col("n") >= least, F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end"))))

    # A text of 400 bytes (or a passage) or more that occurs again as a whole goes as a whole.
    least = 2 * PASSAGE - 1 if words else SPAN
    gone = copies.where(F.col("n") >= least).select(
        "v", whole(F.col("n"), SPAN).alias("all"), whole(F.col("n") * WORD_BYTES, least).alias("all_words")
    )
    of_text = ranges.join(gone, "v", "full").withColumn("ranges", F.coalesce("all", "ranges"))
    if words:
        of_text = of_text.withColumn("coded", F.coalesce("all_words", "coded"))
    # By text and id, so that the rows of one text don't meet in one task.
    of_row = rows.select("v", "id").join(of_text.select("v", *found), "v").dropDuplicates(["v", "id"])
    of_row = of_row.select(F.col("v").alias(v), F.col("id").alias(i), *[F.col(x).alias(y) for x, y in found.items()])
    joined = keyed.join(of_row, [v, i], "left")
    fields = "kept:binary,n_removed:bigint,n_spans:bigint"
    cut = F.arrow_udf(_cut_passages, f"struct<{fields},strings:struct<{fields}>>") if words else F.arrow_udf(_cut_batch, f"struct<{fields}>")
    return joined.withColumn(result, cut(text_of(joined, text_col), *map(F.col, found.values()))).select(*df.columns, result)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """All rows and columns of ``df``, repeated strings (``words``: and passages) cut out of the text; null stays null."""
    name = fresh_name(df, "cut")
    out = cut_repeats(df, name, id_col, text_col, words=words)

    def decoded(kept: pa.Array) -> pa.Array:
        return pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], type=pa.string())

    whole = F.arrow_udf(decoded, "string")(F.col(f"{name}.kept"))
    text = F.when(F.col(f"{name}.n_removed") > 0, whole).otherwise(F.col(text_col))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns])


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated 400-byte strings are removed; then, with repeated passages gone too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = cut_repeats(docs, "cut", words=True)
    strings = {x: F.when(F.col("cut.strings").isNull(), F.col(f"cut.{x}")).otherwise(F.col(f"cut.strings.{x}")) for x in ("kept", "n_removed", "n_spans")}
    return cut.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        strings["n_removed"].alias("n_removed"),
        strings["n_spans"].alias("n_spans"),
        F.sha2(strings["kept"], 256).alias("kept_sha256"),
        F.col("cut.n_removed").alias("n_removed_words"),
        F.col("cut.n_spans").alias("n_spans_words"),
        F.sha2(F.col("cut.kept"), 256).alias("kept_words_sha256"),
    )


QUERIES = {"op2_suffix_array": op2_suffix_array}
ORACLE_SQL: dict[str, str] = {}
