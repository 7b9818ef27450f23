"""Divergence of sources by their terms, counted in mergeable radix tries.

Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII.
A language keeps the terms that at least ``LEAST_DOCS`` of its documents hold.
Every (language, source) group and every language gives each kept term a
smoothed share in parts per ``SHARES``; groups are compared with each other over
all kept terms, and with their language term by term.  All arithmetic is on
integers.

Plan.
1. Each task makes one byte trie of terms for each language; a leaf holds the
   number of documents and a counter for each source.  A trie is laid out in
   preorder and written as pieces: runs of leaves in UTF-8 order.
2. Cuts at about equal numbers of leaves make prefix ranges of a language.  Each
   piece marks every ``MARK``-th of its leaves, from a place that differs by piece,
   so cuts lie within pieces and a range holds no more leaves when there are more
   pieces; that many tries begin alike plays no part.  Pieces are
   cut there, and each range is merged into one trie as its pieces stream in, so
   a language or a term of any frequency is split or folded, never gathered.
   Leaves of too few documents fall away.  The cuts sent to the tasks are at most
   ``CUTS``, whatever the corpus.
3. The sizes of groups are summed up, and each merged piece is joined with its
   language's row of sources.  A traversal in UTF-8 order gives partial sums of
   pairs, and candidates: the first ``TOP`` of each source in a piece, so ties
   keep the order of the traversal.  Pairs of sources that a term does not have
   are not visited: their shares are constants, so sums start from them and
   only differences are added, once for each count that a source has.
4. Partial sums are added; candidates are ranked again.

Pieces are written and read a few at a time, and texts ``READ_ROWS`` at a time, so
the executor's JVM holds neither a file of pieces nor thousands of texts at once.
What a task holds is bounded by the leaves of a range (``RANGE`` or a ``CUTS``-th
of all) and by the sources of a language; the pairs of a language's sources are
the result itself.

Defined cases: null text, language or source is the empty string; a group
without terms is compared like any other; a language without kept terms has
pairs of value 0 and no terms; a language of one source has no rows; texts of
any length are counted whole, about ``SLICE`` bytes at a time; repeated rows are
documents of their own; ties go to the item that is less in UTF-8; an empty table
gives no rows; further columns play no part, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import give_back, table
from corpusloom.sources.session import long_rows, materialise, ship_package

LEAST_DOCS = 3
SHARES = 1_000_000_000
TOP = 200
#: Leaves of a piece and of a prefix range, cuts of all languages, and counters of a task's tries before they are written.
PIECE = 16_384
RANGE = 1 << 18
CUTS = 1 << 14
HELD = 500_000
SLICE = 1 << 20
#: Leaves of a counted piece, which is smaller, and of the pieces that are written, and later read, at once.
COUNTED = 2048
GROUP = 1 << 16
#: Leaves for each mark of a piece.
MARK = 4096
#: Numbers that a numpy step works on at once.
STEP = 1 << 20

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)  # anything else becomes a blank


def term_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        piece = raw[at:end].translate(_LETTERS)
        if end < len(raw):
            cut = piece.rfind(b" ") + 1
            while not cut:  # a term longer than a slice
                end += SLICE
                piece = raw[at:end].translate(_LETTERS)
                cut = len(piece) if end >= len(raw) else piece.rfind(b" ") + 1
            end = at + cut
            piece = piece[:cut]
        yield piece.split()
        at = end


class RadixTrie:
    """A radix trie over bytes, laid out in its preorder.

    A leaf is told by how many bytes it shares with the leaf before, which is how
    deep their branches part, and by the bytes below.  It has a number of
    documents and a counter for each source that has it.  Leaves in this order
    are in the order of UTF-8, a prefix range is a slice, and tries are merged by
    merging their orders.
    """

    def __init__(self, terms: list[bytes], docs: np.ndarray, width: np.ndarray, names: list[str], source: np.ndarray, count: np.ndarray) -> None:
        self.terms, self.docs, self.width = terms, docs, width
        self.names, self.source, self.count = names, source, count

    def __len__(self) -> int:
        return len(self.terms)

    @classmethod
    def of_entries(cls, terms: list[bytes], docs: np.ndarray, names: list[str], leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> RadixTrie:
        """A trie of sorted terms; ``leaf``, ``source`` and ``count`` are counters in any order, equal ones are added up."""
        key = leaf * len(names) + source
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(count[order], head) if len(head) else count[:0]
        leaf, source = np.divmod(key[head], max(1, len(names)))
        return cls(terms, docs, np.bincount(leaf, minlength=len(terms)), names, source, total)

    @classmethod
    def of_counts(cls, counts: dict[str, Counter], docs: Counter) -> RadixTrie:
        """The trie of one language: counts of terms by source, and numbers of documents."""
        terms = sorted(docs)
        place = dict(zip(terms, range(len(terms))))
        sizes = [len(c) for c in counts.values()]
        leaf = np.fromiter((place[t] for c in counts.values() for t in c), dtype=np.int64, count=sum(sizes))
        count = np.fromiter(chain.from_iterable(c.values() for c in counts.values()), dtype=np.int64, count=sum(sizes))
        own = np.fromiter(map(docs.__getitem__, terms), dtype=np.int64, count=len(terms))
        return cls.of_entries(terms, own, list(counts), leaf, np.repeat(np.arange(len(sizes)), sizes), count)

    @classmethod
    def merged(cls, tries: list[RadixTrie]) -> RadixTrie:
        every = list(chain.from_iterable(t.terms for t in tries))
        order = sorted(range(len(every)), key=every.__getitem__)  # runs in order, so this is a merge
        terms: list[bytes] = []
        leaf = np.empty(len(every), dtype=np.int64)
        for i in order:
            if not terms or every[i] != terms[-1]:
                terms.append(every[i])
            leaf[i] = len(terms) - 1
        docs = np.zeros(len(terms), dtype=np.int64)
        np.add.at(docs, leaf, np.concatenate([t.docs for t in tries]))
        names: dict[str, int] = {}
        sources = [np.array([names.setdefault(n, len(names)) for n in t.names], dtype=np.int64)[t.source] for t in tries]
        entries = np.repeat(leaf, np.concatenate([t.width for t in tries]))
        return cls.of_entries(terms, docs, list(names), entries, np.concatenate(sources), np.concatenate([t.count for t in tries]))

    def where(self, keep: np.ndarray) -> RadixTrie:
        """The leaves that a mask keeps."""
        entries = np.repeat(keep, self.width)
        terms = [t for t, k in zip(self.terms, keep.tolist()) if k]
        return RadixTrie(terms, self.docs[keep], self.width[keep], self.names, self.source[entries], self.count[entries])

    def cut(self, a: int, b: int) -> RadixTrie:
        """The leaves from a to b."""
        ends = np.concatenate([[0], np.cumsum(self.width)])
        mine = slice(int(ends[a]), int(ends[b]))
        return RadixTrie(self.terms[a:b], self.docs[a:b], self.width[a:b], self.names, self.source[mine], self.count[mine])

    def pieces(self, size: int) -> Iterator[RadixTrie]:
        for at in range(0, len(self), size):
            yield self.cut(at, min(len(self), at + size))


#: A run of leaves in order: each term as bytes shared with the one before and a rest; counters of all leaves in a row.
PIECE_TYPE = (
    "lang string, range int, first binary, last binary, n int, shared array<int>, rest array<binary>, docs array<bigint>, "
    "width array<int>, names array<string>, source array<int>, count array<bigint>, sums array<bigint>"
)
_ARROW = {
    "lang": pa.string(), "range": pa.int32(), "first": pa.binary(), "last": pa.binary(), "n": pa.int32(),
    "shared": pa.list_(pa.int32()), "rest": pa.list_(pa.binary()), "docs": pa.list_(pa.int64()), "width": pa.list_(pa.int32()),
    "names": pa.list_(pa.string()), "source": pa.list_(pa.int32()), "count": pa.list_(pa.int64()), "sums": pa.list_(pa.int64()),
}
#: What a task writes: pieces, and some of their terms, each for so many leaves.
COUNTED_TYPE = PIECE_TYPE + ", marks array<binary>"
#: Bytes that a leaf may share with the one before.
SHARED = 32


def _common(terms: list[bytes]) -> np.ndarray:
    """How many bytes, at most ``SHARED``, each term has in common with the one before; no term has a zero byte."""
    bytes_ = np.array([t[:SHARED] for t in terms], dtype=f"S{SHARED}").view(np.uint8).reshape(len(terms), SHARED)
    same = (bytes_[1:] == bytes_[:-1]) & (bytes_[1:] > 0)
    return np.concatenate([[0], np.where(same.all(axis=1), SHARED, (~same).argmax(axis=1))])


def pack(lang: str, at: int, trie: RadixTrie) -> pa.RecordBatch:
    """One row that holds a trie with leaves; sources that it has no counter of are left out."""
    used, source = np.unique(trie.source, return_inverse=True)
    shared = _common(trie.terms)
    row = {
        "lang": lang, "range": at, "first": trie.terms[0], "last": trie.terms[-1], "n": len(trie), "shared": shared,
        "rest": [t[k:] for t, k in zip(trie.terms, shared.tolist())], "docs": trie.docs, "width": trie.width,
        "names": [trie.names[u] for u in used.tolist()], "source": source.ravel(), "count": trie.count,
        "sums": np.bincount(source.ravel(), minlength=len(used)) * 0,
    }
    np.add.at(row["sums"], row["source"], trie.count)
    return pa.RecordBatch.from_arrays([pa.array([row[c]], type=t) for c, t in _ARROW.items()], names=list(_ARROW))


def marks(trie: RadixTrie, every: int) -> list[bytes]:
    """Every so many terms, from a place that differs by trie: how often terms are marked tells how many leaves lie between."""
    told = f"{len(trie)} {int(trie.count.sum())}".encode()
    return trie.terms[crc32(trie.terms[0] + b"\0" + trie.terms[-1] + told) % every :: every]


def terms_of(row: dict) -> list[bytes]:
    """The terms of a packed trie."""
    out, before = [], b""
    for same, rest in zip(row["shared"], row["rest"]):
        before = before[:same] + rest
        out.append(before)
    return out


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Packed rows, one at a time; numbers as numpy arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            value = batch.column(name)[i]
            numbers = isinstance(value, pa.ListScalar) and pa.types.is_integer(value.type.value_type) and name != "shared"
            row[name] = value.values.to_numpy().astype(np.int64) if numbers else value.as_py()
        yield row


def unpack(row: dict) -> RadixTrie:
    return RadixTrie(terms_of(row), row["docs"], row["width"], row["names"], row["source"], row["count"])


def _count(batches: Iterator[pa.RecordBatch], piece: int, held: int, every: int) -> Iterator[pa.RecordBatch]:
    """A task's tries, one for each language, as pieces with marks; written whenever they have more than ``held`` counters."""
    counts: dict[str, dict[str, Counter]] = {}
    docs: dict[str, Counter] = {}

    def write() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            for part in RadixTrie.of_counts(own, docs[lang]).pieces(piece):
                yield pack(lang, 0, part).append_column("marks", pa.array([marks(part, every)], type=pa.list_(pa.binary())))
        counts.clear()
        docs.clear()

    for batch in batches:
        by: dict[tuple[str, str], list[bytes]] = {}
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
            by.setdefault((lang, source), []).append(text)
        for (lang, source), texts in by.items():
            own = counts.setdefault(lang, {}).setdefault(source, Counter())
            seen = docs.setdefault(lang, Counter())
            distinct = []
            for raw in texts:
                once: set[bytes] = set()
                for terms in term_lists(raw):
                    own.update(terms)
                    once.update(terms)
                distinct.append(once)
            seen.update(chain.from_iterable(distinct))
        if sum(len(c) for own in counts.values() for c in own.values()) > held:
            yield from write()
    yield from write()
    give_back()


def _cut(batches: Iterator[pa.RecordBatch], cuts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Pieces with the range that they lie in, cut where they lie in several."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            lang, first, last = (one.column(c)[0].as_py() for c in ("lang", "first", "last"))
            at = cuts.get(lang, [])
            low, high = bisect_right(at, first), bisect_right(at, last)
            if low == high:
                yield one.set_column(1, "range", pa.array([low], type=pa.int32()))
                continue
            trie = unpack(next(rows_of(one)))
            ends = [0, *(bisect_left(trie.terms, c) for c in at[low:high]), len(trie)]
            for place, a, b in zip(range(low, high + 1), ends, ends[1:]):
                if a < b:
                    yield pack(lang, place, trie.cut(a, b))


def _merge(batches: Iterator[pa.RecordBatch], piece: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """One trie for each range, of pieces sorted by range; its leaves of enough documents, as pieces.

    Pieces are merged whenever they have more than ``most`` leaves, so a task holds
    these and the range's distinct terms.
    """
    key, held = None, []

    def write() -> Iterator[pa.RecordBatch]:
        trie = RadixTrie.merged(held)
        for part in trie.where(trie.docs >= least).pieces(piece):
            yield pack(*key, part)

    for batch in batches:
        for row in rows_of(batch):
            if (row["lang"], row["range"]) != key:
                if key is not None:
                    yield from write()
                key, held = (row["lang"], row["range"]), []
            held.append(unpack(row))
            if len(held) > 1 and sum(map(len, held)) > max(most, 2 * len(held[0])):
                held = [RadixTrie.merged(held)]
    if key is not None:
        yield from write()
    give_back()


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SHARES * (count + 1) / whole), exact: three digits of the quotient at a time."""
    quotient, left = np.divmod(count + 1, whole)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, whole)
        quotient = quotient * 1000 + digits
    return quotient + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(term: np.ndarray, source: np.ndarray, count: np.ndarray, whole: np.ndarray, low: int, high: int) -> np.ndarray:
    """Sums over terms, for the pairs of sources low to high with all, of what exceeds the pair's constant.

    ``term`` (sorted), ``source`` and ``count`` are the counts that are not zero;
    the constant of a pair is its value where both counts are zero.
    """
    zero = share(np.zeros(len(whole), dtype=np.int64), whole)
    out = np.zeros((high - low, len(whole)), dtype=np.int64)
    p = share(count, whole[source])
    constant = difference(zero[low:high, None], zero[None, :])
    for s in np.unique(source).tolist():
        shares, often = np.unique(p[source == s], return_counts=True)
        for at in range(0, len(shares), step := max(1, STEP // len(whole))):
            x, n = shares[at : at + step, None], often[at : at + step, None]
            if low <= s < high:  # this source's counts against no count
                out[s - low] += (n * (difference(x, zero[None, :]) - constant[s - low])).sum(axis=0)
            # no count against this source's counts
            out[:, s] += (n * (difference(zero[None, low:high], x) - constant[:, s])).sum(axis=0)
    # Terms that both sources have: entries of the rows' sources with all entries of the same term.
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(term)))
    of = np.repeat(np.arange(len(starts)), sizes)
    mine = np.flatnonzero((source >= low) & (source < high))
    ends = np.cumsum(sizes[of[mine]])
    at = 0
    while at < len(mine):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        rows = mine[at:last]
        wide = sizes[of[rows]]
        i = np.repeat(rows, wide)
        j = np.repeat(starts[of[rows]], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        a, b = source[i], source[j]
        both = difference(p[i], p[j]) - difference(p[i], zero[b]) - difference(zero[a], p[j]) + difference(zero[a], zero[b])
        np.add.at(out, (a - low, b), both)
        at = last
    np.fill_diagonal(out[:, low:], 0)
    return out


_SCORE_TYPE = "lang string, source string, part string, item string, value bigint"


def _score(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of pairs and candidate terms of merged pieces, each with its language's sources."""

    def rows(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
        n = len(source)
        columns = [pa.array([lang] * n), pa.array(source), pa.array([part] * n), pa.array(item), pa.array(value, type=pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

    for batch in batches:
        for row in rows_of(batch):
            names = [g["source"] for g in row["groups"]]
            whole = np.array([g["size"] for g in row["groups"]], dtype=np.int64) + row["kept"]
            place = {name: k for k, name in enumerate(names)}
            source = np.array([place[name] for name in row["names"]], dtype=np.int64)[row["source"]]
            count = row["count"]
            term = np.repeat(np.arange(row["n"]), row["width"])
            for low in range(0, len(names), step := max(1, 4 * STEP // len(names))):
                high = min(len(names), low + step)
                sums = pair_sums(term, source, count, whole, low, high)
                a, b = np.nonzero(sums)
                if len(a):
                    yield rows(row["lang"], [names[low + x] for x in a], "pair", [names[x] for x in b], sums[a, b])
            total = np.bincount(term, minlength=row["n"]) * 0
            np.add.at(total, term, count)
            q = share(total, np.int64(sum(g["size"] for g in row["groups"]) + row["kept"]))[term]
            p = share(count, whole[source])
            more = np.flatnonzero(p > q)
            value = difference(p[more], q[more])
            order = np.lexsort((term[more], -value, source[more]))
            mine = source[more][order]
            rank = np.arange(len(order)) - np.searchsorted(mine, mine)
            best = order[rank < top]
            if len(best):
                terms = terms_of(row)
                yield rows(
                    row["lang"], [names[source[e]] for e in more[best]], "term",
                    [terms[term[e]].decode("utf-8", "replace") for e in more[best]], value[best],
                )


def _cuts(pieces: DataFrame, size: int, most: int, every: int) -> dict[str, list[bytes]]:
    """Where each language's ranges begin, but for the first: about equal numbers of leaves, at most ``most`` cuts in all."""
    total = pieces.agg(F.sum("n")).first()[0] or 0
    size = max(size, -(-total // most))
    marked = pieces.select("lang", F.explode("marks").alias("first")).groupBy("lang", "first").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    group = F.floor(F.coalesce(before, F.lit(0)) * every / size)
    begins = marked.withColumn("group", group).where("group > 0").groupBy("lang", "group").agg(F.min("first").alias("first"))
    out: dict[str, list[bytes]] = {}
    for r in begins.orderBy("lang", "first").collect():
        own = out.setdefault(r["lang"], [])
        if not own or own[-1] != bytes(r["first"]):
            own.append(bytes(r["first"]))
    return out


def merged_terms(rows: DataFrame, least: int = LEAST_DOCS, piece: int = PIECE, size: int = RANGE, held: int = HELD) -> DataFrame:
    """Kept terms of a table (text, lang, source) without nulls, as pieces."""
    counted = rows.select(F.col("text").cast("binary"), "lang", "source")
    every = max(1, min(MARK, size // 64))
    small = min(piece, COUNTED)
    pieces = materialise(counted.mapInArrow(lambda it: _count(it, small, held, every), COUNTED_TYPE), "tries", max(1, GROUP // small))
    cuts = _cuts(pieces, size, CUTS, every)
    pieces = pieces.drop("marks")
    ranged = pieces.mapInArrow(lambda it: _cut(it, cuts), PIECE_TYPE) if cuts else pieces
    dealt = ranged.repartition("lang", "range").sortWithinPartitions("lang", "range")
    return materialise(dealt.mapInArrow(lambda it: _merge(it, piece, least, size), PIECE_TYPE), "merged", max(1, GROUP // piece))


def audit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS,
    top: int = TOP, piece: int = PIECE, size: int = RANGE, held: int = HELD,
) -> DataFrame:
    """(lang, source, part, item, value, rank): sources against each other, and the terms that they have more of."""
    ship_package(df.sparkSession)

    def known(c: str) -> Column:
        return F.coalesce(df[c].cast("string"), F.lit(""))

    rows = df.select(known(text_col).alias("text"), known(lang_col).alias("lang"), known(source_col).alias("source"))
    with long_rows(df.sparkSession):
        merged = merged_terms(rows, least, piece, size, held)
        sizes = merged.select("lang", F.explode(F.arrays_zip("names", "sums")).alias("g"))
        sizes = sizes.groupBy("lang", F.col("g.names").alias("source")).agg(F.sum("g.sums").alias("size"))
        kept = merged.groupBy("lang").agg(F.sum("n").alias("kept"))
        groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["size"])
        groups = materialise(groups, "groups")
        langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("groups"))
        langs = materialise(langs.join(kept, "lang", "left").fillna(0, ["kept"]), "langs")
        scored = materialise(merged.join(langs, "lang").mapInArrow(lambda it: _score(it, top), _SCORE_TYPE), "scored")

    each = groups.join(langs, "lang").select("lang", "source", "size", "kept", F.explode("groups").alias("other"))
    each = each.where(F.col("source") != F.col("other.source"))
    p, q = (F.expr(f"1 + {SHARES} div greatest({n} + kept, 1)") for n in ("size", "other.size"))  # 0 where nothing is kept
    constant = each.select("lang", "source", F.col("other.source").alias("item"), "kept", p.alias("p"), q.alias("q"))
    constant = constant.select("lang", "source", "item", F.expr("kept * (((p - q) * (p - q)) div q)").alias("value"))
    sums = scored.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(constant)
    wide = F.sum(F.col("value").cast("decimal(38,0)")).cast("long")
    pairs = sums.groupBy("lang", "source", "item").agg(wide.alias("value")).withColumn("part", F.lit("pair"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by))
    terms = scored.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).union(terms.select(*columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language against each other, and the 200 terms that set each apart."""
    return audit(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL = (
    "with t as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, "
    f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as text from documents), "
    r"w as (select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from t), "
    f"k as (select lang, term from w group by lang, term having count(distinct row) >= {LEAST_DOCS}), "
    "c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by all), "
    "g as (select distinct lang, source from t), v as (select lang, count(*) as v from k group by lang), "
    "z as (select lang, source, coalesce(sum(n), 0)::hugeint as size from g left join c using (lang, source) group by all), "
    "s as (select g.lang, g.source, k.term, coalesce(n, 0) as n, "
    f"1 + ({SHARES}::hugeint * (coalesce(n, 0) + 1)) // (size + v) as p from g join z using (lang, source) join k on k.lang = g.lang "
    "join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term), "
    f"l as (select lang, term, 1 + ({SHARES}::hugeint * (sum(n) + 1)) // (any_value(whole) + any_value(v)) as q from c "
    "join v using (lang) join (select lang, sum(size) as whole from z group by lang) using (lang) group by lang, term), "
    "o as (select a.lang, a.source, b.source as item from g a join g b on a.lang = b.lang and a.source <> b.source), "
    "f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from s a join s b "
    "on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all), "
    "pr as (select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value from o left join f using (lang, source, item)), "
    "tm as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from s join l "
    "using (lang, term) where n > 0 and p > q), "
    "u as (select * from pr union all select * from tm), "
    "r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from u) "
    f"select lang, source, part, item, value, rank from r where part = 'pair' or rank <= {TOP}"
)

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL: dict[str, str] = {"op13_source_divergence": _SQL}
