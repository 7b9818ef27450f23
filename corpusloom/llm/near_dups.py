"""Near-duplicates by Order MinHash, verified by banded alignment.

Similarity.  A text is the sequence of its word 5-grams (lower case; a shorter
text is one gram).  Two texts with m grams aligned in order, of n1 and n2, have
similarity m / (n1 + n2 - m): the Jaccard measure of what an alignment keeps.
Texts of ``threshold`` (0.8) or more are linked; a class is a component of
links and equal texts.

Sketch.  k-mers are the word 5-grams, each labelled with its occurrence number
in the text for the draw.  Each of ``TABLES`` hash functions draws the ``PICKS``
labelled k-mers of least hash; the k-mers themselves, in text order, are one
bucket key, so reordered texts differ.  At similarity 0.8 two texts share one of
16 tables of 3 picks with probability over 0.9999.

Candidates.  Equal texts are first joined to one node.  A bucket's centre is
its member that shares buckets with most others (the original among copies);
every other member is paired with it: a linear number of pairs.  Then, in
buckets that still hold several components, every pair across components is
excluded by a bound or tried: a bucket of more than ``BLOCK`` members is dealt
by length band and salt into blocks of about that size, each two blocks meet in
one task, and pairs whose parity signatures (``PARITY_BITS`` bits, one toggled by
each k-mer) differ in more bits than alike texts can have k-mers unshared are
dropped.  Nothing is capped: no pair of a bucket is left out.  While buckets of
more than ``BLOCK`` members in several components are left and a tenth of the
last pairs were links, another member is the centre first.  Rows of the last
step grow with the square of a bucket's components, divided by ``BLOCK``.

A node is named by the least id of its text and the text's digest, in bytes that
sort by id, so the least name of a class gives its least id.

Shuffles carry names and keys; whole texts move once (those in a shared bucket
stay), then only with pairs.  Hot keys only meet partial aggregates and plain
joins of tables, which adaptive execution splits.

Defined cases: a null text is the empty text, which has no k-mer and is alike
only to its equals; texts that differ in case or white space are alike; texts of
any length are read whole, their sketch in steps of bounded memory; repeated
rows are copies of each other; ties between centres go to the greater name; a
null id is never a class's least id unless all are null, then the class is null;
an empty table gives no rows; further columns play no part, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import give_back, table, text_of
from corpusloom.llm.hashing import BASE, BASE_INVERSE, mixed, powers
from corpusloom.operators.components import connected_components
from corpusloom.sources.session import fresh_name, materialise, ship_package

GRAM = 5
TABLES = 16
PICKS = 3
THRESHOLD = 0.8
BLOCK = 1024
PARITY_BITS = 4096


def _stable_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    raw = np.frombuffer("\0".join(words).encode(), dtype=np.uint8)
    ends = np.flatnonzero(raw == 0)
    starts = np.concatenate([[0], ends + 1])
    value = (raw.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * powers(BASE, len(raw))
    return mixed(np.add.reduceat(value, starts) * powers(BASE_INVERSE, len(raw))[starts])


def gram_hashes(word_hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of word n-grams; a text of fewer words is one gram, one of none has none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[j : n - size + 1 + j]
    return mixed(out)


def words_of(text: str) -> list[str]:
    return text.replace("\0", " ").lower().split()


@lru_cache(maxsize=8)
def _seeds(tables: int) -> np.ndarray:
    return mixed(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]


def occurrences(grams: np.ndarray) -> np.ndarray:
    """The k-mers labelled with their occurrence number; a first occurrence keeps its hash."""
    _, where, count = np.unique(grams, return_inverse=True, return_counts=True)
    if not len(grams) or count.max() == 1:
        return grams
    order = np.argsort(where, kind="stable")
    first = np.cumsum(count) - count
    label = np.empty(len(grams), dtype=np.uint64)
    label[order] = (np.arange(len(grams)) - np.repeat(first, count)).astype(np.uint64)
    return np.where(label == 0, grams, mixed(grams + label * np.uint64(0xA0761D6478BD642F)))


def order_minhash(grams: np.ndarray, tables: int = TABLES, picks: int = PICKS) -> np.ndarray:
    """One key for each table: the k-mers, in text order, of which the occurrence-labelled hashes are least."""
    labelled = occurrences(grams)
    picks = min(picks, len(grams))
    seeds = _seeds(tables)
    key = seeds[:, 0] + np.uint64(picks)  # keys of different tables differ
    for at in range(0, tables, step := max(1, min(tables, 1_000_000 // len(grams)))):  # bounded memory for long texts
        drawn = mixed(labelled[None, :] ^ seeds[at : at + step])
        least = np.sort(np.argpartition(drawn, picks - 1, axis=1)[:, :picks], axis=1)
        for j in range(picks):
            key[at : at + step] = mixed(key[at : at + step] + grams[least[:, j]])
    return key


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys = [], []
        for text in batch.column(2):
            words = words_of(text.as_py())
            grams = gram_hashes(_stable_hashes(words)) if words else np.zeros(0, dtype=np.uint64)
            sizes.append(len(grams))
            keys.append(order_minhash(grams).view(np.int64) if len(grams) else np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, type=pa.int32()), pa.array(keys, type=pa.list_(pa.int64()))],
            names=["id", "digest", "n", "keys"],
        )
    give_back()


def _banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence within a band around the diagonal, by bit vectors."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for j, y in enumerate(b):
        match = where.get(y)
        if match:
            low = max(0, j - band)
            match &= ((1 << (2 * band + 1)) - 1) << low if j >= band else (1 << (j + band + 1)) - 1
            hit = row & match
            row = ((row + hit) | (row & ~match)) & full
    return len(a) - row.bit_count()


def aligned(a: list[int], b: list[int], threshold: float = THRESHOLD) -> float:
    """Similarity of two gram sequences; 0 where it is sure to be below the threshold."""
    if not a or not b:
        return 0.0
    n = len(a) + len(b)
    shared = sum((Counter(a) & Counter(b)).values())  # no alignment keeps more
    if shared < threshold * (n - shared):
        return 0.0
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    mid_a, mid_b = a[first : len(a) - last], b[first : len(b) - last]
    # At the threshold so many grams of the two texts may stay unaligned; no path leaves this band.
    band = int(n - 2 * threshold / (1 + threshold) * n) + 1
    kept = first + last + (_banded_lcs(mid_a, mid_b, band) if mid_a and mid_b else 0)
    return kept / (n - kept)


def similarity(x: str, y: str, threshold: float = THRESHOLD) -> float:
    """Similarity of two texts; 0 where it is sure to be below the threshold."""

    def grams(text: str) -> list[int]:
        words = words_of(text)
        h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
        return gram_hashes(h).tolist()

    return aligned(grams(x), grams(y), threshold)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column(2), batch.column(3))
        good = pa.array([similarity(x.as_py(), y.as_py(), threshold) >= threshold for x, y in pairs], type=pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]], names=["v1", "v2"])
    give_back()


def parity(text: str) -> bytes:
    """A text's signature: each labelled k-mer toggles one of ``PARITY_BITS`` bits."""
    grams = occurrences(gram_hashes(_stable_hashes(words_of(text))))
    odd = np.bincount((grams % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([parity(t.as_py()) for t in batch.column(1)], type=pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["v", "parity"])
    give_back()


#: Two blocks, by length band and salt, of a bucket; a small bucket is one block.
_BLOCKS = ["key", "b1", "s1", "b2", "s2"]
_MEMBER = ["band", "salt", "v", "n", "label", "parity"]


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The runs of rows that agree in ``by``, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch[c].to_numpy() for c in by])
        starts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            own = values[:, a].tolist()
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            key = own
    if held:
        yield pa.Table.from_batches(held)


def _possible(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs across components of two blocks (or within one) that no bound excludes."""
    for group in _groups(batches, _BLOCKS):
        n = group["n"].to_numpy().astype(np.float64)
        label = group["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        bits = np.frombuffer(b"".join(group["parity"].to_pylist()), dtype=np.uint64).reshape(len(n), -1)
        b1, s1, b2, s2 = (group[c][0].as_py() for c in _BLOCKS[1:])
        one = (group["band"].to_numpy() == b1) & (group["salt"].to_numpy() == s1)
        within = (b1, s1) == (b2, s2)
        right = np.flatnonzero(one if within else ~one)
        v = group["v"].combine_chunks()
        for i in np.flatnonzero(one).tolist():
            js = right[right > i] if within else right
            js = js[(label[js] != label[i]) & (np.minimum(n[js], n[i]) >= threshold * np.maximum(n[js], n[i]))]
            # Each bit that differs stands for at least one k-mer that the two texts do not share.
            unshared = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
            js = js[unshared <= (n[js] + n[i]) * (1 - threshold) / (1 + threshold) + 1e-6]
            if len(js):
                pair = [v.take(pa.array(np.full(len(js), i))), v.take(pa.array(js))]
                yield pa.RecordBatch.from_arrays(pair, names=["v1", "v2"])
    give_back()


def _all_across(members: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs (v1, v2) across components of buckets, all but those that surely are not alike."""
    signed = texts.join(members.select("v").distinct(), "v", "left_semi").select("v", "text")
    signed = materialise(signed.mapInArrow(_parities, "v binary, parity binary"), "parities")
    zero = F.lit(0).cast("long")
    small = members.where(F.col("size") <= block)
    dealt = small.select("key", *[zero.alias(c) for c in (*_BLOCKS[1:], "band", "salt")], "v", "n", "label")
    large = members.where(F.col("size") > block)
    if not large.isEmpty():
        # Texts whose bands differ by two or more differ too much in length.
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(1 / threshold) + 1e-9))
        rows = large.select("key", "v", "n", "label", band.alias("band"))
        counts = rows.groupBy("key", "band").agg(F.ceil(F.count("*") / block).alias("salts"))
        above = counts.select("key", (F.col("band") - 1).alias("band"), F.col("salts").alias("salts_above"))
        below = counts.select("key", (F.col("band") + 1).alias("band"), F.col("salts").alias("salts_below"))
        counts = counts.join(above, ["key", "band"], "left").join(below, ["key", "band"], "left")
        rows = rows.join(materialise(counts, "bands"), ["key", "band"])
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")))

        def blocks(salts: str, b1: Column, s1, b2: Column, s2) -> Column:
            """The pairs of blocks of a row with each block of a band."""
            each = F.when(F.col(salts) > 0, F.sequence(zero, F.col(salts) - 1))
            each = F.coalesce(each, F.array().cast("array<bigint>"))
            return F.transform(each, lambda x: F.struct(b1.alias("b1"), s1(x).alias("s1"), b2.alias("b2"), s2(x).alias("s2")))

        own, up, down, salt = F.col("band"), F.col("band") + 1, F.col("band") - 1, F.col("salt")
        met = F.concat(
            blocks("salts", own, lambda x: F.least(x, salt), own, lambda x: F.greatest(x, salt)),
            blocks("salts_above", own, lambda x: salt, up, lambda x: x),
            blocks("salts_below", down, lambda x: x, own, lambda x: salt),
        )
        each = rows.withColumn("met", F.explode(met)).select("key", "met.*", "band", "salt", "v", "n", "label")
        dealt = dealt.union(each)
    dealt = dealt.join(signed, "v").select(*_BLOCKS, *_MEMBER)
    dealt = dealt.repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS)
    return dealt.mapInArrow(lambda it: _possible(it, threshold), "v1 binary, v2 binary")


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (v1, v2) whose texts are alike."""
    one = texts.select(F.col("v").alias("v1"), F.col("text").alias("x"))
    two = texts.select(F.col("v").alias("v2"), F.col("text").alias("y"))
    joined = pairs.select("v1", "v2").join(two, "v2").join(one, "v1").select("v1", "v2", "x", "y")
    return materialise(joined.mapInArrow(lambda it: _verify(it, threshold), "v1 binary, v2 binary"), "links")


def _node(rid: Column, digest: Column) -> Column:
    """Name of a text's node: whether its least id is null, that id so that bytes sort as it does, the digest."""
    ordered = rid.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(
        F.when(rid.isNull(), F.unhex(F.lit("01" + "0" * 16))).otherwise(
            F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(ordered), 16, "0")))
        ),
        digest,
    )


def _id_of(node: Column) -> Column:
    """The id in a node's name."""
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.substring(node, 1, 1) == F.unhex(F.lit("00")), value)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _members(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, v, n, label, size) of buckets that hold several components."""
    member = shared.select("key", "v", "n").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    member = materialise(member, "labelled")
    split = member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
    split = materialise(split.where("lo <> hi").select("key", "size"), "split")
    return materialise(member.join(split, "key"), "members")


def node_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(digest, v, label) of each distinct text: its digest, its node's name, and the least name of its class."""
    ship_package(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("id"), text_of(df, text_col).alias("text"))
    rows = rows.select("id", _digest(F.col("text")).alias("digest"), "text")
    nodes = (
        rows.mapInArrow(_sketch, "id long, digest binary, n int, keys array<long>")
        .groupBy("digest")
        .agg(F.min("id").alias("rid"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        .select("digest", "rid", _node(F.col("rid"), F.col("digest")).alias("v"), "n", "keys")
    )
    nodes = materialise(nodes, "nodes")
    entries = nodes.select("v", "n", F.explode("keys").alias("key"))
    sizes = materialise(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    # A node has at most ``TABLES`` rows, so this window has no hot key.
    fame = F.sum("size").over(Window.partitionBy("v"))
    shared = materialise(entries.join(sizes, "key").select("key", "v", "n", fame.alias("fame")), "shared")

    wanted = shared.select("v").distinct().select(F.substring("v", 10, 16).alias("digest"), _id_of(F.col("v")).alias("rid"), "v")
    none = F.lit(-(1 << 63))
    texts = (
        rows.withColumn("rid", F.coalesce("id", none))
        .join(wanted.withColumn("rid", F.coalesce("rid", none)), ["digest", "rid"])
        .groupBy("v")
        .agg(F.first("text").alias("text"))
    )
    texts = materialise(texts, "texts")

    # Alignment can't reach the threshold where the lengths differ by more.
    fits = F.least("n1", "n2") >= threshold * F.greatest("n1", "n2")

    def linked_to_centres(of: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
        """Each bucket's greatest member by ``order`` with the members of other components, and the alike pairs."""
        centre = of.groupBy("key").agg(F.max(F.struct(order.alias("order"), "v", "n", "label")).alias("c"))
        centre = centre.select("key", F.col("c.v").alias("v1"), F.col("c.n").alias("n1"), F.col("c.label").alias("l1"))
        centre = materialise(centre, "centres")
        pairs = of.select("key", F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("label").alias("l2"))
        pairs = pairs.join(centre, "key").where(fits & (F.col("l1") != F.col("l2"))).select("v1", "v2").distinct()
        pairs = materialise(pairs, "pairs")
        return pairs, _linked(pairs, texts, threshold)

    tried, links = linked_to_centres(shared.withColumn("label", F.col("v")), F.col("fame"))
    labels = connected_components(links)
    new, turn = links, 0
    while True:
        members = _members(shared, labels)
        left, most = members.agg(F.count("*"), F.max("size")).first()
        if not left:
            break
        turn += 1
        if most > block and 10 * new.count() > tried.count():
            tried, new = linked_to_centres(members.where(F.col("size") > block), F.xxhash64("v", F.lit(turn)))
            links = links.union(new)
            labels = connected_components(links)
            continue
        across = _all_across(members, texts, threshold, block)
        ordered = across.select(F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2")).distinct()
        found = _linked(ordered, texts, threshold)
        if not found.isEmpty():
            labels = connected_components(links.union(found))
        break  # every pair across components has been tried or excluded
    return materialise(
        nodes.select("digest", "v").join(labels, "v", "left").select("digest", "v", F.coalesce("label", "v").alias("label")),
        "classes",
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col`` and ``class_id``, the least id among its near-duplicates, for each row."""
    found = node_classes(df, id_col, text_col, threshold)
    found = found.select("digest", _id_of(F.col("label")).alias("class_id"))
    rows = df.select(df[id_col].cast("long").alias(id_col), _digest(text_of(df, text_col)).alias("digest"))
    return rows.join(found, "digest").select(id_col, "class_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The row of least id of each class, with the columns of ``df``."""
    found = node_classes(df, id_col, text_col, threshold).where("label = v")
    none = F.lit(-(1 << 63))
    v, i = fresh_name(df, "v"), fresh_name(df, "id")
    keyed = df.withColumns({v: _digest(text_of(df, text_col)), i: F.coalesce(df[id_col].cast("long"), none)})
    chosen = found.select(F.col("digest").alias(v), F.coalesce(_id_of(F.col("v")), none).alias(i))
    out = keyed.join(chosen, [v, i], "left_semi")
    # Several rows of a class only where a row is repeated with its id.
    if not keyed.groupBy(v, i).count().where("count > 1").isEmpty():
        out = out.dropDuplicates([v, i])
    return out.select(*df.columns)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document among its near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
ORACLE_SQL: dict[str, str] = {}
