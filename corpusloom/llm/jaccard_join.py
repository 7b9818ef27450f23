"""Join of similar texts on the Jaccard measure of their word n-grams, by PartEnum signatures.

A text's set is that of its distinct ``GRAM``-word shingles (A-Z lower-cased; a
text of fewer words is one shingle).  Two texts link when 100 * intersection >=
``PERCENT`` * union, and a component is what links reach.

Signatures.  Sizes are cut in bands.  Two sets that link lie in one band or in
two that follow each other, and differ in at most k elements, where k follows
from the upper end of the band.  For each band the domain of shingles is dealt by
hash over n1 parts of n2 smaller ones, with n1 * (k2 + 1) > k: in some part the
sets differ in at most k2 elements, so they agree on some n2 - k2 of its smaller
parts.  A signature is a part, a choice of n2 - k2 smaller parts, and what the set
has there; sets that link share one.  A set is signed for its band, and for the
next one where a set there can be similar enough.

Plan.  Equal sets are one node, found by a digest, so copies cost one row.
Signatures are shuffled once, as pairs of longs, and sorted; a streaming pass
keeps the runs of equal signatures, equal runs of a task once.  The first node of
each run is paired with the others (a star), pairs are verified, and components
are found.  Runs that then still hold several components are tried again with
their most frequent node as the centre.  In what is left, every pair across
components is tried: in runs of up to ``BLOCK`` nodes directly, in larger ones
only where two nodes also share one of the rarest shingles of each (an exact
prefix filter), and could still be similar when shingles of one node alone are
left out.  Nothing is capped: a large group is dealt over blocks, each two of
which meet.

Pairs are first held to sketches, parities of the sets' hashes over about two
bits for each shingle: sets differ in at least as many elements as their
sketches in bits, so most pairs fall without their texts.  Verification then
counts whole words, not hashes.  Equality of sets and the number of
shingles rely on 64-bit hashes of shingles.

Defined cases: a null text or one without words has the empty set, which links
with nothing, so its component is its own id; texts of any length are read
whole; texts that differ only in case A-Z, white space or the order and number
of equal shingles are one node; repeated rows are copies; a null id is never a
component's least id unless all are null; an empty table gives no rows; further
columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import give_back, table, text_of
from corpusloom.llm.hashing import mixed
from corpusloom.llm.near_dups import _groups as runs_of
from corpusloom.llm.near_dups import gram_hashes
from corpusloom.operators.components import connected_components
from corpusloom.sources.session import materialise, ship_package

GRAM = 4
PERCENT = 85
#: Differences allowed inside a part, and smaller parts that a part has.
INSIDE = 1
SMALLER = 3
BLOCK = 1024
#: Rows of a few numbers, at most about 100 bytes each in memory, that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Hashes of words that a task remembers.
REMEMBERED = 200_000


def words_of(raw: bytes) -> list[bytes]:
    """Words between blanks and the controls 9 to 13, A-Z lower-cased."""
    return raw.lower().split()


class Shingles:
    """Sets of shingle hashes, sorted; words seen before keep their hash at hand."""

    def __init__(self, gram: int = GRAM) -> None:
        self.gram, self.known = gram, {}

    def __call__(self, raw: bytes) -> np.ndarray:
        words = words_of(raw)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        return np.unique(gram_hashes(hashes, self.gram))


class Bands:
    """Bands of set sizes, and how many elements two sets of a band or the one below may differ in."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        self.first, self.last = [1], [1]

    def _grow(self, size: int) -> None:
        while self.last[-1] < size:
            low = self.last[-1] + 1
            self.first.append(low)
            # Two bands on, sets are larger by more than a similar one can be.
            self.last.append(max(low, low * 10_000 // self.percent**2))

    def of(self, size: int) -> list[int]:
        """The bands that a set of this size is signed for."""
        self._grow(size)
        own = int(np.searchsorted(self.last, size))
        self._grow(self.last[own] + 1)
        reaches = 100 * size >= self.percent * self.first[own + 1]
        return [own, own + 1] if reaches else [own]

    def differ(self, band: int) -> int:
        """Most elements that are in only one of two similar sets of at most the band's sizes."""
        return 2 * self.last[band] * (100 - self.percent) // (100 + self.percent)


def signatures(grams: np.ndarray, bands: Bands, inside: int = INSIDE, smaller: int = SMALLER) -> np.ndarray:
    """The signatures of a set, as hashes."""
    out = []
    for band in bands.of(len(grams)):
        k = bands.differ(band)
        k2 = min(inside, k)
        n1, n2 = -(-(k + 1) // (k2 + 1)), smaller if k2 else 1
        salt = mixed(np.array([band + 1], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        place = (mixed(grams ^ salt) % np.uint64(n1 * n2)).astype(np.int64)
        value = mixed(grams + salt)
        sums = np.zeros(n1 * n2, dtype=np.uint64)
        np.add.at(sums, place, value)  # modulo 2**64
        sums = sums.reshape(n1, n2)
        whole = sums.sum(axis=1, dtype=np.uint64)
        part = np.arange(n1, dtype=np.uint64)
        for i, left_out in enumerate(combinations(range(n2), k2)):
            held = whole - sums[:, list(left_out)].sum(axis=1, dtype=np.uint64)
            out.append(mixed(held ^ mixed(salt + part * np.uint64(64) + np.uint64(i))))
    return np.concatenate(out)


def sketch(grams: np.ndarray) -> bytes:
    """Parities of a set's elements over at least two bits for each: sets differ in no fewer elements than sketches in bits."""
    bits = 1 << min(16, max(6, int(2 * len(grams) - 1).bit_length()))
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest's number of bits."""
    least = min(map(len, sketches))
    rows = []
    for x in sketches:
        row = np.frombuffer(x, dtype=np.uint8)
        while len(row) > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        rows.append(row)
    return np.stack(rows).view(np.uint64)


def may_differ(n: np.ndarray, percent: int) -> np.ndarray:
    """Most elements in only one of two similar sets that have ``n`` in all."""
    return n - 2 * -(-percent * n // (100 + percent))


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.sha256(grams.tobytes()).digest()


def _sized(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """(id, n, digest, sketch) of rows (id, text)."""
    shingles = Shingles(gram)
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(1)]
        columns = [[len(s) for s in sets], [_digest(s) for s in sets], [sketch(s) for s in sets]]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, kinds)]], names=["id", "n", "digest", "sketch"]
        )
    give_back()


def _signed(batches: Iterator[pa.RecordBatch], gram: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(sig, v) of rows (v, digest, text) whose set has the digest."""
    shingles, bands = Shingles(gram), Bands(percent)
    for batch in batches:
        found, nodes = [], []
        for v, digest, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            grams = shingles(text.as_py())
            if _digest(grams) == digest.as_py():
                own = signatures(grams, bands)
                found.append(own)
                nodes.append(np.full(len(own), v, dtype=np.int64))
        if found:
            columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes))]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "v"])
    give_back()


#: Runs of nodes that a task remembers, so that it tells each of them once.
RUNS = 1_000_000


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, v, first) of the rows, sorted by (sig, v), whose signature more than one node has; first is its first node.

    The key of a run that lies within a batch is a hash of its nodes, and such a
    run is told once: similar sets share many signatures.  Other runs have their
    signature as key.
    """
    sig = v = np.zeros(0, dtype=np.int64)  # the last row, not yet decided
    first_of = told = None  # the first node of the last row's run, and whether that row belongs to a run surely
    known = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        s = np.concatenate([sig, batch.column(0).to_numpy()])
        n = np.concatenate([v, batch.column(1).to_numpy()])
        same = s[1:] == s[:-1]
        fresh = np.concatenate([[True], ~(same & (n[1:] == n[:-1]))])  # a node twice in a run counts once
        s, n = s[fresh], n[fresh]
        starts = np.concatenate([[True], s[1:] != s[:-1]])
        run = np.cumsum(starts) - 1
        first = n[starts][run]
        if first_of is not None:
            first[run == 0] = first_of
        with_before = np.concatenate([[bool(told)], s[1:] == s[:-1]])
        with_next = np.concatenate([s[1:] == s[:-1], [False]])
        keep = with_before | with_next
        keep[-1] = False  # decided with the next batch
        key = s.copy()
        begins = np.flatnonzero(starts)
        hashes = mixed(np.add.reduceat(mixed(n.view(np.uint64)), begins))
        whole = np.arange(1, len(begins) - 1)  # the first and the last run may go on in other batches
        whole = whole[keep[begins[whole]]]
        _, one = np.unique(hashes[whole], return_index=True)
        one = whole[one]
        one = one[~np.isin(hashes[one], known)]
        known = np.concatenate([known, hashes[one]]) if len(known) < RUNS else hashes[one]
        again = np.zeros(len(begins), dtype=bool)
        again[whole] = True
        again[one] = False
        keep &= ~again[run]
        named = np.zeros(len(begins), dtype=bool)
        named[one] = True
        key[named[run]] = hashes[run].view(np.int64)[named[run]]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, n, first)], names=["key", "v", "first"])
        sig, v, first_of, told = s[-1:], n[-1:], first[-1], bool(with_before[-1])
    if told:
        columns = [pa.array(x) for x in (sig, v, np.array([first_of], dtype=np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "v", "first"])


def overlap(x: bytes, y: bytes, gram: int = GRAM) -> tuple[int, int]:
    """Sizes of the intersection and the union of two texts' shingle sets, by their words."""
    ids: dict[bytes, int] = {}
    sets = []
    for words in (words_of(x), words_of(y)):
        codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
        sets.append(codes)
    size = [min(gram, len(c)) for c in sets]
    if not size[0] or not size[1] or size[0] != size[1]:
        # Shingles of different numbers of words are never equal.
        lone = [len(_packed([c], s)[0]) if s else 0 for c, s in zip(sets, size)]
        return 0, sum(lone)
    a, b = _packed(sets, size[0])
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _packed(texts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Distinct runs of ``size`` numbers of each text, each run as one number that the texts agree on."""
    runs = list(texts)
    for j in range(1, size):
        wide = [(r[:-1], c[j:]) for r, c in zip(runs, texts)]
        base = np.uint64(max(int(c.max()) for c in texts) + 1)
        joined = np.concatenate([r * base + c for r, c in wide])  # below 2**64: runs and words are ranks below 2**32
        ranks = np.unique(joined, return_inverse=True)[1].astype(np.uint64).ravel()
        ends = np.cumsum([len(r) for r, _ in wide])[:-1]
        runs = np.split(ranks, ends)
    return [np.unique(r) for r in runs]


def _verify(batches: Iterator[pa.RecordBatch], gram: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (v1, v2, d1, d2, x, y) whose texts have the digests and link."""
    shingles = Shingles(gram)
    for batch in batches:
        good = []
        for d1, d2, x, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
            both, union = overlap(x, y, gram)
            linked = 100 * both >= percent * union
            good.append(linked and _digest(shingles(x)) == d1 and _digest(shingles(y)) == d2)
        mask = pa.array(good, type=pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:2]], names=["v1", "v2"])
    give_back()


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (v1, v2, n1, n2, k1, k2) that sizes and sketches don't exclude."""
    for batch in batches:
        n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        good = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
        most = may_differ(n1 + n2, percent)
        one, two = batch.column(4), batch.column(5)
        for i in np.flatnonzero(good).tolist():
            x, y = folded([one[i].as_py(), two[i].as_py()])
            good[i] = np.bitwise_count(x ^ y).sum() <= most[i]
        mask = pa.array(good)
        yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:2]], names=["v1", "v2"])


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of different components, of two blocks of a group or within one, that no bound excludes."""
    for group in runs_of(batches, ["key", "s1", "s2"]):
        n, s, v = (group[c].to_numpy() for c in ("n", "s", "v"))
        label, salt = group["label"].to_numpy(), group["salt"].to_numpy()
        bits = folded(group["sketch"].to_pylist())
        within = group["s1"][0].as_py() == group["s2"][0].as_py()
        left = salt == group["s1"][0].as_py()
        right = np.flatnonzero(left if within else ~left)
        for i in np.flatnonzero(left).tolist():
            js = right[right > i] if within else right
            most = np.minimum(s[js], s[i])  # no intersection is larger
            js = js[(label[js] != label[i]) & (100 * most >= percent * (n[js] + n[i] - most))]
            js = js[np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64) <= may_differ(n[js] + n[i], percent)]
            if len(js):
                pair = np.minimum(v[js], v[i]), np.maximum(v[js], v[i])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["v1", "v2"])
    give_back()


def _exploded(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """(v, h) for each shingle of rows (v, digest, text) whose set has the digest."""
    shingles = Shingles(gram)
    for batch in batches:
        for v, digest, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            grams = shingles(text.as_py())
            if _digest(grams) == digest.as_py():
                grams = grams.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), v, dtype=np.int64)), pa.array(grams)], names=["v", "h"])
    give_back()


def _small(df: DataFrame) -> DataFrame:
    """A written table of short rows, broadcast where it is small enough, so that texts need not move."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """The pairs (v1, v2) that link: first by size and sketch, what is left by the texts' words."""

    def sides(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        out = pairs
        for i in ("1", "2"):
            out = out.join(of.select(F.col("v").alias(f"v{i}"), *[F.col(c).alias(c + i) for c in columns]), f"v{i}")
        return out.select("v1", "v2", *[c + i for c in columns for i in ("1", "2")])

    near = sides(pairs, nodes, "n", "sketch").mapInArrow(lambda it: _near(it, percent), "v1 long, v2 long")
    near = materialise(near, "pairs")
    wanted = materialise(near.select(F.explode(F.array("v1", "v2")).alias("v")).distinct(), "wanted")
    some = texts.join(_small(wanted), "v", "left_semi")
    return materialise(sides(near, some, "digest", "text").mapInArrow(lambda it: _verify(it, gram, percent), "v1 long, v2 long"), "links")


def _across(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (v1, v2) of nodes of different components of a group (key, v, label, n, s, sketch) that can be similar.

    A group is dealt by hash over blocks of about ``block`` nodes, and each two
    blocks meet in one task.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    rows = members.join(sizes, "key").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("salts") - 1),
        lambda x: F.struct(F.least(x, F.col("salt")).alias("s1"), F.greatest(x, F.col("salt")).alias("s2")),
    )
    rows = rows.withColumn("met", F.explode(met)).select("key", "met.s1", "met.s2", "salt", "v", "label", "n", "s", "sketch")
    rows = rows.repartition("key", "s1", "s2").sortWithinPartitions("key", "s1", "s2")
    return rows.mapInArrow(lambda it: _possible(it, percent), "v1 long, v2 long").distinct()


def _rare(members: DataFrame, nodes: DataFrame, texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """Nodes of large runs by each of their rarest shingles: groups as ``_across`` takes them.

    Of n shingles a similar set has at least the percentage, so two similar sets
    share one of the first n - ceil(percent * n / 100) + 1 in any common order;
    here the rarest come first.  Shingles of one node alone can't be shared.
    """
    labels = members.select("v", "label").distinct()
    own = texts.join(labels, "v", "left_semi").select("v", "digest", "text")
    grams = materialise(own.mapInArrow(lambda it: _exploded(it, gram), "v long, h long").distinct(), "shingles")
    often = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    lists = grams.join(often, "h").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("g"))
    lists = lists.join(nodes.select("v", "n"), "v").withColumn("s", F.size("g").cast("long")).where(100 * F.col("s") >= percent * F.col("n"))
    first = (F.col("s") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    rare = lists.select("v", "s", F.explode(F.slice("g", F.lit(1), F.greatest(first, F.lit(0)))).alias("e"))
    rare = materialise(rare.select("v", "s", F.col("e.h").alias("key")).join(labels, "v"), "rare")
    split = rare.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return rare.join(split, "key").join(nodes.select("v", "n", "sketch"), "v")


def components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    ship_package(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("id"), text_of(df, text_col).cast("binary").alias("text"))
    docs = materialise(rows.mapInArrow(lambda it: _sized(it, gram), "id long, n long, digest binary, sketch binary"), "docs")
    nodes = docs.where("n > 0").groupBy("digest").agg(F.min("id").alias("rid"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")  # written, so numbers stay
    # The text of each node; where an id is repeated also other texts, which the digest tells apart.
    named = _small(nodes.select("rid", "digest", "v"))
    texts = rows.join(named, rows["id"].eqNullSafe(F.col("rid"))).select("v", "digest", "text")
    texts = materialise(texts, "texts")

    signed = texts.mapInArrow(lambda it: _signed(it, gram, percent), "sig long, v long")
    sorted_ = signed.repartition("sig").sortWithinPartitions("sig", "v")
    shared = materialise(sorted_.mapInArrow(_shared, "key long, v long, first long"), "shared")
    star = shared.where("v <> first").select(F.col("first").alias("v1"), F.col("v").alias("v2")).distinct()
    links = _linked(star, nodes, texts, gram, percent)
    labels = connected_components(links)

    def split_runs(rows: DataFrame) -> DataFrame:
        """(key, v, label, size) of the runs that hold several components."""
        told = rows.select("key", "v").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        split = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
        split = materialise(split.where("lo <> hi").select("key", "size"), "split")
        return materialise(told.join(split, "key"), "runs")

    runs = split_runs(shared)
    if not runs.isEmpty():
        fame = runs.groupBy("v").agg(F.count("*").alias("fame"))
        centre = runs.join(fame, "v").groupBy("key").agg(F.max(F.struct("fame", "v", "label")).alias("c"))
        centre = materialise(centre.select("key", F.col("c.v").alias("c"), F.col("c.label").alias("of")), "centres")
        pairs = runs.join(centre, "key").where("label <> of").select(F.least("c", "v").alias("v1"), F.greatest("c", "v").alias("v2"))
        links = links.union(_linked(pairs.distinct(), nodes, texts, gram, percent))
        labels = connected_components(links)
        runs = split_runs(runs)
        # Small runs: every pair.  Large runs: pairs that share a rare shingle.
        groups = runs.where(F.col("size") <= block).select("key", "v", "label").join(nodes.select("v", "n", "sketch"), "v")
        groups = groups.withColumn("s", F.col("n"))
        large = runs.where(F.col("size") > block)
        if not large.isEmpty():
            groups = groups.unionByName(_rare(large, nodes, texts, gram, percent))
        found = _linked(_across(groups, percent, block), nodes, texts, gram, percent)
        if not found.isEmpty():
            labels = connected_components(links.union(found))
    named = nodes.select("digest", "rid", "v").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    named = materialise(named, "named")
    least = named.groupBy("label").agg(F.min("rid").alias("component"))
    of = named.join(least, "label").select("digest", "component")
    out = docs.select("id", "n", "digest").join(of, "digest", "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every document, and its component by links of Jaccard 0.85 or more."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL = (
    "with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), "
    f"'{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents), "
    "s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')] else "
    "list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w), "
    "g as materialized (select doc_id, hash(s) as h, s, len(s) as n from s), "
    "r as materialized (select min(doc_id) as id, s, any_value(n) as n, h from g where n > 0 group by h, s), "
    "e as materialized (select id, n, unnest(s) as t from r), "
    "p as materialized (select a.id as a, b.id as b, count(*) as both, any_value(a.n) + any_value(b.n) as n from e a join e b using (t) "
    "where a.id < b.id group by a.id, b.id having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))), "
    "l as materialized (select a, b from p union all select b, a from p), "
    "c(a, b) as (select id, id from r union select c.a, l.b from c join l on c.b = l.a), "
    "m as (select a, min(b) as component_id from c group by a) "
    "select doc_id, g.n::bigint as n_shingles, case when g.n = 0 then doc_id else component_id end as component_id from g "
    "left join r on r.h = g.h and r.s = g.s left join m on m.a = r.id"
)

QUERIES = {"op12_jaccard_join": op12_jaccard_join}
ORACLE_SQL: dict[str, str] = {"op12_jaccard_join": _SQL}
