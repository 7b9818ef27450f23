"""Quality rules: repetition and size rules, and n-gram perplexity bands.

Counting.  A text's symbols are its UTF-16 code units, so a 4-gram is a 64-bit
number, and Spark counts all 4-grams, for each language, over the whole corpus:
a map step counts within a task, then a partially aggregated ``groupBy`` adds up.

Model.  An interpolated modified Kneser-Ney model for each language, with three
discounts for each order and continuation counts below the highest, made of
grouped sums and joins of one order with the next.  Entries are kept by a 64-bit
key, a one-to-one mix of the n-gram within a language and order, in two arrays
sorted by key.  They grow with the corpus, so they are files of the shared folder,
written by the executors in ranges of keys; each executor fetches them to its
disk, maps them into memory and reads them by binary search.

Bands.  From the log-perplexities of all documents that pass the base rules,
each language gets a lower and an upper bound: the median and ``WIDTH`` times
its distances to the quartiles (mergeable sketches, no sort), so junk of less
than a quarter of a language does not widen its own band.  ``WIDTH`` was chosen
on the quality labels of sf0.1: of the documents that pass the base rules, it
rejects 82 of 301 of label 0 and 27 of 3302 of label 1.

Defined cases: null text has no words and fails the base rules; a null language
is a language of its own; where a language's documents are all alike the bands
still have the width ``LEAST_SPREAD`` times ``WIDTH``; repeated rows each get
their own result; an empty table gives no rows; texts of any length are counted and
scored whole, ``STEP`` symbols at a time; a perplexity on the edge of its band
is inside; further columns play no part, whatever their names.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, text_of
from corpusloom.llm.hashing import mixed
from corpusloom.sources.session import materialise, shared_dir, ship_package

ORDER = 4
#: Bits of a symbol in the query's model; the functions also take the small alphabet's 6.
BITS = 16
#: Entries of the model in one file, about.
SHARD = 1 << 22
#: Languages whose bands are broadcast at most; beyond, both sides are tables and the join can be split.
BROADCAST_LANGS = 100_000
WIDTH = 7.5
LEAST_SPREAD = 0.01
_SYMBOLS = "#*$%&|<>"
_OWN = ".,!?;:'\"-()|#*$%&<>_=@/+[]"
_BLANK = "\x20\t\n\x0b\x0c\r"
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Symbols that a numpy step works on at once.
STEP = 1_000_000


def _alphabet() -> np.ndarray:
    def symbol(c: int) -> int:
        ch = chr(c)
        if "a" <= ch <= "z":
            return c - 97
        if "A" <= ch <= "Z":
            return 26
        if ch.isdigit():
            return 27
        if ch == "\n":
            return 29
        if ch.isspace():
            return 28
        if ch in _OWN:
            return 30 + _OWN.index(ch)
        return 57 + c % 6 if ch.isalpha() else 63

    return np.array([symbol(c) for c in range(0x3000)], dtype=np.uint8)


_SYMBOL_OF = _alphabet()


def symbols(text: str, bits: int = 6) -> np.ndarray:
    """Symbols of a text, after three that stand for its start: UTF-16 code units, or of the small alphabet."""
    if bits == 16:
        return np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-16-le", "surrogatepass"), dtype="<u2")
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    out = np.empty(len(points) + ORDER - 1, dtype=np.uint8)
    out[: ORDER - 1] = 29
    low = points < 0x3000
    out[ORDER - 1 :] = np.where(low, _SYMBOL_OF[np.where(low, points, 0)], 57 + points % 6)
    return out


def grams(codes: np.ndarray, bits: int = 6) -> Iterator[np.ndarray]:
    """4-grams of symbols as numbers of four times ``bits`` bits, some at a time."""
    b = np.uint64(bits)
    for at in range(0, len(codes) - ORDER + 1, STEP):
        s = codes[at : at + STEP + ORDER - 1].astype(np.uint64)
        yield ((s[:-3] << b | s[1:-2]) << b | s[2:-1]) << b | s[3:]


def _batches(texts: list[str], size: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters in all."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _count_grams(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of (language, 4-gram) in a task."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add_up(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        return g, np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)

    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        model = np.asarray(batch.column(1))
        for a, b in _batches(texts):
            codes: dict[int, list[np.ndarray]] = {}
            for i in range(a, b):
                codes.setdefault(int(model[i]), []).extend(grams(symbols(texts[i], bits), bits))
            for m, found in codes.items():
                if not found:  # empty texts only
                    continue
                parts.setdefault(m, []).append(np.unique(np.concatenate(found), return_counts=True))
                if len(parts[m]) >= 16:
                    parts[m] = [add_up(parts[m])]
    for m, found in parts.items():
        g, c = add_up(found)
        for at in range(0, len(g), 100_000):
            x, n = g[at : at + 100_000], c[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), m, dtype=np.int64)), pa.array(x.view(np.int64)), pa.array(n)],
                names=["model", "gram", "n"],
            )


def count_grams(df: DataFrame, bits: int = 6) -> DataFrame:
    """(model, gram, n) of a table of (text, model)."""
    got = df.select("text", "model").mapInArrow(lambda it: _count_grams(it, bits), "model long, gram long, n long")
    return got.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def _kept_discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of each count, by the counts of counts one to four."""
    n = [0, *(int((counts == k).sum()) for k in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    d = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), k) if n[k] else k * 0.5 for k in (1, 2, 3)]
    return np.select([counts == 1, counts == 2], d[:2], d[2])


def _last(gram: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The last n symbols of n-grams."""
    return gram & np.uint64((1 << bits * n) - 1)


def kneser_ney(
    gram: np.ndarray, count: np.ndarray, bits: int = 6
) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Log-probabilities ("p", n) and log-weights of backing off ("b", n) of the n-grams and contexts seen."""
    gram = gram.astype(np.uint64)
    order = np.argsort(gram)
    levels = {ORDER: (gram[order], count[order].astype(float))}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: different symbols before
        g, c = np.unique(_last(levels[n + 1][0], n, bits), return_counts=True)
        levels[n] = g, c.astype(float)
    out: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    lower_g, lower_p = np.zeros(1, dtype=np.uint64), np.full(1, 1 / (1 << bits))
    for n in range(1, ORDER + 1):
        g, c = levels[n]
        off = _kept_discounts(c)
        context, at = np.unique(g >> np.uint64(bits), return_inverse=True)
        total, freed = np.bincount(at, c), np.bincount(at, off)
        back = freed / total
        suffix = _last(g, n - 1, bits)
        p = (c - off) / total[at] + back[at] * lower_p[np.searchsorted(lower_g, suffix)]
        out["p", n] = g, np.log(p)
        out["b", n - 1] = context, np.log(np.maximum(back, 1e-9))
        lower_g, lower_p = g, p
    return out


def slot(kind: str, n: int, model: int, gram: np.ndarray) -> np.ndarray:
    """64-bit key of an n-gram's entry; different for all n-grams of one kind, order and model."""
    part = 2 * n + (kind == "b")  # below 16
    salt = mixed(np.array([(int(model) * 16 + part) & ((1 << 64) - 1)], dtype=np.uint64))
    return mixed(np.asarray(gram).astype(np.uint64) ^ salt)


def _slots(kind: str, n: int) -> Callable[[Column, Column], Column]:
    """Column function (model, gram) -> key of the n-gram's entry."""

    def run(model: pa.Array, gram: pa.Array) -> pa.Array:
        part = np.uint64(2 * n + (kind == "b"))
        salt = mixed(model.to_numpy().view(np.uint64) * np.uint64(16) + part)
        return pa.array(mixed(gram.to_numpy().view(np.uint64) ^ salt).view(np.int64))

    return F.arrow_udf(run, "bigint")


def _discounts(level: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): discounts of counts one, two and more, by the counts of counts one to four."""
    n = level.groupBy("model").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)

    def kept(k: int) -> Column:
        own = k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1))
        bounded = F.least(F.greatest(own, F.lit(0.0)), F.lit(float(k)))
        return F.when(F.col(f"n{k}") > 0, bounded).otherwise(k * 0.5).alias(f"d{k}")

    return n.select("model", *[kept(k) for k in (1, 2, 3)])


def model_rows(counts: DataFrame) -> DataFrame:
    """(slot, value) of the model of a table (model, gram, n) of counted 4-grams.

    Continuation counts, totals and discounts are grouped sums, and each order
    joins the one below: no task holds a language.
    """

    def last(n: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1)) if n < ORDER else F.col("gram")

    levels = {ORDER: counts.select("model", "gram", F.col("n").alias("c"))}
    for n in range(ORDER - 1, 0, -1):  # different symbols before
        levels[n] = levels[n + 1].groupBy("model", last(n).alias("gram")).agg(F.count("*").alias("c"))
        levels[n] = materialise(levels[n], f"grams{n}")
    out, below = None, None
    for n in range(1, ORDER + 1):
        level = levels[n].withColumn("context", F.shiftrightunsigned("gram", BITS))
        many = [F.count_if(F.col("c") == 1).alias("a1"), F.count_if(F.col("c") == 2).alias("a2"), F.count_if(F.col("c") > 2).alias("a3")]
        contexts = level.groupBy("model", "context").agg(F.sum("c").alias("total"), *many)
        contexts = contexts.join(materialise(_discounts(level), "discounts"), "model")
        freed = F.col("a1") * F.col("d1") + F.col("a2") * F.col("d2") + F.col("a3") * F.col("d3")
        contexts = materialise(contexts.select("model", "context", "total", "d1", "d2", "d3", (freed / F.col("total")).alias("back")), "contexts")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = level.join(contexts, ["model", "context"]).withColumn("own", (F.col("c") - off) / F.col("total"))
        if below is None:
            p = p.withColumn("lower", F.lit(1 / (1 << BITS)))
        else:
            p = p.withColumn("short", last(n - 1)).join(below.select("model", F.col("gram").alias("short"), F.col("p").alias("lower")), ["model", "short"])
        below = materialise(p.select("model", "gram", (F.col("own") + F.col("back") * F.col("lower")).alias("p")), f"p{n}")
        rows = below.select(_slots("p", n)(F.col("model"), F.col("gram")).alias("slot"), F.ln("p").cast("float").alias("value"))
        back = contexts.select(
            _slots("b", n - 1)(F.col("model"), F.col("context")).alias("slot"), F.ln(F.greatest("back", F.lit(1e-9))).cast("float").alias("value")
        )
        rows = rows.union(back)
        out = rows if out is None else out.union(rows)
    return out


class HashModel:
    """The model as two arrays sorted by slot."""

    def __init__(self, slots: np.ndarray, values: np.ndarray, bits: int = 6) -> None:
        order = np.argsort(slots)
        self.slots = slots[order].astype(np.uint64)
        self.values = values[order].astype(np.float32)
        self.bits = bits

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of slots, and which of them are there."""
        if not len(self.slots):
            return np.zeros(len(wanted)), np.zeros(len(wanted), dtype=bool)
        order = np.argsort(wanted)  # near searches stay near in memory
        at = np.empty(len(wanted), dtype=np.int64)
        at[order] = np.searchsorted(self.slots, wanted[order])
        at = np.minimum(at, len(self.slots) - 1)
        return self.values[at].astype(float), self.slots[at] == wanted

    def log_p(self, gram: np.ndarray, model: int) -> np.ndarray:
        """Log-probability of each 4-gram's last symbol; unseen ones back off.  Equal 4-grams are looked up once."""
        gram = np.asarray(gram).astype(np.uint64)
        order = np.argsort(gram)
        ordered = gram[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(gram)]
        out = np.empty(len(gram))
        out[order] = self._log_p(ordered[head], model)[np.cumsum(head) - 1]
        return out

    def _log_p(self, gram: np.ndarray, model: int) -> np.ndarray:
        out, seen = self.find(slot("p", ORDER, model, gram))
        left = np.flatnonzero(~seen)
        weight = np.zeros(len(left))
        for n in range(ORDER - 1, 0, -1):
            if not len(left):
                break
            short = _last(gram[left], n + 1, self.bits)
            back, known = self.find(slot("b", n, model, short >> np.uint64(self.bits)))
            weight += np.where(known, back, 0)
            value, seen = self.find(slot("p", n, model, _last(short, n, self.bits)))
            out[left[seen]] = weight[seen] + value[seen]
            left, weight = left[~seen], weight[~seen]
        back, known = self.find(slot("b", 0, model, np.zeros(1, dtype=np.int64)))
        out[left] = weight + (back[0] if known[0] else 0) - np.log(1 << self.bits)
        return out

    def log_perplexity(self, text: str, model: int) -> float:
        """Mean negative log-probability of a text's symbols; 0 for an empty text."""
        codes = symbols(text, self.bits)
        total = sum(-self.log_p(g, model).sum() for g in grams(codes, self.bits))
        return float(total / max(1, len(codes) - ORDER + 1))


class FileModel(HashModel):
    """The model in Parquet files of the shared folder that executors fetch; laid out as two arrays when first read.

    The files hold (slot, value) in the order of slots.  A worker writes them as
    raw arrays beside where Spark put them, once for each executor, and maps these.
    """

    def __init__(self, files: list[str], tag: str, bits: int) -> None:
        self.files, self.tag, self.bits = files, tag, bits

    def _lay_out(self) -> None:
        root = SparkFiles.getRootDirectory()
        names = [os.path.join(root, f"{kind}-{self.tag}") for kind in ("slots", "values")]
        if not all(map(os.path.exists, names)):
            own = [f"{n}.{os.getpid()}" for n in names]
            with open(own[0], "wb") as slots, open(own[1], "wb") as values:
                for file in self.files:
                    for batch in pq.ParquetFile(SparkFiles.get(file)).iter_batches(1 << 18):
                        slots.write(batch.column(0).to_numpy().tobytes())
                        values.write(batch.column(1).to_numpy().tobytes())
            for mine, name in zip(own, names):
                os.replace(mine, name)
        for attr, name, kind in zip(("slots", "values"), names, (np.uint64, np.float32)):
            setattr(self, attr, np.memmap(name, dtype=kind, mode="r") if os.path.getsize(name) else np.zeros(0, dtype=kind))

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in ("slots", "values"):
            raise AttributeError(name)
        self._lay_out()
        return self.__dict__[name]

    def __getstate__(self) -> dict:
        return {"files": self.files, "tag": self.tag, "bits": self.bits}


def split_words(text: str) -> list[str]:
    """The words of a text."""
    if _OTHER_SPACE.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def repeated_words(words: list[str], width: int = 8) -> int:
    """Words that lie in windows found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        key ^= key >> np.uint64(29)
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    likely = np.flatnonzero(count[where] > 1)
    if not len(likely):
        return 0
    windows = [tuple(words[i : i + width]) for i in likely.tolist()]  # the exact check
    often = Counter(windows)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(likely.tolist(), windows):
        if often[w] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = split_words(text)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)] if "\n" in text else []
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


_STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,log_ppl:double>"


def statistics(text: Column, model: Column, lm: HashModel) -> Column:
    """Column of a text's base statistics and log-perplexity."""

    def run(texts: pa.Array, models: pa.Array) -> pa.Array:
        pairs = [(t or "", m) for t, m in zip(texts.to_pylist(), models.to_pylist())]
        base = np.array([base_rules(t) for t, _ in pairs], dtype=np.int64).reshape(-1, 5)
        ppl = np.empty(len(pairs))
        for a, b in _batches([t for t, _ in pairs]):
            by: dict[int, list[int]] = {}
            for i in range(a, b):
                by.setdefault(pairs[i][1], []).append(i)
            for m, rows in by.items():  # the short texts of a language are looked up together
                small = [i for i in rows if 0 < len(pairs[i][0]) < STEP]
                for i in rows:
                    if not 0 < len(pairs[i][0]) < STEP:
                        ppl[i] = lm.log_perplexity(pairs[i][0], m)
                if small:
                    found = [np.concatenate(list(grams(symbols(pairs[i][0], lm.bits), lm.bits))) for i in small]
                    sizes = np.array([len(x) for x in found])
                    p = lm.log_p(np.concatenate(found), m)
                    ppl[small] = -np.add.reduceat(p, np.cumsum(sizes) - sizes) / sizes
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"]
        return pa.StructArray.from_arrays([*map(pa.array, base.T.copy()), pa.array(ppl)], names=names)

    return F.arrow_udf(run, _STATS)(text, model)


def language_model(texts: DataFrame) -> FileModel:
    """The model of a table of (text, model), in files of the shared folder."""
    spark = texts.sparkSession
    ship_package(spark)
    rows = materialise(model_rows(materialise(count_grams(texts, BITS), "grams")), "ngrams")
    shards = max(1, rows.count() // SHARD)
    unsigned = F.col("slot").bitwiseXOR(F.lit(-(1 << 63)))  # sorts as the keys do
    tag = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/corpusloom/model-{tag}"
    rows.repartitionByRange(shards, unsigned).sortWithinPartitions(unsigned).write.parquet(path)
    files = sorted(spark.read.schema(rows.schema).parquet(path).inputFiles(), key=os.path.basename)
    for file in files:
        spark.sparkContext.addFile(file)  # executors that start later fetch it too
    return FileModel([os.path.basename(f) for f in files], tag, BITS)


def apply_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH
) -> DataFrame:
    """Base statistics, log-perplexity, its band and the verdict for each row."""
    lang = F.coalesce(df[lang_col].cast("string"), F.lit(""))
    texts = df.select(
        df[id_col].alias("id"),
        text_of(df, text_col).alias("text"),
        lang.alias("lang"),
        F.xxhash64(lang).alias("model"),
    )
    lm = language_model(texts)
    stats = texts.select("id", "lang", statistics(F.col("text"), F.col("model"), lm).alias("s")).select("id", "lang", "s.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = materialise(stats.withColumn("base_failed", failed), "rules")
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000)
    bands = scored.where(~F.col("base_failed")).groupBy("lang").agg(q.alias("q"))
    mid = F.col("q")[1]
    bands = bands.select(
        F.col("lang").alias("band_lang"),
        (mid - width * F.greatest(mid - F.col("q")[0], F.lit(LEAST_SPREAD))).alias("log_ppl_low"),
        (mid + width * F.greatest(F.col("q")[2] - mid, F.lit(LEAST_SPREAD))).alias("log_ppl_high"),
    )
    bands = materialise(bands, "bands")  # one small row for each language
    bands = F.broadcast(bands) if bands.count() <= BROADCAST_LANGS else bands
    inside = F.col("log_ppl").between(F.col("log_ppl_low"), F.col("log_ppl_high"))
    return scored.join(bands, scored["lang"] == bands["band_lang"], "left").select(
        F.col("id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        "log_ppl", "log_ppl_low", "log_ppl_high",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return apply_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL: dict[str, str] = {}
