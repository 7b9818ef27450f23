"""Source divergence against brute force: tries, cut ranges, exact shares, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import divergence as dv


def brute(rows, least=dv.LEAST_DOCS, top=dv.TOP):
    """Rows of the audit of (text, lang, source), by dictionaries of Python integers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        size = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def share(n, whole):
            return 1 + 1_000_000_000 * (n + 1) // (whole + len(kept))

        p = {s: {t: share(counts[lang, s][t], size[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, i) for i, (v, t) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def leaves(trie):
    ends = np.concatenate([[0], np.cumsum(trie.width)]).tolist()
    return [
        (t, d, {trie.names[s]: n for s, n in zip(trie.source[a:b].tolist(), trie.count[a:b].tolist())})
        for t, d, a, b in zip(trie.terms, trie.docs.tolist(), ends, ends[1:])
    ]


def test_trie_holds_what_a_dictionary_does():
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))).encode() for _ in range(400)]
    words += [b"x" * n for n in (30, 31, 32, 33, 40, 40)]  # longer than what leaves share
    want, tries = {}, []
    for k in range(3):
        counts, docs = {}, Counter()
        for i, w in enumerate(words):
            if i % 3 == k:
                counts.setdefault(f"s{i % 4}", Counter())[w] += i + 1
                docs[w] += 1
                want.setdefault(w, [0, Counter()])[0] += 1
                want[w][1][f"s{i % 4}"] += i + 1
        tries.append(dv.RadixTrie.of_counts(counts, docs))
    trie = dv.RadixTrie.merged(tries)
    got = leaves(trie)
    assert [t for t, _, _ in got] == sorted(want)
    assert all(d == want[t][0] and c == dict(want[t][1]) for t, d, c in got)
    parts = [next(dv.rows_of(dv.pack("x", 0, p))) for p in trie.pieces(17)]
    assert [x for p in parts for x in leaves(dv.unpack(p))] == got
    sums = sum((Counter(dict(zip(p["names"], p["sums"].tolist()))) for p in parts), Counter())
    assert sums == sum((Counter(c) for _, _, c in got), Counter())
    assert leaves(trie.where(trie.docs >= 3)) == [x for x in got if x[1] >= 3]


def test_shares_are_exact_for_great_numbers():
    rng = random.Random(2)
    for _ in range(300):
        whole = rng.randrange(1, 10**15)
        n = rng.randrange(0, whole)
        assert int(dv.share(np.int64(n), np.int64(whole))) == 1 + 10**9 * (n + 1) // whole


def test_terms_of_texts_cut_in_slices(monkeypatch):
    monkeypatch.setattr(dv, "SLICE", 5)
    raw = "Ab,cdefghijklmnop é-ß  x".encode()
    assert [t for part in dv.term_lists(raw) for t in part] == [t.encode() for t in ("ab", "cdefghijklmnop", "é", "ß", "x")]
    assert list(dv.term_lists(b"")) == []


def corpus(n=260):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdéñ") for _ in range(rng.randrange(1, 5))) for _ in range(150)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de"]), f"s{min(int(rng.expovariate(0.5)), 6)}"
        rows.append((" ".join(rng.choice(vocab[: 150 if source < "s3" else 60]) for _ in range(rng.randrange(0, 40))), lang, source))
    rows += [(None, "en", "s1"), ("", None, None), ("One ONE one", None, "a"), ("one", None, None), ("oNe 1two", None, "b"), ("lonely", "xx", "only"),
             ("same same", "yy", "p"), ("other", "yy", "q"), ("a b", "en", "none kept 1"), ("!!!", "en", "silent"), rows[0], rows[0]]
    return rows


def test_audit_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(t, la, s, 1, "z") for t, la, s in rows], "text string, lang string, source string, rank int, item string")
    want = brute(rows)
    # Small pieces and ranges, so that pieces are cut and ranges merged.
    for some in (df.repartition(5), df.coalesce(1)):
        got = dv.audit(some, piece=7, size=20, held=50)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, dv.audit(df, top=3).collect())) == brute(rows, top=3)
    assert {r for r in want if r[0] == "yy"} == {("yy", "p", "pair", "q", 0, 1), ("yy", "q", "pair", "p", 0, 1)}
    assert dv.audit(df.limit(0)).count() == 0


def test_ranges_do_not_grow_with_the_number_of_tries(spark):
    """Tries that all begin and end alike, one piece each: cuts lie within them."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    rows = [("aaaaa zzzzz " + " ".join(rng.sample(vocab, 400)), "en", "s") for _ in range(48)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(48)
    size, every = 640, 10
    pieces = df.select(F.col("text").cast("binary"), "lang", "source").mapInArrow(lambda it: dv._count(it, 10_000, 10_000, every), dv.COUNTED_TYPE)
    pieces = pieces.persist()
    cuts = dv._cuts(pieces, size, 1000, every)
    ranged = pieces.drop("marks").mapInArrow(lambda it: dv._cut(it, cuts), dv.PIECE_TYPE)
    leaves = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    total = sum(leaves.values())
    assert total == pieces.agg(F.sum("n")).first()[0] > 15_000
    assert len(leaves) > 20 and max(leaves.values()) < 2 * size
    # No cut where all fits one range.
    assert dv._cuts(pieces, 10**6, 1000, every) == {}
    pieces.unpersist()


def test_pair_sums_by_blocks_of_sources():
    rng = np.random.default_rng(4)
    dense = rng.integers(0, 4, (30, 9)) * rng.integers(0, 2, (30, 9))
    term, source = np.nonzero(dense)
    whole = dense.sum(axis=0) + 30
    p = dv.share(dense, whole)
    zero = dv.share(np.zeros(9, dtype=np.int64), whole)
    want = np.array([[sum(dv.difference(p[:, a], p[:, b])) - 30 * dv.difference(zero[a], zero[b]) if a != b else 0 for b in range(9)] for a in range(9)])
    got = [dv.pair_sums(term, source, dense[term, source], whole, low, min(9, low + 4)) for low in (0, 4, 8)]
    assert (np.concatenate(got) == want).all()


def test_executors_hold_few_pieces_and_texts_at_once(spark, monkeypatch):
    """Row groups and reader batches were as large as a task's whole table of pieces, and 4096 texts."""
    import pyarrow.parquet as pq

    from corpusloom.sources import session

    monkeypatch.setattr(dv, "COUNTED", 8)
    monkeypatch.setattr(dv, "GROUP", 16)
    rng, batches = random.Random(8), []
    rows = [(" ".join(rng.choices([f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)], k=60)), "en", f"s{i % 3}") for i in range(90)]
    write = dv.materialise

    def told(df, tag, *a):
        out = write(df, tag, *a)
        batches.append((tag, int(spark.conf.get(session.READ_KEY)), [f.removeprefix("file://") for f in out.inputFiles()]))
        return out

    monkeypatch.setattr(dv, "materialise", told)
    before = spark.conf.get(session.READ_KEY)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(tuple(r) for r in dv.audit(df, piece=8, size=64).collect())
    assert got == brute(rows)
    assert {tag for tag, _, _ in batches} == {"tries", "groups", "langs", "merged", "scored"}
    assert all(n <= session.READ_ROWS for _, n, _ in batches) and spark.conf.get(session.READ_KEY) == before
    for _, _, files in (b for b in batches if b[0] in ("tries", "merged")):
        held = [pq.ParquetFile(f).metadata for f in files]
        sizes = [m.row_group(i).num_rows for m in held for i in range(m.num_row_groups)]
        assert sum(sizes) > 10 and max(sizes) <= 2
