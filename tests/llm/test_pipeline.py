"""The pipeline's stages against brute-force versions, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from corpusloom.llm import quality
from tests.llm.test_near_dups import brute as brute_classes
from tests.llm.test_packing import check_packing
from tests.llm.test_spans import PII_KINDS
from tests.llm.test_spans import brute as brute_spans

DATA = "/root/testdata/sf0.001"


def brute_kept(texts, span=400):
    """Texts without the strings that start twice; a character that was cut through goes."""
    data = [t.encode() for t in texts]
    times = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if times[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append(bytes(x for x, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def redacted(text):
    """The literal patterns' spans, replaced by their kinds; of overlapping ones the first."""
    at, parts = 0, []
    for kind, a, b in brute_spans(PII_KINDS, text):
        if b > at:
            parts += [text[at:a], f"[{kind.upper()}]"] if a >= at else []
            at = b
    return "".join([*parts, text[at:]])


def test_stages_one_by_one(spark, tmp_path):
    assert [name for name, _ in cp.STAGES] == ["quality", "near_duplicates", "substrings", "pii", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = (before.collect(), docs.collect())

    before, after = kept["quality"]
    model = quality.fit_tables(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    import numpy as np

    good = [r.doc_id for r in before if model.score(np.float32(quality.features(r.text))[None])[0] >= 0.5]
    assert sorted(good) == sorted(r.doc_id for r in after) and len(good) < len(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in set(good) for i in clean) >= 0.97 * len(clean)

    before, after = kept["near_duplicates"]
    classes = brute_classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in classes})

    before, after = kept["substrings"]
    want = sorted(zip((r.doc_id for r in before), brute_kept([r.text for r in before])))
    assert sorted((r.doc_id, r.text) for r in after) == want
    assert [t for _, t in want] != [r.text for r in sorted(before)] and all(r.n_chars == len(r.text) for r in after)

    before, after = kept["pii"]
    want = {r.doc_id: redacted(r.text) for r in before}
    assert {r.doc_id: r.text for r in after} == want and any(t != r.text for r, t in zip(before, want.values()))
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = kept["packing"]
    n, tokens = check_packing(after, [(r.doc_id, r.text) for r in before], 4096)
    assert n <= 1.01 * tokens / 4096 + 1


@pytest.mark.parametrize("n", [0, 3])
def test_odd_tables(spark, tmp_path, n):
    rows = [(1, None, None, None, None, 1.0), (1, None, None, None, None, 1.0), (None, "", "en", "s", 0, None)][:n]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length double")
    columns = docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == columns
    assert docs.count() == min(n, 1)  # the texts are all empty, so one group


def test_run(spark):
    assert cp.run(spark, DATA).count() > 50
