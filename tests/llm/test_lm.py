import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import lm


def brute(rows):
    tokens = {k: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return {k: (held[k], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for k, ws in tokens.items()}


def test_base_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = lm.score_texts(docs.repartition(5)).collect()
    assert len(rows) == len(want)
    for r in rows:
        h, n, k, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_model_prefers_held_out_text_to_its_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(0)
    held = [(r["doc_id"], r["text"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    mixed = []
    for k, t in held:
        w = t.split()
        rng.shuffle(w)
        mixed.append((k, " ".join(w)))
    train = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")
    total = lambda rows: sum(r["score"] for r in lm.score_texts(train.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).where("held_out").collect())
    assert total(held) > total(mixed)


@pytest.mark.parametrize("n", [1, 2000, 400_000])
def test_counts_are_read_back_by_levels(n):
    """N-grams of every count are kept, however many there are."""
    import pandas as pd

    keys = np.arange(n, dtype=np.int64) * 7
    counts = np.resize(np.array([1, 2, 3, 5, 9, 20, 50, 1000], np.int32), n)
    part = lm._slice_of(pd.DataFrame({"bucket": [0], "a": [lm._pack(np.diff(keys, prepend=0).astype(np.uint32))], "b": [lm._pack(counts)]}))
    assert np.unpackbits(part).mean() <= 0.35
    levels = lm._probed(part, keys)
    assert (levels >= np.searchsorted(lm.LEVELS, counts, side="right")).all()
    if n > 1:
        ratio = lm._MEAN[levels] / counts
        assert ((ratio > 0.6) & (ratio < 1.7)).mean() > 0.97
        assert (lm._probed(part, keys + 1) > 0).mean() < 0.02


def test_texts_longer_than_a_block(spark):
    rows = [(1, "a b " * 3_000_000), (2, "a b c"), (3, "b a")]
    want = brute(rows)
    for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        h, n, k, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_pairs_seen_once_count(spark):
    """Every word occurs twice and every pair once: the order of words decides, and nothing but pairs tells it."""
    held = next(k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0)
    other = next(k for k in range(held + 1, 400) if zlib.crc32(str(k).encode()) % 10 == 0)
    train = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 10][:2]
    a = [f"w{i}" for i in range(60)]
    b = a[::7] + [w for i, w in enumerate(a) if i % 7]
    rows = [(train[0], " ".join(a)), (train[1], " ".join(a[::-1])), (held, " ".join(a[10:40])), (other, " ".join(b[:1] + sorted(a[10:40], key=lambda w: zlib.crc32(w.encode()))[:29]))]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held] > got[other] + 0.5


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "A a A", 0), (4, "\t\n b\x0b", 0), (5, "w" * 100_000 + " é É", 0), (30, "zzz", 0), (7, "a  a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    want = brute([(k, t) for k, t, _ in rows])
    for r in lm.score_texts(docs).collect():
        h, n, k, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9)
    assert lm.score_texts(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    rows = lm.score_texts(docs).collect()
    assert len(rows) == 3
    assert sum(r["doc_id"] is None and r["held_out"] for r in rows) == 1
    assert {r["train_tokens"] for r in rows} == {6}


def test_without_training_texts(spark):
    keys = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    docs = spark.createDataFrame([(k, "a b") for k in keys], "doc_id long, text string")
    for r in lm.score_texts(docs).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
