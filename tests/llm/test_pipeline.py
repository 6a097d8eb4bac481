"""The pipeline against a plain version of each stage."""

import re

import numpy as np
import pytest

import corpus_pipeline as C
from panelforge.llm import gam, queries, secretscan

from test_decontam import brute as contamination
from test_simhash import jaccard

sentencepiece = pytest.importorskip("sentencepiece")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data):
    """Input and output rows of each stage."""
    from panelforge.llm._base import store

    docs, out = queries.table(spark, data, "documents"), []
    for name, f in C.STAGES:
        new = store(f(spark, docs, data), "stage")
        out.append((name, docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == [n for n, _ in C.STAGES]
    assert len(stages) == 5
    for _, _, _, columns in stages[:-1]:
        assert columns == COLUMNS


def test_quality(spark, data, stages):
    _, before, after, _ = stages[0]
    model = gam.train(queries.table(spark, data, "documents"), queries.table(spark, data, "labels"))
    score = model.score(np.array([gam.features(r["text"].encode()) for r in before]))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, score, strict=True) if s >= 0.3)


def test_near_duplicates(stages):
    _, before, after, _ = stages[1]
    rows = sorted({r["doc_id"]: r["text"] for r in before}.items())
    up = {k: k for k, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if min(len(s), len(t)) > 0.5 * max(len(s), len(t)) and jaccard(s, t) >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in after) == sorted(k for k in up if find(k) == k)


def test_decontamination(spark, data, stages):
    _, before, after, _ = stages[2]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, data, "benchmark").collect()]
    bad = {r[0] for r in contamination([(r["doc_id"], r["text"]) for r in before], items) if r[-1]}
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if r["doc_id"] not in bad)


def test_secrets(stages):
    _, before, after, _ = stages[3]
    old, new = {r["doc_id"]: r for r in before}, {r["doc_id"]: r for r in after}
    guesser = secretscan.Guesser(secretscan.vocabulary_words(queries.vocabulary()))
    assert old.keys() == new.keys()
    for k, r in new.items():
        assert r["text"].encode() == secretscan.redacted(old[k]["text"].encode(), guesser=guesser)
        assert r["n_chars"] == (old[k]["n_chars"] if r["text"] == old[k]["text"] else len(r["text"]))
        assert not re.search(r"AKIA[A-Z0-9]{14,}", r["text"])


def test_encoding(stages):
    _, before, after, _ = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    assert all(r["token_ids"] == library.encode(texts[r["doc_id"]]) and r["round_trip"] for r in after)


def test_run_gives_what_the_stages_give(spark, data, stages):
    got = sorted((r["doc_id"], r["n_tokens"]) for r in C.run(spark, data).collect())
    assert got == sorted((r["doc_id"], r["n_tokens"]) for r in stages[-1][2])


def test_odd_rows_pass(spark, data):
    """Nulls, empty texts, repeated rows and clashing columns pass every stage."""
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a plain sentence of words, as good as any other.", "en", "s", 5), (4, "x" * 100_000, "en", "s", 100_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in C.STAGES:
        assert f(spark, docs, data).count() <= 5
        assert f(spark, docs.limit(0), data).count() == 0
