import random
import re
from itertools import combinations

import numpy as np
import pytest

from panelforge.llm import jaccard, queries


def shingles(text, width=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain(rows, percent=80):
    """Classes by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, j in {p for own in holders.values() for p in combinations(own, 2)}:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def made(spark, rows, **settings):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, node int, digest string")
    return sorted((tuple(r) for r in jaccard.similar_texts(docs.repartition(5), **settings).collect()), key=str)


def edited(rng, words, share):
    return [rng.choice(["other", "words", "here"]) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def family(rng, n, size, share):
    source = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    return [" ".join(edited(rng, source, share)) for _ in range(n)]


def test_documents(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_ngram_jaccard(spark, data).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == plain(rows) and any(r[0] != r[2] for r in got)


@pytest.mark.parametrize("seed, frequent", [(0, None), (1, 2)])
def test_families_near_the_threshold(spark, seed, frequent):
    """Families whose members are just linked or just not, passages that many share, copies, repeated keys; tokens frequent in blocks or not."""
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(50))
    texts = [t for share in (0.005, 0.012, 0.02, 0.03) for t in family(rng, 25, rng.choice([60, 120, 200]), share)]
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(12))) for _ in range(80)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += rng.choices(texts, k=60)
    rng.shuffle(texts)
    rows = [(rng.randrange(250), t) for t in texts]
    assert made(spark, rows, frequent=frequent) == plain(rows)


def test_large_family_needs_no_all_pairs(spark):
    rng = random.Random(7)
    texts = family(rng, 600, 150, 0.01)
    rows = [(k, t) for k, t in enumerate(texts)]
    # Cells so small that the family is dealt out in stripes.
    assert made(spark, rows, cell_bytes=1 << 17) == plain(rows)


@pytest.mark.parametrize("percent", [50, 100])
def test_other_thresholds(spark, percent):
    rng = random.Random(percent)
    rows = list(enumerate(t for share in (0.01, 0.04, 0.08) for t in family(rng, 20, 80, share)))
    assert made(spark, rows, percent=percent) == plain(rows, percent)


def test_edge_cases(spark):
    assert made(spark, []) == []
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, ""), (None, "same few words"), (5, "Same  few\nwords"), (5, "same few words"), (6, "same few"), (None, "alone as can be seen"), (7, "É é"), (8, "é é")]
    long = " ".join(f"w{k}" for k in range(60_000))
    rows += [(13, long), (12, long + " more words at the end"), (19, long.replace("w1", "x1"))]
    assert made(spark, rows) == plain(rows)


def test_prefixes_meet_under_every_order():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        level = rng.integers(1, 200, n).astype(np.uint8)
        order = np.lexsort((common, level))
        gone = np.sort(rng.choice(n, int(rng.integers(0, n // 9 + 1)), replace=False))
        a, b = order, order[~np.isin(order, gone)]
        assert 100 * len(b) >= 80 * n
        heads = [jaccard.prefixes(common[x], level[x], len(x) - int(jaccard.needed(np.array(len(x)), 80)) + 1) for x in (a, b)]
        assert all(len(np.intersect1d(x, y)) for x, y in zip(*heads))


def test_pairs_are_checked_exactly():
    tokens = [np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(3, 10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)]
    levels = [np.full(len(t), 8, np.uint8) for t in tokens]
    u, v = np.array([0, 0, 0, 1]), np.array([1, 2, 3, 2])
    assert jaccard.linked(tokens, levels, np.array([10, 9, 7, 10]), u, v, 80).tolist() == [True, False, False, False]
    assert jaccard.linked(tokens, levels, np.array([10, 9, 7, 10]), u, v, 70).tolist() == [True, True, False, True]
