import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pytest

from panelforge.llm import queries, variants


def near(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, shortest=6, least=5):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def plain_variants(counts, ratio=5):
    others = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            others[a].append(b)
            others[b].append(a)
    form = {}
    for w, own in others.items():
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(others[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def made(spark, rows, **settings):
    docs = spark.createDataFrame([(k, t, "x", 3) for k, t in rows], "doc_id long, text string, word string, n int")
    return sorted(tuple(r) for r in variants.spelling_variants(variants.word_counts(docs, **settings)).collect())


def test_documents(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op12_spelling_variants(spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(plain_counts(rows)) and any(r[1] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_few_letters(spark, seed):
    """Words of few letters: anagrams, runs of equal letters, chains of forms, and ties."""
    rng = random.Random(seed)
    words = list({"".join(rng.choice("abÀé") for _ in range(rng.choice([5, 6, 6, 7, 7, 8]))) for _ in range(150)})
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40))) + rng.choice(["", ".", " AAAAAA"])) for i in range(120)]
    weights = [6 ** rng.randrange(5) for _ in words]
    rows += [(1000, " ".join(rng.choices(words, weights, k=20_000)))]
    got = made(spark, rows)
    assert got == plain_variants(plain_counts(rows))


def test_chain_of_forms(spark):
    chain = ["qwerta", "qwerty", "qwertyu", "qwertzu", "qwertzuo"]
    got = {r[0]: r for r in made(spark, [(1, " ".join(" ".join([w] * 5 ** (k + 1)) for k, w in enumerate(chain)))], every=10**12)}
    assert [got[w][1] for w in chain] == [*chain[1:], None] and {r[2] for r in got.values()} == {"qwertzuo"}


def test_anagrams_alone_arent_near(spark):
    rows = [(1, "abcdef fedcba " * 5 + "abcdeg abcdefg gabcdef " * 30)]
    got = {r[0]: r for r in made(spark, rows, every=10**12)}
    assert got["fedcba"][4] == 0 and got["abcdef"][4] == 3 and got["abcdef"][1] == "abcdefg"
    assert got["gabcdef"][4] == 1


def test_edge_cases(spark):
    assert made(spark, []) == [] and made(spark, [(1, None), (None, ""), (2, "short 123 ×")]) == []
    rows = [(None, "nowhere " * 7), (3, "nowhere " * 2), (3, "nowhere " * 2), (4, "x" * 50_000 + " " + ("y" * 3000 + " ") * 5 + ("y" * 3001 + " ") * 30)]
    assert made(spark, rows) == plain_variants(plain_counts(rows))
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([("abcdef", 5)], "word string, n long"), ratio=1)


def test_values_follow_letters_only():
    words = ["abcdef", "fedcba", "ab", "aab"]
    who, kind, value, place, before, after = variants._places(words)
    whole = {words[w]: int(v) for w, k, v in zip(who, kind, value) if k == 2}
    assert whole["abcdef"] == whole["fedcba"] == sum(ord(c) ** 5 for c in "abcdef")
    assert sorted(place[(who == 3) & (kind == 0)]) == [0, 2] and sorted(place[(who == 3) & (kind == 1)]) == [1]
    rows = list(zip(value.tolist(), place.tolist(), before.tolist(), after.tolist()))
    assert rows[[i for i in range(len(rows)) if (who[i], kind[i], place[i]) == (3, 0, 0)][0]] == rows[[i for i in range(len(rows)) if (who[i], kind[i], place[i]) == (2, 2, 0)][0]]
