import random
import re

import numpy as np
import pytest
import xxhash

from panelforge.llm import queries, simhash as S


def mark(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(marks, radius=4):
    """Smallest reachable id by comparing all pairs."""
    ids = sorted(marks)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_documents(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    marks = {k: mark(t) for k, t in texts.items()}
    want = classes(marks)
    rows = queries.op9_near_duplicates(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["fingerprint"] == f"{marks[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two Words", "a b c d", "é É x\x0by z", "a " * 5000, "\x1f a b c\xa0d e f g"])
def test_fingerprints(text):
    assert S.fingerprint((text or "").encode()) == mark(text)


@pytest.mark.parametrize("two", [False, True])
def test_tiles_miss_no_link(two):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([[sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(6)] for _ in base], dtype=object)
    marks = np.unique(np.array([int(b) ^ int(f) for b, own in zip(base, flips, strict=True) for f in own], dtype=np.uint64))
    left, right = (marks[::2], marks[1::2]) if two else (marks, None)
    u, v = S.forest_of_links(left, right, 4)
    up = {int(m): int(m) for m in marks}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = {int(m): int(m) for m in marks}
    root = lambda x: x if want[x] == x else root(want[x])
    side = {int(m): i % 2 for i, m in enumerate(marks)}
    for i, a in enumerate(marks.tolist()):
        for b in marks[i + 1 :].tolist():
            if (a ^ b).bit_count() <= 4 and (not two or side[a] != side[b]):
                x, y = root(a), root(b)
                want[max(x, y)] = min(x, y)
    assert {m: find(m) for m in want} == {m: root(m) for m in want}
    assert len(u) < len(marks)


def test_groups_keep_every_pair_within_the_radius():
    """Any two cells whose bit counts differ by no more than the radius meet, in whatever groups they are."""
    rng = np.random.default_rng(2)
    cells = np.unique(rng.binomial(16, 0.5, size=(400, 4)) @ np.array([17**3, 17**2, 17, 1]))
    counts = rng.integers(1, 60, len(cells))
    counts[7] = 5000  # one hot cell
    first, parts, near = S.deal(cells, counts, 300, 4)
    assert parts[7] >= 16 and max(np.bincount(first, counts, len(near))[first[parts == 1]]) <= 300 + counts.max()
    at = np.stack([cells // 17**k % 17 for k in (3, 2, 1, 0)], axis=1)
    met = {(i, j) for i, own in enumerate(near) for j in own}
    for a in range(len(cells)):
        for b in range(a, len(cells)):
            if np.abs(at[a] - at[b]).sum() <= 4:
                for x in range(first[a], first[a] + parts[a]):
                    for y in range(first[b], first[b] + parts[b]):
                        assert (min(x, y), max(x, y)) in met
    assert len(met) < len(near) * (len(near) + 1) / 2
    assert S.deal(cells[:0], counts[:0], 300, 4)[2] == []


@pytest.mark.parametrize("group_rows", [1, 5, 40])
def test_small_groups_give_the_same_components(spark, group_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    marks = np.unique(np.concatenate([base ^ np.uint64(0), base ^ np.uint64(0b101), base ^ np.uint64(0b1111 << 40), np.arange(30, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(m.view(np.int64)),) for m in marks], "fp long")
    from panelforge.llm.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(S.near_links(df, 4, group_rows)).collect()}
    want = classes({int(m): int(m) for m in marks})
    groups = lambda of: sorted(sorted(k for k in of if of[k] == r) for r in set(of.values()))
    assert [g for g in groups({k & (2**64 - 1): v for k, v in got.items()}) if len(g) > 1] == [g for g in groups(want) if len(g) > 1]


def test_later_pairs_are_cut_down_to_nested_forests():
    """Cutting down along the way gives as many pairs, of the same levels and reach, as keeping all of them to the end."""
    rng = np.random.default_rng(4)
    n, close = 60, np.arange(60)
    chunks = [(int(rng.integers(0, 2)), rng.integers(0, n, 50), rng.integers(0, n, 50)) for _ in range(60)]
    found = []
    for most in (100, 10**9):
        later = S._Later(n, 2, 3)
        later.most = most
        for level, x, y in chunks:
            keep = x < y
            later.add(level, x[keep], y[keep], close)
        later.settle(close)
        found.append(later)
    sizes = [[sum(len(x) for x, _ in own) for own in later.kept] for later in found]
    assert sizes[0] == sizes[1] and sum(sizes[0]) <= 3 * (n - 1)
    for level in range(2):
        assert len({tuple(later.last[level].roots(np.arange(n)).tolist()) for later in found}) == 1


def test_a_template_cluster_stays_small():
    """3,000 fingerprints that are all candidates of each other: millions of pairs, none of them kept beyond a few forests."""
    rng = np.random.default_rng(5)
    bits = np.tile(rng.integers(0, 2, 512).astype(np.uint8), (3000, 1))
    for row in bits:
        row[rng.choice(512, 36, replace=False)] ^= 1
    marks = np.packbits(bits, axis=1).view("<u8")
    u, v = S.forest_of_pairs(marks, None, 21, (54, 78, 105))
    assert len(u) <= 4 * 3000
    forest = S._Forest(3000)
    forest.link(u, v)
    assert len(np.unique(forest.roots(np.arange(3000)))) == 1


def test_chains_and_signed_order(spark):
    """Chains of small steps join, also across the sign bit."""
    marks = [0, 0b1111, 0xFF, 2**63, 2**63 | 0b11, 2**40 - 1]
    df = spark.createDataFrame([(m - 2**64 if m >= 2**63 else m,) for m in marks], "fp long")
    from panelforge.llm.components import connected_components

    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in connected_components(S.near_links(df, 4)).collect()}
    assert len(set(got.values())) == 1 and set(got) == set(marks[:5])


def test_edge_cases(spark):
    rows = [(5, None, "a"), (3, "", "b"), (9, " ", "c"), (1, "some words that stand alone here", "d"), (1, "some words that stand alone here", "d"), (8, "x" * 300_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (3, 3), (5, 3), (8, 8), (9, 3)]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def jaccard(a, b, width=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def variants():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    out = []
    for g in range(30):
        base = [word() for _ in range(rng.randint(60, 200))]
        for k in range(4):
            w = list(base)
            for _ in range(k * (1 if g % 2 else 5)):
                w[rng.randrange(len(w))] = word()
            out.append((len(out), " ".join(w)))
    return out


def test_similar_documents_equal_brute_force(spark):
    rows = variants()
    ids = [i for i, _ in rows]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in ids}
    assert len(set(got.values())) < len(ids)


def family(n=400, length=120):
    """A source text and variants of it that are similar to the source and not to each other."""
    rng = random.Random(4)
    source = [f"w{i}" for i in range(length)]
    out = [(0, " ".join(source))]
    for k in range(1, n + 1):
        w = list(source)
        for at in rng.sample(range(5, length - 5, 6), 2):
            w[at] = f"x{k}_{at}"
        out.append((k, " ".join(w)))
    return out


def test_variants_of_one_source_are_one_group(spark):
    rows = family()
    assert all(jaccard(rows[0][1], t) >= 0.8 for _, t in rows)
    assert sum(jaccard(rows[k][1], rows[k + 1][1]) < 0.8 for k in range(1, 300)) > 200
    got = {r["doc_id"]: r["component_id"] for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(401), 0)


@pytest.mark.parametrize("two", [False, True])
def test_joining_pairs_equal_brute_force(two):
    texts = [t.encode() for _, t in family(60)] + [t.encode() for _, t in variants()]
    hashes = [np.unique(S._shingle_hashes(t, 5)) for t in texts]
    marks = np.frombuffer(b"".join(S.wide_fingerprint(h, 8) for h in hashes), "<u8").reshape(-1, 8)
    n = len(texts)
    sets = [np.unique((h >> np.uint64(32)).astype(np.uint32)) for h in hashes]
    left, right = (marks[: n // 2], marks[n // 2 :]) if two else (marks, None)
    u, v = S.joining_pairs(left, right, 64, 512, np.arange(n), sets, 0.8, at_once=300)
    got, want = S._Forest(n), S._Forest(n)
    got.link(u, v)
    for i in range(n):
        for j in range(i + 1, n):
            if jaccard(texts[i].decode(), texts[j].decode()) >= 0.8 and (not two or i < n // 2 <= j):
                want.link(np.array([i]), np.array([j]))
    assert (got.roots(np.arange(n)) == want.roots(np.arange(n))).all()
    assert len(u) < n


def test_representatives(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (2, "A b c d e f g", "y"), (3, "other words altogether in this one", "z"), (3, "other words altogether in this one", "z"), (None, "a b c d e f g", "n"), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = S.representatives(docs, S.similar_documents(docs))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4]
    assert S.representatives(docs.limit(0), S.similar_documents(docs.limit(0))).count() == 0
