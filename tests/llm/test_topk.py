import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k, is_query, scale=256):
    v = {}
    for i, e in rows:
        if e is not None and i is not None and all(x is not None and np.isfinite(x) for x in e):
            v[i] = [int(np.floor(scale * x)) for x in e]
    out = {}
    for q in v:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:k]
            out[q] = [(r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return out


def run(spark, rows, k=5, **settings):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    v = topk.quantised(df)
    out = {}
    for r in topk.top_k(v, v.where(F.col("id") % 50 == 0), k, **settings).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("dims", [1, 7, 64])
def test_equals_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    # Coarse values make ties; a few long vectors make bounds matter.
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dims), 1) * (5 if i % 37 == 0 else 1)]) for i in range(600)]
    want = brute(rows, 5, lambda i: i % 50 == 0)
    assert run(spark, rows) == want
    assert run(spark, rows, block_rows=3, group_rows=40) == want


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 1.0]), (None, [9.0, 9.0]), (50, [0.5, -0.5]), (6, [])]
    want = brute(rows, 5, lambda i: i % 50 == 0)
    assert run(spark, rows) == want
    assert {c for r in want.values() for _, c, _ in r} == {0, 5, 50, 6}


def test_ties_repeats_and_few_rows(spark):
    assert run(spark, [(0, [1.0]), (7, [1.0]), (3, [1.0])]) == {0: [(1, 3, 65536), (2, 7, 65536)]}
    assert run(spark, [(0, [1.0]), (0, [1.0]), (3, [1.0]), (3, [1.0])]) == {0: [(1, 3, 65536), (2, 3, 65536)]}
    assert run(spark, []) == {}


def test_huge_components_are_exact(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 1.0]), (2, [-1e12, 0.0]), (3, [2e3, 5.0])]
    got = run(spark, rows)[0]
    assert [c for _, c, _ in got] == [1, 3, 2]
    assert got[0][2] == 2**63 - 1 and got[2][2] == -(2**63)
    assert got[1][2] == 256 * 10**12 * 512_000 + 256 * 1280 if 256 * 10**12 * 512_000 < 2**63 else got[1][2] == 2**63 - 1


def test_bounds_prune(monkeypatch):
    """The search touches fewer dimensions than brute force on clustered data, with the same result."""
    rng = np.random.default_rng(0)
    table = np.floor(rng.normal(size=(64, 5000)) * 20 * (1 + 10 * (rng.random(5000) < 0.01)))
    q = table[:, :3].copy()
    ids = np.arange(5000)
    a, b, s = topk.search_block(ids[:3], q, ids, table, 5)
    full = q.T @ table
    for i in range(3):
        full[i, i] = -np.inf
        want = np.lexsort((ids, -full[i]))[:5]
        assert b[a == i].tolist() == want.tolist()
        assert s[a == i].tolist() == full[i, want].astype(int).tolist()


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2), (1, [2.0], 3, 4)], "vec_id long, embedding array<double>, id int, v int")
    v = topk.quantised(df)
    assert topk.top_k(v, v.where("id = 0")).collect()[0]["vec_id"] == 1
