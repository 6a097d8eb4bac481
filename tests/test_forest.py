import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import forest as T


def exhaustive(x, y, w, features, least):
    """The best cut by trying all of them."""
    best = None
    for f in sorted(features):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            if min(left.sum(), (~left).sum()) < least:
                continue
            error = lambda m: sum((w[m] * (y[m, o] - np.average(y[m, o], weights=w[m])) ** 2).sum() for o in range(y.shape[1]))
            everything = np.ones(len(x), bool)
            gain = error(everything) - error(left) - error(~left)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (a + b) / 2)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_cuts_equal_an_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        n, p = int(rng.integers(4, 40)), int(rng.integers(1, 5))
        x, y, w = rng.integers(0, 6, (n, p)).astype(float), rng.normal(size=(n, 2)), rng.integers(1, 4, n).astype(float)
        got, want = T.best_cut(x, y, w, np.arange(p), 2), exhaustive(x, y, w, range(p), 2)
        assert (got is None) == (want is None)
        if got:
            assert got[0] == pytest.approx(want[0]) and got[1:] == want[1:]


def test_trees_have_no_limit_of_depth_and_keep_leaves():
    rng = np.random.default_rng(0)
    x = np.sort(rng.exponential(size=(400, 1)) ** 4, axis=0)
    y = np.arange(400.0)[:, None] ** 3
    p = T.grown(x, y, np.ones(400), np.uint64(1), 0, 0, 7, 5, 1)
    values, counts = np.unique(p[:, 0], return_counts=True)
    assert counts.min() >= 5 and len(values) > 40
    one = T.grown(x, y, np.ones(400), np.uint64(1), 0, 0, 7, 5, 1, deepest=3)
    assert len(np.unique(one)) <= 8
    w = np.r_[np.ones(200), np.zeros(200)]
    assert np.allclose(T.grown(x, y, w, np.uint64(1), 0, 0, 7, 5, 1)[:200], T.grown(x[:200], y[:200], w[:200], np.uint64(1), 0, 0, 7, 5, 1))


def test_bootstrap_copies_follow_their_law():
    n = T.copies(np.arange(20_000, dtype=np.int64), 1, 3, 7)
    assert abs(n.mean() - 1) < 0.03 and abs((n == 0).mean() - np.exp(-1)) < 0.01 and abs((n == 2).mean() - np.exp(-1) / 2) < 0.01
    assert not np.array_equal(n, T.copies(np.arange(20_000, dtype=np.int64), 1, 4, 7))


def plain_forest(x, y, fold, keys, hashes, trees, least, look, seed):
    out = np.zeros(y.shape)
    for model in np.unique(fold):
        for tree in range(trees):
            w = np.where(fold == model, 0.0, T.copies(hashes, int(model), tree, seed))
            out += np.where((fold == model)[:, None], T.grown(x, y, w, np.uint64(1), int(model), tree, seed, least, look), 0)
    return out / trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    n = 300
    x = rng.normal(size=(n, 4))
    y = np.column_stack([np.sin(2 * x[:, 0]) + (x[:, 1] > 0), x[:, 2] ** 2])
    rows = [(i, x[i].tolist(), float(y[i, 0]), float(y[i, 1]), i % 3) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "unit_id long, x array<double>, a double, b double, fold int").repartition(4)


def test_out_of_fold_forest(spark, data):
    x, y, df = data
    got = T.forest_oof(df, "x", 4, ["a", "b"], trees=12, together=5).orderBy("unit_id").toPandas()
    hashes = np.array([r[0] for r in df.orderBy("unit_id").select(F.xxhash64("unit_id")).collect()], np.int64)
    want = plain_forest(x, y, np.arange(300) % 3, np.arange(300), hashes, 12, 5, 2, 7)
    assert np.allclose(got[["pred_a", "pred_b"]].to_numpy(), want)
    assert 1 - ((got.pred_a - got.a) ** 2).sum() / ((got.a - got.a.mean()) ** 2).sum() > 0.5


def test_large_nodes_are_split_by_histograms(spark, data):
    x, y, df = data
    small = T.forest_oof(df, "x", 4, ["a", "b"], trees=6).toPandas()
    large = T.forest_oof(df, "x", 4, ["a", "b"], trees=6, local_rows=40, bins=400).toPandas()
    r2 = lambda d: 1 - ((d.pred_a - d.a) ** 2).sum() / ((d.a - d.a.mean()) ** 2).sum()
    assert len(large) == 300 and large.pred_b.notna().all() and abs(r2(small) - r2(large)) < 0.1
    # One level of cuts between values that bins tell apart: the same trees, up to where cuts lie between the values.
    assert np.corrcoef(small.sort_values("unit_id").pred_a, large.sort_values("unit_id").pred_a)[0, 1] > 0.97


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "unit_id long, x array<double>, a double, fold int")
    assert T.forest_oof(empty, "x", 1, ["a"], trees=2).count() == 0
    same = spark.createDataFrame([(i, [1.0], 3.0, i % 2) for i in range(30)], empty.schema)
    assert {r["pred_a"] for r in T.forest_oof(same, "x", 1, ["a"], trees=3).collect()} == {3.0}
    assert {round(r["pred_a"], 9) for r in T.forest_oof(same, "x", 1, ["a"], trees=3, local_rows=4).collect()} == {3.0}
    odd = spark.createDataFrame([(i, [None], 1.0, None if i == 0 else i % 2) for i in range(12)], empty.schema)
    assert [r["pred_a"] for r in T.forest_oof(odd, "x", 1, ["a"], trees=3).orderBy("unit_id").collect()] == [None] + [1.0] * 11


def test_cuts_of_several_nodes_equal_those_of_each():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, y, w = np.floor(rng.normal(size=(60, 3)) * 2), rng.normal(size=(60, 2)), rng.integers(1, 4, 60).astype(float)
        n = rng.integers(10, 40, 5)
        nodes = [np.sort(rng.permutation(60)[:k]) for k in n]
        at = np.stack([np.r_[v, np.full(n.max() - len(v), 60)] for v in nodes])
        features = np.sort(np.stack([rng.permutation(3)[:2] for _ in n]), axis=1)
        wide, weights = np.vstack([x, np.full(3, np.inf)]), np.append(w, 0.0)
        gain, feature, cut = T.best_cuts(wide, np.ascontiguousarray((weights[:, None] * np.vstack([y, np.zeros(2)])).T), weights, at, n, features, 5)
        for g, v in enumerate(nodes):
            want = T.best_cut(x[v], y[v], w[v], features[g], 5)
            assert (want is None) == (gain[g] == -np.inf)
            assert want is None or (gain[g] == pytest.approx(want[0]) and (feature[g], cut[g]) == want[1:])


def test_trees_of_tasks_equal_trees_of_rows_and_write_no_copies(spark, data, monkeypatch):
    _, _, df = data
    written, settled = [], T.settled
    monkeypatch.setattr(T, "settled", lambda d: (found := settled(d), written.append(found.count()))[0])
    few = T.forest_oof(df, "x", 4, ["a", "b"], trees=6, local_rows=40).orderBy("unit_id").toPandas()
    # Rows are written once, not for every tree and level.
    assert sum(written) == 300
    rows = T.forest_oof(df, "x", 4, ["a", "b"], trees=6, local_rows=40, task_bytes=0).orderBy("unit_id").toPandas()
    assert np.allclose(few[["pred_a", "pred_b"]], rows[["pred_a", "pred_b"]])


def test_tasks_find_the_quantiles_and_keep_short_floats(spark, data, monkeypatch):
    _, _, df = data
    short = df.withColumn("x", df["x"].cast("array<float>").cast("array<double>"))
    kinds, settled = [], T.settled
    monkeypatch.setattr(T, "settled", lambda d: kinds.append(dict(d.dtypes).get("_x")) or settled(d))
    # No pass over exploded values before the trees: the quantiles come from the packed rows.
    monkeypatch.setattr(T, "exact_quantiles", None)
    few = T.forest_oof(short, "x", 4, ["a", "b"], trees=6, local_rows=40).orderBy("unit_id").toPandas()
    assert kinds == ["array<float>"] and few[["pred_a", "pred_b"]].notna().all().all()
    monkeypatch.undo()
    many = T.forest_oof(short, "x", 4, ["a", "b"], trees=6, local_rows=40, task_bytes=40 * 48).orderBy("unit_id").toPandas()
    assert np.allclose(few[["pred_a", "pred_b"]], many[["pred_a", "pred_b"]])


def test_nodes_of_equal_outputs_are_leaves():
    rng = np.random.default_rng(8)
    x, w = np.vstack([rng.normal(size=(40, 2)), np.full(2, np.inf)]), np.append(rng.integers(1, 4, 40).astype(float), 0.0)
    y = np.vstack([np.full((40, 2), [0.1, 1e9 / 3]), np.zeros(2)])
    gain, _, _ = T.best_cuts(x, np.ascontiguousarray((w[:, None] * y).T), w, np.arange(40)[None], np.array([40]), np.array([[0, 1]]), 5, T.ranked(x))
    assert gain[0] == 0


def test_values_without_a_number_between_are_told_apart():
    x = np.where(np.arange(40) < 20, 0.3, np.nextafter(0.3, 1))[:, None]
    # The half rounds to one of the two; both orders of the last bit are tried.
    for own in (x, np.where(x == 0.3, np.nextafter(0.3, 1), np.nextafter(np.nextafter(0.3, 1), 1))):
        y = (np.arange(40) >= 20).astype(float)[:, None]
        _, _, cut = T.best_cut(own, y, np.ones(40), np.arange(1), 5)
        assert own.min() <= cut < own.max()
        assert np.array_equal(T.grown(own, y, np.ones(40), np.uint64(1), 0, 0, 7, 5, 1), y)
