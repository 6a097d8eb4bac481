import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import learning as M
from panelforge.plans import specs as X


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4))
    h = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5, 0.0] + h @ [0.7, 0.0, 0.0] + rng.normal(size=300) * 0.1
    return x, h, y


def frame(spark, toy, h=None, y=None):
    x, h0, y0 = toy
    h, y = h0 if h is None else h, y0 if y is None else y
    rows = [(i, [float(v) for v in x[i]], [float(v) for v in h[i]], float(y[i]), i % 5, f"r{i % 3}", float(i % 7 * 20 - 60), float(i % 11 * 30 - 150)) for i in range(len(x))]
    return spark.createDataFrame(rows, "unit_id long, b array<double>, h array<double>, y double, fold int, region string, lat double, lon double").repartition(4)


def numpy_ridge(x, y, xt, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + (xt - m) / s @ b


def by_id(df, c):
    return np.array([r[c] for r in df.orderBy("unit_id").select(c).collect()])


def test_ridge_oof_matches_numpy(spark, toy):
    x, _, y = toy
    got = by_id(M.ridge_oof(frame(spark, toy), "b", 4, ["y"]), "pred_y")
    fold = np.arange(300) % 5
    want = np.empty(300)
    for f in range(5):
        want[fold == f] = numpy_ridge(x[fold != f], y[fold != f], x[fold == f], 1.0)
    assert np.allclose(got, want)


def test_leave_one_out_error_picks_the_same_alpha(spark, toy):
    x, _, y = toy
    alpha, _, _ = M.ridge_loo_alpha(frame(spark, toy), "b", 4, "y")
    z = (x - x.mean(0)) / x.std(0)
    errors = []
    for a in M.ALPHAS:
        hat = z @ np.linalg.solve(z.T @ z + a * np.eye(4), z.T) + 1 / len(y)
        e = (y - y.mean()) - (hat - 1 / len(y)) @ (y - y.mean())
        errors.append(np.mean((e / (1 - np.diag(hat))) ** 2))
    assert alpha == M.ALPHAS[int(np.argmin(errors))]


def test_predictions_of_a_fold_ignore_its_own_outcomes(spark, toy):
    spoiled = toy[2].copy()
    spoiled[np.arange(300) % 5 == 2] += 1000
    a = by_id(M.ridge_oof(frame(spark, toy), "b", 4, ["y"]).where("fold = 2"), "pred_y")
    b = by_id(M.ridge_oof(frame(spark, toy, y=spoiled), "b", 4, ["y"]).where("fold = 2"), "pred_y")
    assert np.allclose(a, b)


def test_components_of_a_fold_come_from_the_others(spark, toy):
    spoiled = toy[1].copy()
    mine = np.arange(300) % 5 == 2
    spoiled[mine & (np.arange(300) != 2)] *= 50
    a = M.foldwise_components(frame(spark, toy), "h", 3, 2).where("unit_id = 2").first()["pc"]
    b = M.foldwise_components(frame(spark, toy, h=spoiled), "h", 3, 2).where("unit_id = 2").first()["pc"]
    assert np.allclose(a, b)


def test_components_match_numpy(spark, toy):
    h = toy[1]
    z = (h - h.mean(0)) / h.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T, bias=True))[::-1]
    pca = M.principal_components(frame(spark, toy), "h", 3, 3)
    assert np.allclose(pca["ratio"], values / values.sum())
    assert all(row[np.abs(row).argmax()] > 0 for row in pca["loadings"])


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(1, [2.0, 1.0]), (2, [2.0, 3.0])], "unit_id long, x array<double>")
    assert [r["x"] for r in M.zscore(df, "x", 2).orderBy("unit_id").collect()] == [[0.0, -1.0], [0.0, 1.0]]


def test_blocks_weigh_alike(spark, toy):
    x = np.array([r["x"] for r in M.block_scale(frame(spark, toy), {"b": 4, "h": 3}).collect()])
    assert (x[:, :4] ** 2).sum(1).mean() == pytest.approx(1.0)
    assert (x[:, 4:] ** 2).sum(1).mean() == pytest.approx(1.0)


def test_balanced_folds(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate("a" * 10 + "b" * 5 + "c")], "unit_id long, g string")
    rows = M.balanced_group_folds(df, "g", 3).collect()
    assert {(r["g"], r["fold"]) for r in rows} == {("a", 0), ("b", 1), ("c", 2)}
    assert len(rows) == 16


def test_random_folds_are_balanced_and_stable(spark):
    a, b = ({r["unit_id"]: r["fold"] for r in M.random_folds(x, "unit_id", 5).collect()} for x in (spark.range(53).withColumnRenamed("id", "unit_id"), spark.range(53).withColumnRenamed("id", "unit_id").repartition(9)))
    assert a == b
    sizes = [list(a.values()).count(f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 1


def test_group_out_needs_enough_rows(spark):
    df = spark.createDataFrame([(g,) for g in "a" * 60 + "b" * 6 + "c" * 2], "g string")
    assert M.group_out_folds(df, "g", 5, 50) == ["b"]


def test_two_definitions_of_fit(spark, toy):
    p = M.ridge_oof(frame(spark, toy), "b", 4, ["y"])
    y, q, fold = by_id(p, "y"), by_id(p, "pred_y"), np.arange(300) % 5
    pooled = 1 - ((y - q) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    per_fold = np.mean([1 - ((y - q)[fold == f] ** 2).sum() / ((y[fold == f] - y[fold != f].mean()) ** 2).sum() for f in range(5)])
    assert M.metrics(p, "y", "pred_y").first()["r2"] == pytest.approx(pooled)
    assert M.fold_mean_r2(p, "y", "pred_y").first()["r2_mean"] == pytest.approx(per_fold)


def test_history_adds_what_it_holds(spark, toy):
    spec = X.Spec("s", "y", (("b", 4),), ("h", 3))
    r = X.evaluate(X.with_folds(frame(spark, toy).drop("fold"), spec), spec, boot=50).first()
    assert r["delta_r2"] > 0.02 and r["delta_r2_lo"] > 0 and r["delta_rmse"] < 0


def test_transfer_donors_are_never_of_the_own_fold(spark, toy):
    spec = X.Spec("s", "y", (("b", 4),), ("h", 3))
    own = frame(spark, toy)
    base = by_id(X.transfer(own, spec).where("fold = 1"), "transferred")
    spoiled = toy[2].copy()
    spoiled[np.arange(300) % 5 == 1] = 1e6
    assert np.allclose(base, by_id(X.transfer(frame(spark, toy, y=spoiled), spec).where("fold = 1"), "transferred"))
    assert np.isfinite(base).all()


def test_support_holds_its_share(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(1000, 6)))], "unit_id long, x array<double>")
    share = M.mahalanobis(df, "x", 6).agg(F.avg(F.col("supported").cast("double"))).first()[0]
    assert 0.94 <= share <= 0.96


def test_forest_is_repeatable(spark, toy):
    a, b = (by_id(M.forest_oof(frame(spark, toy).coalesce(1), "b", "y", trees=5, depth=4), "pred_y") for _ in range(2))
    assert np.allclose(a, b)


def test_forest_is_the_same_on_other_layouts(spark, monkeypatch):
    """Trees are given to tasks, so what is shuffled doesn't follow partitions, nodes and bins as in Spark ML."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    rows = [(i, i % 3, [float(v) for v in r], float(3 * (r[0] > 0.2) + r[1]) if i else None) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "unit_id long, fold int, x array<double>, y double")
    plain = M.forest_oof(df.where("y IS NOT NULL"), "x", "y", trees=30, depth=6, task_bytes=0).select("y", "pred_y").toPandas()
    monkeypatch.setattr(M, "RandomForestRegressor", None)
    a, b = (M.forest_oof(d, "x", "y", trees=30, depth=6).orderBy("unit_id").toPandas() for d in (df.coalesce(1), df.repartition(7)))
    assert (a["pred_y"] - b["pred_y"]).abs().max() < 1e-12 and len(a) == 600 and a["pred_y"].notna().all()
    error = lambda d: ((d["y"] - d["pred_y"]) ** 2).mean()
    assert error(a) < 1.1 * error(plain) < 0.2 * a["y"].var()


def test_binned_tree_takes_the_best_cuts():
    """One tree on all rows and features equals a search over all cuts, node by node."""
    from panelforge.operators import forest as T

    rng = np.random.default_rng(6)
    bins, y, w = rng.integers(0, 8, size=(3, 120)).astype(np.uint8), rng.normal(size=120), rng.integers(1, 4, size=120).astype(float)

    def grown(at, level):
        best = None
        for f in range(3):
            for c in range(7):
                left, right = at[bins[f, at] <= c], at[bins[f, at] > c]
                if level < 3 and w[left].sum() >= 5 and w[right].sum() >= 5:
                    error = sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (left, right))
                    if best is None or error < best[0] - 1e-9:
                        best = (error, left, right)
        if best is None:
            return {int(i): np.average(y[at], weights=w[at]) for i in at}
        return grown(best[1], level + 1) | grown(best[2], level + 1)

    want = grown(np.arange(120), 0)
    got = T.binned_tree(bins, y, w, np.arange(120), 0, 0, 7, 5, 3, 3, 8)
    assert np.allclose(got, [want[i] for i in range(120)])


def test_mean_row_error(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0]), ([0.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert df.agg(M.mean_row_l2(F.col("a"), F.col("b"))).first()[0] == 3.0
