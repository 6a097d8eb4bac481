import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import batched as B
from panelforge.operators import learning as M
from panelforge.operators import resampling as RS
from panelforge.operators.ordering import settled
from panelforge.plans import specs as X

SPEC = X.Spec("s", "y", (("b", 3), ("c", 2)), ("h", 4))


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(5)
    n = 240
    b, c, h = rng.normal(size=(n, 3)) * [1, 50, 0.1] + [3, 1e4, 0], rng.normal(size=(n, 2)), rng.normal(size=(n, 4))
    y = b @ [0.5, 0.01, 3.0] + h @ [0.6, 0, 0.2, 0] + rng.normal(size=n) * 0.3 + 1e3
    rows = [(i, b[i].tolist(), c[i].tolist(), h[i].tolist(), float(y[i]), float(y[i] ** 2), f"r{i % 3}", float(i % 7 * 20 - 60), float(i % 11 * 30 - 150), float(rng.lognormal())) for i in range(n)]
    kinds = "unit_id long, b array<double>, c array<double>, h array<double>, y double, y2 double, region string, lat double, lon double, bus double"
    return settled(spark.createDataFrame(rows, kinds).repartition(5))


def test_moments(spark):
    rows = [(i % 3 if i % 7 else None, f"k{i % 2}", [float(i), None, float(i * i % 11)] if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, s string, v array<double>").repartition(4)
    keys, mats = B.whole_matrices(B.grouped_moments(df, "v", 3, ["g", "s"]).toPandas(), ["g", "s"], 3)
    assert len(keys) == len({(g, s) for g, s, _ in rows})
    for (g, s), m in zip(keys.itertuples(index=False), mats, strict=True):
        z = np.array([[1.0, *([x or 0.0 for x in v] if v else [0.0] * 3)] for g_, s_, v in rows if s_ == s and (g_ == g or (g_ is None and pd.isna(g)))])
        assert np.allclose(m, z.T @ z)
    assert B.grouped_moments(df.limit(0), "v", 3, ["g"]).count() == 0
    # A task that may hold the sums of one group only gives the same.
    again = B.whole_matrices(B.grouped_moments(df, "v", 3, ["g", "s"], held_bytes=1).toPandas(), ["g", "s"], 3)
    named = lambda found: {str(list(k)): m.round(9).tolist() for k, m in zip(found[0].to_numpy().tolist(), found[1], strict=True)}
    assert named(again) == named((keys, mats))


def test_batches_equal_single_fits(spark, toy):
    own = X.size_strata(toy)
    got = X.null_battery(own, SPEC, 4, 3, ["stratum"]).toPandas().set_index(["null", "draw"])
    assert len(got) == 1 + 1 + 4 + 3 and set(got.n) == {240}
    based = settled(X.predictions(X.with_folds(own, SPEC), SPEC, False, "p0"))
    single = X.evaluate(based, SPEC, None, "p0").first()
    for c in ("r2_m0", "r2_m1", "delta_r2", "delta_rmse"):
        assert got.loc[("observed", 0), c] == pytest.approx(single[c], abs=1e-8)
    perm = settled(RS.shuffled(based, "h", 4, ["stratum"], out="_perm"))
    for d in (1, 4):
        one = X.evaluate(based.join(perm.where(F.col("draw") == d).select("unit_id", "_perm"), "unit_id"), SPEC, "_perm", "p0").first()
        assert got.loc[("shuffled", d), "delta_r2"] == pytest.approx(one["delta_r2"], abs=1e-8)
    for d in (1, 3):
        one = X.evaluate(RS.matched_random(based, "h", 4, seed=100 * d), SPEC, "x_random", "p0").first()
        assert got.loc[("random", d), "delta_r2"] == pytest.approx(one["delta_r2"], abs=1e-8)
    one = X.evaluate(X.pseudo_history(based, SPEC), SPEC, "pseudo", "p0").first()
    assert got.loc[("pseudo", 1), "delta_r2"] == pytest.approx(one["delta_r2"], abs=1e-8)


def test_null_summary(spark):
    rows = [("observed", 0, 0.5)] + [("shuffled", d, d / 10) for d in range(1, 10)] + [("pseudo", 1, 0.2)]
    got = {r["null"]: r for r in B.null_summary(spark.createDataFrame(rows, "null string, draw int, delta_r2 double"), "delta_r2").collect()}
    s = got["shuffled"]
    assert (s["n_draws"], s["observed"], s["null_mean"]) == (9, 0.5, pytest.approx(0.5)) and s["p_value"] == pytest.approx(6 / 10)
    assert s["percentile_of_observed"] == pytest.approx(400 / 9) and got["pseudo"]["null_sd"] is None


@pytest.mark.parametrize("block", [512, 37])
def test_transfer_batches_equal_single_searches(spark, toy, block):
    own = settled(M.block_scale(X.with_folds(toy, SPEC), dict(SPEC.blocks), "_base"))
    nulls = X.histories(own, SPEC, 2, 1, ["region"])
    got = B.transfer_errors(own, "_base", "y", nulls, 4, 10, block=block).toPandas().set_index(["null", "draw"])
    assert len(got) == 5 and set(got.n) == {240}
    single = M.metrics(X.transfer(own, SPEC), "y", "transferred").first()
    assert got.loc[("observed", 0), "rmse"] == pytest.approx(single["rmse"], abs=1e-9) and got.loc[("observed", 0), "mae"] == pytest.approx(single["mae"], abs=1e-9)
    perm = RS.shuffled(own, "h", 2, ["region"], out="_perm").where("draw = 2").select("unit_id", "_perm")
    one = M.metrics(X.transfer(own.join(perm, "unit_id"), X.replace(SPEC, history=("_perm", 4))), "y", "transferred").first()
    assert got.loc[("shuffled", 2), "rmse"] == pytest.approx(one["rmse"], abs=1e-9)


def test_nearest_of_other_folds_equal_brute_force():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 3, (700, 5)).astype(float)
    folds, ids = np.sort(rng.integers(0, 4, 700).astype(str)).astype(object), rng.permutation(700)
    for at in B._runs(folds, 50):
        r, s, d = B._nearest_others(b[at], b, 3, ids, folds, folds[at[0]], 4, width=16)
        far = ((b[at][:, None] - b[None]) ** 2).sum(axis=2)
        far[:, folds == folds[at[0]]] = np.inf
        want = [sorted(zip(row, ids))[:4] for row in far]
        assert [(x, ids[y]) for x, y in zip(d, s)] == [x for row in want for x in row] and r.tolist() == [i for i in range(len(at)) for _ in range(4)]


def test_transfer_ties_and_repeats(spark):
    rows = [(i, [float(i % 3)], [0.0], float(i), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "unit_id long, x array<double>, h array<double>, y double, fold int")
    nulls = df.select(F.lit("observed").alias("null"), F.lit(0).alias("draw"), "unit_id", "h")
    got = B.transfer_errors(df, "x", "y", nulls, 1, 2, block=7).first()
    errors = []
    for i, x, _, y, f in rows:
        near = sorted((abs(x[0] - r[1][0]), r[0]) for r in rows if r[4] != f)[:2]
        w = [1 / (d + 1e-9) for d, _ in near]
        errors.append(y - sum(a * j for a, (_, j) in zip(w, near)) / sum(w))
    assert got["n"] == 30 and got["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))))


def test_comparisons_equal_single_ones(spark, toy):
    blocks = {"b": ("b", 3), "c": ("c", 2), "h": ("h", 4), "g": ("g", 2)}
    df = settled(toy.withColumn("g", F.slice("h", 2, 2)))
    samples = {"all": F.lit(True), "north": F.col("lat") >= 0, "r1": F.col("region") == "r1", "few": F.col("unit_id") < 20, "none": F.lit(False)}
    specs = [
        B.Comparison("primary", "all", ("b", "c"), ("h",), "y"), B.Comparison("no context", "all", ("b",), ("h",), "y"), B.Comparison("part", "all", ("b", "c"), ("g",), "y"),
        B.Comparison("north", "north", ("b", "c"), ("h",), "y"), B.Comparison("r1 wide tiles", "r1", ("b",), ("h",), "y2", 20.0), B.Comparison("few", "few", ("b",), ("h",), "y"), B.Comparison("none", "none", ("b",), ("h",), "y"),
    ]
    got = B.compare_all(df, blocks, ["y", "y2"], samples, specs, boot=200).toPandas().set_index("label")
    assert len(got) == len(specs)
    for s in specs[:5]:
        own = df.where(samples[s.sample])
        spec = X.Spec(s.label, s.y, tuple(blocks[b] for b in s.base), blocks[s.history[0]], degrees=s.degrees)
        one = X.evaluate(X.with_folds(own, spec), spec, boot=200).first()
        assert got.loc[s.label, "n"] == one["n"]
        for c in ("r2_m0", "r2_m1", "delta_r2", "delta_rmse", "delta_r2_lo", "delta_r2_hi"):
            assert got.loc[s.label, c] == pytest.approx(one[c], abs=1e-6), (s.label, c)
    assert got.loc["few", "n"] == 20 and np.isnan(got.loc["few", "delta_r2"]) and got.loc["none", "n"] == 0


def test_groups_are_bounded(spark):
    df = spark.range(30).withColumn("g", F.col("id"))
    with pytest.raises(ValueError):
        M.balanced_group_folds(df, "g", most=20)
    with pytest.raises(ValueError):
        M.group_out_folds(df, "g", 1, 1, most=20)
    assert M.balanced_assignment([("a", 3), ("b", 9), ("c", 3), ("d", 1)], 2) == [1, 0, 1, 1]


def test_many_searches_equal_single_ones(spark, toy):
    from panelforge.operators import neighbours as N

    got = B.nearest_many(toy, {"b": (F.col("b"), 3), "south": (F.when(F.col("lat") < 0, F.col("h")), 5)}, block=50).toPandas()
    for name, df, x, k in (("b", toy, "b", 3), ("south", toy.where("lat < 0"), "h", 5)):
        want = N.knn(df, df, k, x).toPandas().sort_values(["i", "d", "j"])
        own = got[got.space == name].sort_values(["i", "d", "j"])
        assert own[["i", "j"]].to_numpy().tolist() == want[["i", "j"]].to_numpy().tolist() and np.allclose(own.d, want.d)


def test_separability_of_variants(spark, toy):
    own = settled(X.size_strata(toy))
    variants = [X.Variant("all", F.lit(True), (("b", 3), ("c", 2)), "h"), X.Variant("north", F.col("lat") >= 0, (("b", 3),), "h", 3), X.Variant("few", F.col("unit_id") < 9, (("b", 3),), "h"), X.Variant("robust", F.lit(True), (("b", 3),), "h", robust=True)]
    got = X.separability_variants(own, variants, 15).toPandas().set_index("variant")
    assert len(got) == 4 and got.loc["few", "n"] == 9 and np.isnan(got.loc["few", "mean_d_h"])
    from panelforge.operators import neighbours as N

    north = settled(own.where("lat >= 0"))
    x = M.block_scale(north, {"b": 3})
    pairs = N.pair_distances(N.knn(x, x, 3).select("i", "j", F.col("d").alias("d_sc")), x, {"d_h": "h"})
    assert got.loc["north", "n"] == north.count() and got.loc["north", "mean_d_h"] == pytest.approx(pairs.agg(F.avg("d_h")).first()[0])
    assert got.loc["north", "divergent_rate"] == pytest.approx(N.divergent_rate(pairs).first()["divergent_rate"])
    null = RS.permutation_pair_null(pairs, north, "h", 15, ["stratum"], least=1)
    assert got.loc["north", "null_mean"] == pytest.approx(null.agg(F.avg("stat")).first()[0]) and 0 <= got.loc["north", "p_lower"] <= 1


def test_spaces_searched_by_cells_equal_those_of_blocks(spark, toy):
    spaces = {"b": (F.col("b"), 3), "south": (F.when(F.col("lat") < 0, F.col("h")), 5)}
    few, many = (B.nearest_many(toy, spaces, together=n).orderBy("space", "i", "d", "j").toPandas() for n in (1 << 14, 0))
    assert few[["space", "i", "j"]].equals(many[["space", "i", "j"]]) and np.allclose(few["d"], many["d"])
