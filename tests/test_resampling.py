import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import resampling as R


def test_shuffles_stay_within_strata(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(20)], "unit_id long, v double, s string")
    rows = R.shuffled(df, "v", 3, ["s"]).collect()
    assert len(rows) == 60
    for d in (1, 2, 3):
        own = sorted((r["unit_id"], r["value_perm"]) for r in rows if r["draw"] == d)
        assert sorted(v for _, v in own) == [float(i) for i in range(20)]
        assert all(u % 2 == v % 2 for u, v in own)
        assert any(u != v for u, v in own)
    again = R.shuffled(df.repartition(7), "v", 3, ["s"]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_small_strata_stay(spark):
    df = spark.createDataFrame([(i, float(i), "a" if i < 4 else None) for i in range(12)], "unit_id long, v double, s string")
    rows = {r["unit_id"]: r["value_perm"] for r in R.shuffled(df, "v", 1, ["s"], least=5).collect()}
    assert all(rows[i] == i for i in range(4))
    assert sorted(rows[i] for i in range(4, 12)) == [float(i) for i in range(4, 12)]


def test_p_values(spark):
    null = spark.createDataFrame([(float(i),) for i in range(10)], "stat double")
    assert R.permutation_summary(null, 2.0).first()["p_value"] == pytest.approx(0.3)
    assert R.permutation_summary(null, 2.0, plus_one=True).first()["p_value"] == pytest.approx(4 / 11)
    assert R.permutation_summary(null, 2.0, plus_one=True, lower=False).first()["p_value"] == pytest.approx(9 / 11)


def test_bootstrap_brackets_the_difference(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=1500)
    df = spark.createDataFrame([(int(i % 40), float(v), float(v + rng.normal() * 1.0), float(v + rng.normal() * 0.5)) for i, v in enumerate(y)], "tile long, y double, p0 double, p1 double")
    r = R.tile_bootstrap_delta(df, "y", "p0", "p1", 200).first()
    e0, e1 = (np.array([row["y"] - row[p] for row in df.collect()]) for p in ("p0", "p1"))
    observed = ((e0**2).sum() - (e1**2).sum()) / ((y - y.mean()) ** 2).sum()
    assert 0 < r["delta_r2_lo"] < observed < r["delta_r2_hi"]


def test_tiles_are_drawn_with_replacement(spark):
    times = R.tile_counts(spark.createDataFrame([(t,) for t in range(25)], "tile long"), 50)
    per = times.groupBy("draw").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    assert len(per) == 50
    assert all(r["n"] == 25 for r in per)
    assert 10 < np.mean([r["k"] for r in per]) < 22


def test_partial_rank_correlation_removes_a_confounder(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=2000)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(z + rng.normal(size=2000) * 0.4, z + rng.normal(size=2000) * 0.4, z, strict=True)], "a double, b double, z double")
    assert R.partial_spearman(df, "a", "b", []) > 0.8
    assert abs(R.partial_spearman(df, "a", "b", ["z"])) < 0.15


def test_morans_i_finds_a_gradient(spark):
    df = spark.createDataFrame([(i, float(i % 10 * 5), float(i // 10 * 5), float(i % 10)) for i in range(100)], "unit_id long, lat double, lon double, v double")
    r = R.morans_i(df, "v", 4, 49).first()
    assert r["morans_i"] > 0.5
    assert r["p_value"] == pytest.approx(1 / 50)


def test_matched_random_moments(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 2)) @ np.array([[1.0, 0.8], [0.0, 0.6]]) + [3, -1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "unit_id long, x array<double>")
    got = np.array([r["x_random"] for r in R.matched_random(df, "x", 2).collect()])
    assert np.allclose(got.mean(0), x.mean(0), atol=0.1)
    assert np.allclose(np.cov(got.T), np.cov(x.T), atol=0.15)


def test_pair_bootstrap_leaves_out_small_draws(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0)], "i long, j long, d double")
    tiles = spark.createDataFrame([(1, 10), (2, 11)], "unit_id long, tile long")
    assert R.pair_bootstrap(pairs, tiles, lambda w: F.sum(F.col("d") * w), 20).count() == 0


def test_bootstrap_of_means_equals_that_over_pairs(spark):
    rng = np.random.default_rng(6)
    pairs = spark.createDataFrame([(int(a), int(b), float(v) if v > -1.5 else None) for a, b, v in zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.normal(size=300))], "i long, j long, d double")
    tiles = spark.createDataFrame([(u, u % 9 * 1000) for u in range(40)], "unit_id long, tile long")
    mean = lambda w: F.sum(F.col("d") * w) / F.sum(F.when(F.col("d").isNotNull(), w))
    want = {r["draw"]: r["stat"] for r in R.pair_bootstrap(pairs, tiles, mean, 30).collect()}
    got = {r["draw"]: r["stat"] for r in R.pair_bootstrap_mean(pairs, tiles, "d", 30, chunk=7).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)
    assert R.pair_bootstrap_mean(pairs.limit(1), tiles, "d", 5).count() == 0


def test_draws_of_tasks_equal_draws_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    units = spark.createDataFrame([(i * 7, rng.normal(size=3).tolist(), float(rng.normal()), float(i % 50), float(i // 2), None if i % 5 == 0 else "ab"[i < 3]) for i in range(120)], "unit_id long, h array<double>, v double, lat double, lon double, s string")
    # Ends that aren't units count for nothing; strata of fewer rows stay.
    pairs = spark.createDataFrame([(int(a) * 7, int(b) * 7) for a, b in rng.integers(0, 130, (300, 2))], "i long, j long")
    for strata, least in (([], 1), (["s"], 5)):
        a, b = (R.permutation_pair_null(pairs, units, "h", 9, strata, least, task_bytes=n).orderBy("draw").toPandas() for n in (1 << 27, 0))
        assert np.array_equal(a["draw"], b["draw"]) and np.allclose(a["stat"], b["stat"])
    a, b = (R.morans_i(units, "v", 4, 19, task_bytes=n).first() for n in (1 << 27, 0))
    assert np.allclose(a, b)
    odd = units.withColumn("h", F.when(F.col("unit_id") % 2 == 0, F.array(F.lit(None).cast("double"))).otherwise(F.col("h")))
    assert R.drawn_by_tasks(odd, pairs, "h", 3, R._mean_distance) is None
    # Rows of draws aren't made.
    monkeypatch.setattr(R, "shuffled", None)
    assert R.permutation_pair_null(pairs, units, "h", 5).count() == 5
