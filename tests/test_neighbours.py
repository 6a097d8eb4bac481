import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import neighbours as N


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return rng.normal(size=(120, 5)), rng.uniform(-60, 60, 120), rng.uniform(-170, 170, 120)


def frame(spark, points):
    x, lat, lon = points
    return spark.createDataFrame([(i, [float(v) for v in x[i]], float(lat[i]), float(lon[i]), i % 3) for i in range(len(x))], "unit_id long, x array<double>, lat double, lon double, g int")


def brute(points, k, least_km=0.0):
    x, lat, lon = points
    la, lo = np.radians(lat), np.radians(lon)
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    d[(km < least_km) | np.eye(len(x), dtype=bool)] = np.inf
    return {i: [int(j) for j in np.argsort(d[i], kind="stable")[:k] if np.isfinite(d[i, j])] for i in range(len(x))}, km


def test_knn_matches_brute_force_for_any_blocks(spark, points):
    df = frame(spark, points)
    want, _ = brute(points, 5)
    for rows in (8192, 17):
        got = {}
        for r in N.knn(df, df, 5, block_rows=rows).orderBy("i", "rank").collect():
            got.setdefault(r["i"], []).append(r["j"])
        assert got == want


def test_pivots_bear_repeated_points_and_groups(spark):
    """A third of all points are one; blocks are far smaller than the table."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.zeros((60, 3)), rng.normal(size=(60, 3)), rng.normal(loc=9, size=(60, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], i % 4) for i in range(len(x))], "unit_id long, x array<double>, g int")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for settings, bad in (({}, np.eye(len(x), dtype=bool)), ({"other_group": "g"}, np.subtract.outer(np.arange(180) % 4, np.arange(180) % 4) == 0), ({"same_group": "g"}, (np.subtract.outer(np.arange(180) % 4, np.arange(180) % 4) != 0) | np.eye(180, dtype=bool))):
        left = np.where(bad, np.inf, d)
        want = {i: [int(j) for j in np.argsort(left[i], kind="stable")[:7] if np.isfinite(left[i, j])] for i in range(len(x))}
        got = {}
        for r in N.knn(df, df, 7, block_rows=16, **settings).orderBy("i", "rank").collect():
            got.setdefault(r["i"], []).append(r["j"])
        assert got == want


def test_mutual_pairs_are_far_apart_and_mutual(spark, points):
    df = frame(spark, points)
    want, km = brute(points, 10, 2000.0)
    pairs = {(r["i"], r["j"]) for r in N.mutual_pairs(N.knn(df, df, 10, least_km=2000.0)).collect()}
    assert pairs == {(i, j) for i in want for j in want[i] if i < j and i in want[j]}
    assert all(km[i, j] >= 2000 for i, j in pairs)


def test_duplicate_points_and_ties(spark):
    df = spark.createDataFrame([(i, [0.0]) for i in range(5)], "unit_id long, x array<double>")
    got = {r["i"]: r["j"] for r in N.knn(df, df, 1).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0}


def test_fewer_candidates_than_k(spark, points):
    df = frame(spark, points)
    near = N.knn(df.where("unit_id < 4"), df.where("unit_id < 4"), 10)
    assert near.count() == 12
    assert N.knn(df.limit(0), df, 3).count() == 0


def test_donors_come_from_other_groups(spark, points):
    df = frame(spark, points)
    g = {i: i % 3 for i in range(120)}
    assert all(g[r["i"]] != g[r["j"]] for r in N.knn(df, df, 7, other_group="g").collect())
    assert all(g[r["i"]] == g[r["j"]] for r in N.knn(df, df, 7, same_group="g").collect())


def test_idw_is_finite_on_a_hit(spark):
    near = spark.createDataFrame([(1, 2, 0.0), (1, 3, 1.0)], "i long, j long, d double")
    donors = spark.createDataFrame([(2, 5.0), (3, 100.0)], "unit_id long, y double")
    assert N.idw_predict(near, donors, "y").first()["prediction"] == pytest.approx(5.0, abs=1e-5)


def test_divergent_rate_with_fixed_cuts(spark):
    pairs = spark.createDataFrame([(0.1, 1.0), (0.2, 0.1), (0.9, 1.0)], "d_sc double, d_h double")
    r = N.divergent_rate(pairs, near_cut=0.5, far_cut=0.5).first()
    assert (r["n_near"], r["divergent_rate"]) == (2, 0.5)


def test_twin_candidates_have_summaries(spark):
    pairs = spark.createDataFrame([(1, 2, 0.1, 0.5), (1, 3, 0.1, 0.9), (2, 3, 5.0, 9.0)], "i long, j long, d_sc double, d_h double")
    a = spark.createDataFrame([(i, f"s{i}") for i in (1, 2, 3)], "unit_id long, summary string")
    top = N.twin_candidates(pairs, a, 1).collect()
    assert [(r["i"], r["j"], r["summary_j"]) for r in top] == [(1, 3, "s3")]


def test_pair_distances(spark):
    a = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "unit_id long, v array<double>")
    p = spark.createDataFrame([(1, 2)], "i long, j long")
    assert N.pair_distances(p, a, {"d": "v"}).select(F.col("d")).first()["d"] == 5.0


def test_cells_hold_their_rows_beside_vectors_without_numbers(spark):
    """A vector that can't be compared takes no part, and its cell keeps all others."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    x[[5, 40]] = np.nan
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "unit_id long, x array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    d[np.eye(len(x), dtype=bool) | np.isnan(d)] = np.inf
    got = {}
    for r in N.knn(df, df, 4, block_rows=24).orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append(r["j"])
    assert got == {i: [int(j) for j in np.argsort(d[i], kind="stable")[:4]] for i in range(len(x)) if i not in (5, 40)}


def test_blocks_of_cells_are_bounded_and_whole():
    rng = np.random.default_rng(2)
    sizes, pivots = rng.integers(0, 40, 50), rng.normal(size=(50, 2))
    sizes[7] = 500
    dealt = N._blocks_of_cells(sizes, pivots, 100)
    assert sorted(c for c, _, _ in dealt) == np.flatnonzero(sizes).tolist()
    assert {c: n for c, _, n in dealt}[7] == 5
    held = {}
    for c, b, n in dealt:
        for at in range(b, b + n):
            held[at] = held.get(at, 0) + sizes[c] / n
    assert sorted(held) == list(range(len(held))) and max(held.values()) <= 100


def test_rates_of_variants_share_searches(spark, points, monkeypatch):
    """Three values of k and a smaller sample: two searches, with the rates that each variant has by itself."""
    from panelforge.operators import learning as M
    from panelforge.plans import specs as X

    df = frame(spark, points).withColumn("H", F.slice("x", 4, 2))
    samples = {"all": df, "north": df.where("lat > 0"), "few": df.where("unit_id < 20")}
    rates = {"k2": ("all", {"x": 3}, 2), "k4": ("all", {"x": 3}, 4), "k6": ("all", {"x": 3}, 6), "north": ("north", {"x": 3}, 4), "few": ("few", {"x": 3}, 4)}
    searches, knn = [], N.knn
    monkeypatch.setattr(N, "knn", lambda *a, **b: searches.append(1) or knn(*a, **b))
    got = {r["variant"]: r for r in X.divergent_rates(samples, rates, "H").collect()}
    assert len(searches) == 2 and set(got) == {"k2", "k4", "k6", "north"}
    for label in ("k4", "north"):
        s, blocks, k = rates[label]
        x = M.block_scale(samples[s], blocks)
        want = N.divergent_rate(N.pair_distances(knn(x, x, k).select("i", "j", F.col("d").alias("d_sc")), x, {"d_h": "H"})).first()
        assert [got[label][c] for c in ("n_near", "near_cut", "far_cut", "divergent_rate")] == pytest.approx([want[c] for c in ("n_near", "near_cut", "far_cut", "divergent_rate")])
