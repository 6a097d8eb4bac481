import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import spatial as G


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


SQUARE = [ring((0, 0), (4, 0), (4, 4), (0, 4))]
HOLED = [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 3), (3, 3), (3, 1))]
CONCAVE = [ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(SQUARE, SQUARE, 16), (HOLED, SQUARE, 12), (HOLED, HOLED, 12), (SQUARE, [ring((2, 2), (6, 2), (6, 6), (2, 6))], 4), (SQUARE, [ring((9, 9), (10, 9), (10, 10))], 0), (CONCAVE, SQUARE, 10), (CONCAVE, [ring((1, 2), (3, 2), (3, 5), (1, 5))], 1 / 6), (HOLED, [ring((1, 1), (3, 1), (3, 3), (1, 3))], 0)],
)
def test_intersection_areas(a, b, want):
    assert G.intersection_area(a, b) == pytest.approx(want, abs=1e-9)
    assert G.intersection_area(b, a) == pytest.approx(want, abs=1e-9)


def test_overlay_counts_each_pair_once(spark):
    rows = [(i, [ring((i, 0), (i + 10, 0), (i + 10, 10), (i, 10))]) for i in range(5)]
    a = spark.createDataFrame(rows, f"left_id long, rings {G.RINGS}")
    b = a.withColumnRenamed("left_id", "right_id")
    got = {(r["left_id"], r["right_id"]): r["inter"] for r in G.overlay(a, b, 3.0).collect()}
    assert len(got) == 25
    assert got[(0, 4)] == pytest.approx(60)
    assert G.overlay(a.limit(0), b, 3.0).count() == 0


def test_zonal_means(spark):
    pixels = spark.createDataFrame([(c + 0.5, r + 0.5, float(c)) for c in range(10) for r in range(10)] + [(2.5, 2.5, -9999.0), (0.2, 0.2, float("nan"))], "x double, y double, value double")
    zones = spark.createDataFrame([(1, SQUARE), (2, HOLED), (3, [ring((50, 50), (51, 50), (51, 51))]), (4, None)], f"zone_id long, rings {G.RINGS}")
    z = G.zonal_mean(pixels, zones, 2.5, scale=2.0, offset=1.0, nodata=-9999.0)
    got = {r["zone_id"]: (r["zonal_mean"], r["n_valid"], r["n_inside"]) for r in z.collect()}
    assert got[1] == (pytest.approx(4.0), 16, 18)
    assert got[2] == (pytest.approx(4.0), 12, 13)
    assert got[3] == (None, 0, 0) and got[4] == (None, 0, 0)
    c = G.compatibility(pixels, zones.where("rings IS NOT NULL"), z).first()
    assert c["bbox_overlap"] and c["n_with_any"] == 2 and c["share_enough"] == 0.5


def test_zones_of_many_edges_are_cut_by_cells(spark):
    rng = np.random.default_rng(2)
    pixels = spark.createDataFrame([(float(x), float(y), float(v)) for x, y, v in zip(rng.integers(0, 80, 3000) / 4, rng.integers(0, 80, 3000) / 4, rng.normal(size=3000))], "x double, y double, value double")
    star = lambda x, y, r: ring(*[(x + r * (1 + 0.4 * math.cos(5 * t)) * math.cos(t), y + r * (1 + 0.4 * math.cos(5 * t)) * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 300, endpoint=False)])
    zones = spark.createDataFrame([(1, [star(9, 9, 6), star(9, 9, 2)]), (2, [star(3, 15, 5)]), (3, HOLED), (4, None), (5, [star(90, 90, 3)])], f"zone_id long, rings {G.RINGS}")
    rows = lambda **how: {r["zone_id"]: (r["zonal_mean"] and round(r["zonal_mean"], 9), r["n_valid"], r["n_inside"]) for r in G.zonal_mean(pixels, zones, 2.5, **how).collect()}
    want = rows(short=10_000)
    assert rows() == want == rows(short=3, edges_together=100, places_together=20) and want[1][2] > 500 and want[5] == (None, 0, 0)


def test_area_and_containment(spark):
    df = spark.createDataFrame([(HOLED,)], f"rings {G.RINGS}")
    e = G.edges(F.col("rings"))
    r = df.select(G.area(F.col("rings")).alias("a"), G.contains(e, F.lit(2.0), F.lit(2.0)).alias("hole"), G.contains(e, F.lit(0.5), F.lit(2.0)).alias("rim"), G.contains(e, F.lit(9.0), F.lit(2.0)).alias("out")).first()
    assert tuple(r) == (12.0, False, True, False)


def test_wkb(spark):
    blob = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    assert G.rings_of_wkb(blob) == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]
    df = spark.createDataFrame([(blob,), (None,)], "wkb binary")
    got = [r["a"] for r in df.select(G.area(G.wkb_rings("wkb")).alias("a")).collect()]
    assert got[0] == 0.5 and got[1] is None
    with pytest.raises(ValueError, match="not a polygon"):
        G.rings_of_wkb(struct.pack("<BIdd", 1, 1, 0.0, 0.0))
    assert math.isclose(0.5, 0.5)


def test_overlays_of_concave_outlines_equal_a_raster(spark):
    """Stars with holes, of unlike numbers of corners, against counts of small cells."""
    rng = np.random.default_rng(3)

    def star(x, y, n, r):
        turn, far = np.sort(rng.uniform(0, 2 * np.pi, n)), r * rng.uniform(0.4, 1, n)
        return ring(*[(x + d * math.cos(t), y + d * math.sin(t)) for t, d in zip(turn, far)])

    def inside(rings, x, y):
        odd = np.zeros(x.shape, bool)
        for own in rings:
            for p, q in zip(own, own[1:] + own[:1]):
                if p["y"] != q["y"]:
                    odd ^= ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
        return odd

    make = lambda i: [star(*rng.uniform(-2, 2, 2), int(rng.integers(5, 40)), 4.0), star(0, 0, 4, 0.3)]
    left, right = ([(i, make(i)) for i in range(6)] for _ in range(2))
    at = np.linspace(-7, 7, 1401)[:-1] + 0.005
    x, y = np.meshgrid(at, at)
    a = spark.createDataFrame(left, f"left_id long, rings {G.RINGS}")
    got = {(r["left_id"], r["right_id"]): r["inter"] for r in G.overlay(a, spark.createDataFrame(right, f"right_id long, rings {G.RINGS}"), 3.0).collect()}
    for i, p in left:
        for j, q in right:
            assert got.get((i, j), 0.0) == pytest.approx((inside(p, x, y) & inside(q, x, y)).sum() * 1e-4, abs=0.05)


def test_shared_and_touching_outlines():
    a = [ring((0, 0), (2, 0), (2, 2), (0, 2))]
    for b, want in (([ring((2, 0), (4, 0), (4, 2), (2, 2))], 0), ([ring((0, 0), (2, 2), (0, 2))], 2), ([ring((1, -1), (3, 1), (1, 3), (-1, 1))], 4 - 0), ([ring((0, 0), (2, 0), (2, 2), (0, 2)), ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5))], 3)):
        assert G.intersection_area(a, b) == pytest.approx(want, abs=1e-12) and G.intersection_area(b, a) == pytest.approx(want, abs=1e-12)
    assert G.intersection_area([], a) == 0 and G.intersection_area([ring((0, 0), (1, 0))], a) == 0
    many = [ring(*[(4 * math.cos(t), 4 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 4000, endpoint=False)])]
    table = G._edge_table(many)
    assert G.common_area(table, table, most=500) == pytest.approx(G.common_area(table, table)) == pytest.approx(16 * math.pi, rel=1e-5)


def test_areas_of_many_pairs_equal_those_of_each(spark):
    rng = np.random.default_rng(5)
    shapes = [G._edge_table([ring(*rng.uniform(0, 4, (int(rng.integers(3, 12)), 2)))]) for _ in range(60)] + [np.empty((0, 4)), G._edge_table(SQUARE), G._edge_table(HOLED), G._edge_table(CONCAVE)]
    pairs = [(i, j) for i in range(len(shapes)) for j in range(0, len(shapes), 3)]
    stacked = lambda side: (np.concatenate([shapes[p[side]] for p in pairs]), np.repeat(np.arange(len(pairs)), [len(shapes[p[side]]) for p in pairs]))
    assert G.common_areas(*stacked(0), *stacked(1), len(pairs)) == pytest.approx([G.common_area(shapes[i], shapes[j]) for i, j in pairs], abs=1e-9)
    rows = [(0, SQUARE), (1, HOLED), (2, CONCAVE), (3, [ring((1, 1), (3, 1), (2, 3))])]
    a = spark.createDataFrame(rows, f"left_id long, rings {G.RINGS}")
    b = a.withColumnRenamed("left_id", "right_id")
    found = lambda short: {(r["left_id"], r["right_id"]): round(r["inter"], 9) for r in G.overlay(a, b, 3.0, short=short).collect()}
    assert found(64) == found(0) == found(4) == {(i, j): round(w, 9) for i, p in rows for j, q in rows if (w := G.intersection_area(p, q)) > 0}


def test_reprojected_outlines_keep_to_the_curve(spark):
    bent = lambda x, y: F.struct((x + y * y / 100).alias("x"), y.alias("y"))
    df = spark.createDataFrame([(1, HOLED), (2, None)], f"k long, rings {G.RINGS}")
    got = {r["k"]: r["r"] for r in df.select("k", G.reprojected(F.col("rings"), bent, 1e-4).alias("r")).collect()}
    assert got[2] is None and len(got[1]) == 2
    points = [(p["x"], p["y"]) for p in got[1][0]]
    assert len(points) > 8 and all(min(abs(x - y * y / 100), abs(x - 4 - y * y / 100), abs(y), abs(y - 4)) < 1e-9 for x, y in points)
    assert [p for p in points if p[1] == 0] == [(0.0, 0.0), (4.0, 0.0)]
    assert G.intersection_area(got[1], got[1]) == pytest.approx(12, abs=1e-3)


def test_places_are_brought_to_straight_zones(spark):
    rng = np.random.default_rng(5)
    xy = [(float(x), float(y)) for x, y in rng.integers(0, 60, (2000, 2)) / 4]
    pixels = spark.createDataFrame([(x, y, 1.0) for x, y in xy], "x double, y double, value double")
    # A bent map; the last zone's side passes within 1e-7 of places, which outlines kept to 1e-6 can't tell.
    image = lambda x, y: (x + y * y / 10, y)
    sides = {1: (2.00123, 1.1, 9.30123, 8.2), 2: (0.10123, 5.1, 30.00123, 6.1), 3: (image(3.0, 2.0)[0] + 1e-7, 0.9, 12.00123, 9.9)}
    zones = spark.createDataFrame([(k, [ring((a, b), (c, b), (c, d), (a, d))]) for k, (a, b, c, d) in sides.items()], f"zone_id long, rings {G.RINGS}")
    z = G.zonal_mean(pixels, zones, 2.5, short=0, to=lambda x, y: F.struct((x + y * y / 10).alias("x"), y.alias("y")))
    want = {k: sum(a < image(x, y)[0] < c and b < y < d for x, y in xy) for k, (a, b, c, d) in sides.items()}
    assert {r["zone_id"]: r["n_inside"] for r in z.collect()} == want


def test_equal_outlines_are_intersected_once(spark, monkeypatch):
    frames = [[ring((x, 0), (x + 4, 0), (x + 4, 4), (x + 2, 1), (x, 4))] for x in (0, 3, 30)]
    a = spark.createDataFrame([(i, frames[i % 3]) for i in range(30)] + [(99, None)], f"left_id long, rings {G.RINGS}")
    b = spark.createDataFrame([(i, [ring((i, 0), (i + 3, 1), (i + 2, 3))]) for i in range(6)], f"right_id long, rings {G.RINGS}")
    want = {(i, j): G.intersection_area(f, r["rings"]) for i, f in ((i, frames[i % 3]) for i in range(30)) for j, r in enumerate(b.orderBy("right_id").collect())}
    want = {k: v for k, v in want.items() if v > 0}
    looked, once = [], G._overlay
    monkeypatch.setattr(G, "_overlay", lambda x, y, *how: looked.append((x.count(), y.count())) or once(x, y, *how))
    for together in (4096, 3):
        monkeypatch.setattr(G, "shapes", lambda df, key, rings, f=shapes_of, n=together: f(df, key, rings, n))
        got = {(r["left_id"], r["right_id"]): r["inter"] for r in G.overlay(a, b, 3.0).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert looked == [(3, 6), (3, 6)]


shapes_of = G.shapes
