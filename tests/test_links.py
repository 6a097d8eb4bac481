import pytest
from pyspark.sql import functions as F

from panelforge.operators import links as L

SCHEMA = "unit_id long, cluster_id long, inter double, a_unit double, a_cluster double, distance_km double"


def classified(spark, rows, countries=None):
    ids = sorted({r[0] for r in rows})
    c = spark.createDataFrame([(i, (countries or {}).get(i, "x")) for i in ids], "unit_id long, country string")
    return L.classify(spark.createDataFrame(rows, SCHEMA), c)


def classes(df):
    return {(r["unit_id"], r["cluster_id"]): r["pair_class"] for r in df.collect()}


def test_pair_classes(spark):
    rows = [
        (1, 11, 90.0, 100.0, 110.0, 5.0), (2, 12, 60.0, 100.0, 900.0, 5.0),  # strict; mismatch
        (3, 13, 80.0, 100.0, 100.0, 1.0), (4, 13, 10.0, 15.0, 100.0, 1.0),  # dominant and minor
        (5, 14, 50.0, 60.0, 120.0, 1.0), (6, 14, 50.0, 60.0, 120.0, 1.0),  # ambiguous
        (7, 15, 50.0, 60.0, 120.0, 1.0), (8, 15, 50.0, 60.0, 120.0, 1.0),  # two countries
        (9, 16, 60.0, 100.0, 70.0, 1.0), (9, 17, 60.0, 100.0, 70.0, 1.0),  # one to many
        (20, 31, 60.0, 100.0, 70.0, 1.0), (20, 32, 60.0, 100.0, 70.0, 1.0), (21, 32, 60.0, 100.0, 70.0, 1.0),  # many to many
        (30, 41, 10.0, 100.0, 100.0, 1.0),  # no link
    ]
    got = classes(classified(spark, rows, {8: "y"}))
    assert got == {
        (1, 11): "A_strict_1to1", (2, 12): "H_footprint_mismatch_1to1", (3, 13): "B_dominant_1to1", (4, 13): "D_minor_of_dominant", (5, 14): "D_many_to_one_ambiguous", (6, 14): "D_many_to_one_ambiguous",
        (7, 15): "E_cross_country_cluster", (8, 15): "E_cross_country_cluster", (9, 16): "C_ambiguous_one_to_many", (9, 17): "C_ambiguous_one_to_many",
        (20, 31): "J_complex_many_to_many", (20, 32): "J_complex_many_to_many", (21, 32): "J_complex_many_to_many",
    }


def test_node_classes(spark):
    links = classified(spark, [(3, 13, 80.0, 100.0, 100.0, 1.0), (4, 13, 10.0, 15.0, 100.0, 1.0), (1, 11, 90.0, 100.0, 110.0, 5.0)])
    valid = spark.createDataFrame([(13, True), (11, False)], "cluster_id long, valid boolean")
    assert {r[0]: r[1] for r in L.cluster_classes(links, valid).collect()} == {13: "B_dominant_1to1", 11: "G_response_missing(A_strict_1to1)"}


def test_long_chain_is_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(i, 1000 + j) for i in range(n) for j in (i, i + 1)], "a long, b long")
    assert {r["component"] for r in L.components(edges, "a", "b").collect()} == {0}


def test_status_precedence(spark):
    schema = "cluster_id long, unit_id long, inter double, a_unit double, a_cluster double, valid boolean, country string, comp_clusters long, n_clusters long"
    rows = [
        (11, 1, 110.0, 200.0, 200.0, True, "x", 1, 1), (12, 2, 50.0, 60.0, 200.0, True, "x", 1, 1), (12, 3, 60.0, 70.0, 200.0, True, "x", 1, 1), (13, 4, 20.0, 60.0, 200.0, True, "x", 1, 1),
        (14, 5, 200.0, 200.0, 200.0, False, "x", 1, 1), (15, 6, 100.0, 200.0, 200.0, True, "x", 1, 1), (15, 7, 100.0, 200.0, 200.0, True, "y", 1, 1), (16, 8, 200.0, 200.0, 200.0, True, "x", 2, 2),
    ]
    links = spark.createDataFrame(rows, schema)
    got = {r["cluster_id"]: (r["status"], r["n_units"], round(r["coverage"], 3)) for r in L.cluster_status(links, 0.5).collect()}
    assert got == {11: ("unit", 1, 0.55), 12: ("unit", 2, 0.55), 13: ("low_coverage", 1, 0.1), 14: ("invalid_R", 1, 1.0), 15: ("cross_country", 2, 1.0), 16: ("ambiguous_nonstar", 1, 1.0)}
    shuffled = {r["cluster_id"]: r["status"] for r in L.cluster_status(links.orderBy(F.rand(3)), 0.5).collect()}
    assert shuffled == {k: v[0] for k, v in got.items()}
    assert {r["cluster_id"]: r["status"] for r in L.cluster_status(links, 0.5, 0.5).collect()}[11] == "low_iou"


def test_sweep_is_monotone(spark):
    rows = [(i, i, float(i), 100.0, 100.0, True, "x", 1, 1) for i in range(1, 100, 7)]
    links = spark.createDataFrame(rows, "cluster_id long, unit_id long, inter double, a_unit double, a_cluster double, valid boolean, country string, comp_clusters long, n_clusters long")
    rules = spark.createDataFrame([(f"c{c}", c / 10, None) for c in range(2, 9)], "rule string, min_coverage double, min_iou double")
    n = [r["n_units"] for r in L.sweep(links, rules).orderBy("rule").collect()]
    assert n == sorted(n, reverse=True)
    assert n[0] > n[-1]


def test_units_aggregate_members(spark):
    members = spark.createDataFrame([(1, 1000.0, 15.0, 10.0, "r1"), (2, 500.0, 0.0, 20.0, "r2"), (3, 1000.0, 40.0, 30.0, "r3")], "unit_id long, pop double, bus double, lat double, region string")
    units = spark.createDataFrame([(7, "1;2;3"), (8, "2")], "cluster_id long, unit_ids string")
    got = {r["cluster_id"]: r for r in L.aggregate_units(units, members, {"pop": "pop", "built": "bus"}, "bus", ["lat"], ["region"]).collect()}
    assert got[7]["pop"] == 2500 and got[7]["built"] == 55 and got[7]["dominant_id"] == 3 and got[7]["region"] == "r3"
    assert got[7]["lat"] == pytest.approx((150 + 1200) / 55)
    assert got[8]["lat"] is None  # no weight
    with pytest.raises(KeyError):
        L.aggregate_units(spark.createDataFrame([(7, "1;99")], "cluster_id long, unit_ids string"), members, {"pop": "pop"}, "bus", [], [])


def test_correspondence(spark):
    schema = "id long, key string, v double, born int"
    a = spark.createDataFrame([(1, "a", 10.0, 1990), (2, "b", 10.0, 1990), (3, "c", 10.0, 1990), (4, "c", 10.0, 1990), (5, None, 1.0, 1990)], schema)
    b = spark.createDataFrame([(1, "a", 10.0, 1990), (2, "b", 500.0, 1990), (3, "c", 10.0, 1990), (6, "d", 10.0, 2005), (5, None, 1.0, 1990)], schema)
    rows = L.correspond(a, b, "key", "v", core=F.col("r_born") < 2000).collect()
    got = sorted((r["match"], r["l_id"] or 0, r["r_id"] or 0, r["corroborated"], r["core"]) for r in rows)
    assert got == sorted([("one_to_one", 1, 1, True, True), ("one_to_one", 2, 2, False, False), ("ambiguous_many_sided", 3, 3, False, False), ("ambiguous_many_sided", 4, 3, False, False), ("left_only", 5, 0, False, False), ("right_only", 0, 6, False, False), ("right_only", 0, 5, False, False)])


def test_hot_keys_are_one_row(spark):
    """A key of many rows on both sides is one row; the pairs of it, 4 * 10**8, are never made."""
    n = 20_000
    side = lambda odd: spark.range(n + 3).select(F.col("id"), F.when(F.col("id") < n, "hot").when(F.col("id") == n, odd).when(F.col("id") == n + 1, "both").alias("key"), (F.col("id") + 1.0).alias("v"))
    got = {r["key"]: r for r in L.key_classes(side("l"), side("r"), check="v").where("key IS NOT NULL").collect()}
    assert len(got) == 4 and (got["hot"]["match"], got["hot"]["n_left"], got["hot"]["n_right"], got["hot"]["l_id"]) == ("ambiguous_many_sided", n, n, None)
    assert (got["both"]["match"], got["both"]["l_id"], got["both"]["check_ratio"], got["both"]["corroborated"]) == ("one_to_one", n + 1, 1.0, True)
    assert (got["l"]["match"], got["l"]["n_right"], got["r"]["match"], got["r"]["corroborated"]) == ("left_only", 0, "right_only", False)
    gone = L.key_classes(side("l"), side("r")).where("key IS NULL").collect()
    assert sorted((r["match"], r["n_left"], r["n_right"]) for r in gone) == [("left_only", 1, 0), ("right_only", 0, 1)]


def test_members_of_a_hub(spark):
    members = spark.range(10_000).select(F.col("id").alias("unit_id"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("cluster_id"))
    got = {r["cluster_id"]: r["unit_ids"] for r in L.member_lists(members.unionByName(members), chunk=100).collect()}
    assert got[7] == ";".join(str(i) for i in range(10_000) if i % 10) and got[20] == "20" and len(got) == 1001


def test_only_units_of_several_clusters_are_contracted(spark, monkeypatch):
    """Units with one link hang on their cluster, so the rounds over edges don't see them; sizes and components equal those of a plain search."""
    seen, whole = [], L.connected
    monkeypatch.setattr(L, "connected", lambda edges: seen.append(edges.count()) or whole(edges))
    rows = [(u, 1000 + u % 40, 60.0, 100.0, 70.0, 1.0) for u in range(400)] + [(u, 1000 + (u + 1) % 40, 60.0, 100.0, 70.0, 1.0) for u in range(0, 400, 57)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        a, b = sorted((find(r[0]), find(r[1])))
        root[b] = a
    members = {}
    for r in rows:
        members.setdefault(find(r[0]), set()).update(r[:2])
    want = {(r[0], r[1], c := find(r[0]), sum(x < 1000 for x in members[c]), sum(x >= 1000 for x in members[c])) for r in rows}
    got = {tuple(r) for r in classified(spark, rows).select("unit_id", "cluster_id", "component", "comp_units", "comp_clusters").collect()}
    assert got == want and seen == [7]  # the clusters of unit 0 have the same smallest unit
    lone = spark.createDataFrame([(None, 1), (5, None), (7, 2), (9, 2), (9, 2)], "a long, b long")
    assert {tuple(r) for r in L.components(lone, "a", "b").collect()} == {("a", 7, 7), ("a", 9, 7), ("b", 2, 7)}
    assert seen == [7, 0]


def test_members_of_small_groups_are_not_numbered(spark, monkeypatch):
    members = spark.createDataFrame([(1, 3), (1, 2), (1, 2), (4, 9)], "cluster_id long, unit_id long")
    monkeypatch.setattr(L, "row_numbers", lambda *a, **k: pytest.fail("rows are sorted"))
    assert {tuple(r) for r in L.member_lists(members).collect()} == {(1, "2;3"), (4, "9")}


def test_countries_and_valid_clusters_are_made_without_pairs(spark, data, capsys):
    from panelforge.plans import base

    base.link_countries(spark, data).explain()
    base.cluster_valid(spark, data).explain()
    first, second = capsys.readouterr().out.split("== Physical Plan ==")[1:]
    assert "l_partkey" not in first and "l_orderkey" not in second
