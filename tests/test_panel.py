import pytest
from pyspark.sql import functions as F

from panelforge.operators import panel as P
from panelforge.operators import quality as Q


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(u, e, float(10 * (i + 1) * (u + 1)), float(5 + i), float(1 + i)) for u in range(4) for i, e in enumerate((1990, 1995, 2000, 2005))]
    rows = [r if not (r[0] == 3 and r[1] == 2005) else (3, 2005, r[2] * 5, r[3], r[4]) for r in rows]
    return spark.createDataFrame(rows, "unit_id long, epoch int, bus double, pop double, buv double")


def test_history_is_between_zero_and_one(panel):
    h = P.history_array(P.history(panel, "bus", 2005)).collect()
    assert len(h) == 4
    for r in h:
        assert len(r["H"]) == 3
        assert all(0 < v < 1 for v in r["H"])


def test_trajectories_equal_the_windows(spark):
    rows = [(u, e, float(u + 1), float(e % 7), 1.0) for u in range(3) for e in (1990, 1995, 2000, 2005) if (u, e) not in ((1, 1995), (2, 2000))]
    flow = spark.createDataFrame(rows, "unit_id long, epoch int, bus double, pop double, buv double")
    stock = P.cumulative(flow, ("bus", "pop", "buv"))
    want = {r["unit_id"]: r["H"] for r in P.history_array(P.history(stock, "bus", 2000)).collect()}
    ends = {r["unit_id"]: r["pop"] for r in stock.where("epoch = 2000").collect()}
    got = {r["unit_id"]: (r["H"], r["pop"]) for r in P.trajectories(flow, ("bus", "pop", "buv"), 2000, "bus").collect()}
    assert got[2] == (None, None)
    assert {k: v[0] for k, v in got.items() if k != 2} == {k: v for k, v in want.items() if k != 2}
    assert {k: v[1] for k, v in got.items() if k != 2} == ends


def test_later_epochs_dont_change_an_earlier_history(panel):
    """Precedence: corrupting what comes after the base leaves the history unchanged."""
    spoiled = panel.withColumn("bus", F.when(F.col("epoch") > 2000, -1.0).otherwise(F.col("bus")))
    a, b = (P.history(x, "bus", 2000).orderBy("unit_id", "epoch").collect() for x in (panel, spoiled))
    assert a == b


def test_zero_base_gives_null(spark):
    p = spark.createDataFrame([(1, 1990, 5.0), (1, 2000, 0.0)], "unit_id long, epoch int, bus double")
    assert P.history(p, "bus", 2000).first()["h"] is None


def test_descriptors(panel):
    d = {r["unit_id"]: r for r in P.descriptors(panel, "bus", 2005, 1990, 2000).collect()}
    assert d[0]["h_early"] == pytest.approx(0.25)
    assert d[0]["late_growth"] == pytest.approx(0.25)
    assert d[0]["weighted_timing"] == pytest.approx((1992.5 + 1997.5 + 2002.5) / 3)


def test_no_growth_has_no_timing(spark):
    p = spark.createDataFrame([(1, e, 5.0) for e in (1990, 1995, 2000)], "unit_id long, epoch int, bus double")
    assert P.descriptors(p, "bus", 2000, 1990, 1995).first()["weighted_timing"] is None


def test_flags_and_cascade(spark, panel):
    attributes = spark.createDataFrame([(0, "a", "x", 1980, 2050), (1, "a", "x", 1980, 2050), (2, "b", "x", 2001, 2050), (3, "c", "x", 1980, 2004), (9, "d", "x", 1980, 2050)], "unit_id long, name string, country string, born int, died int")
    f = {r["unit_id"]: r for r in Q.flags(panel, attributes, (1990, 1995, 2000, 2005)).collect()}
    assert f[3]["extreme_jump"] and not f[0]["extreme_jump"]
    assert f[0]["duplicate_name"] and not f[2]["duplicate_name"]
    assert f[2]["born_late"] and f[3]["died_early"]
    assert f[9]["incomplete"] and f[9]["zero_endpoint"] and f[9]["bus_missing"]
    flags = spark.createDataFrame([r.asDict() for r in f.values()])
    reasons = {"incomplete": F.col("incomplete"), "never": F.lit(False), "jump": F.col("extreme_jump"), "born": F.col("born_late") | F.col("incomplete")}
    audit = [tuple(r) for r in Q.exclusion_audit(flags, reasons).orderBy("step").collect()]
    assert audit == [(1, "incomplete", 1, 4), (2, "never", 0, 4), (3, "jump", 1, 3), (4, "born", 1, 2)]
    assert Q.kept(flags, reasons).count() == 2


def test_missing_and_nan_count_alike(spark):
    p = spark.createDataFrame([(1, 1990, float("nan"), -1.0, float("inf")), (1, 1995, 1.0, 1.0, 1.0)], "unit_id long, epoch int, bus double, pop double, buv double")
    a = spark.createDataFrame([(1, "n", "c", None, None)], "unit_id long, name string, country string, born int, died int")
    r = Q.flags(p, a, (1990, 1995)).first()
    assert r["bus_missing"] and r["pop_negative"] and r["not_finite"] and not r["born_late"]


def test_guards(spark):
    df = spark.range(10)
    assert Q.enough(df, 10) and not Q.enough(df, 11)
    Q.assert_same_rows(df, df.orderBy(F.desc("id")))
    with pytest.raises(AssertionError):
        Q.assert_same_rows(df, df.unionAll(spark.range(1)))
    with pytest.raises(ValueError, match="repeats"):
        Q.assert_unique(df.unionAll(spark.range(1)), "id")


def test_widths_of_blocks(spark):
    one = [F.lit(1.0)] * 7
    row = spark.range(1).select(*[F.size(P.state_block(F.lit(2.0), F.lit(3.0), F.lit(4.0), s)).alias(s) for s in ("S1", "S2", "S3")], *[F.size(P.context_block(one[0], one[1], one[2], one[3], one[4], one[5:7], F.lit("A"), c)).alias(c) for c in ("C0", "C1", "C2")]).first()
    assert tuple(row) == (2, 3, 4, 3, 5, 12)


def test_log_density_isnt_constant(spark):
    df = spark.createDataFrame([(1.0, 100.0), (5.0, 100.0)], "pop double, bus double")
    got = [r[0] for r in df.select(P.state_block(F.col("pop"), F.col("bus"), F.lit(1.0), "S2", log=True)[2]).collect()]
    assert got[0] != got[1]
