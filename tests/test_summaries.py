import math

import pytest
from pyspark.sql import functions as F

from panelforge.operators import summaries as A


def test_quantile_summary_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (-2.0,), (0.0,), (4.0,), (-1.0,), (float("nan"),)], "x double")
    r = df.agg(*A.quantile_summary(F.col("x"))).first()
    assert (r["n_valid"], r["n_missing"], r["n_positive"], r["n_negative"], r["n_zero"]) == (5, 1, 2, 2, 1)
    assert r["p50"] == 0.0


def test_mean_difference(spark):
    df = spark.createDataFrame([(2.0, True), (4.0, True), (1.0, False), (3.0, False), (float("inf"), False)], "x double, g boolean")
    assert df.agg(A.mean_difference(F.col("x"), F.col("g")).alias("d")).first()["d"] == pytest.approx(1 / math.sqrt(2))
    assert df.where("x < 3").agg(A.mean_difference(F.col("x"), F.col("g")).alias("d")).first()["d"] is None


@pytest.mark.parametrize("closed", ["right", "left"])
def test_terciles_with_ties(spark, closed):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1, 1, 1, 2, 2, 2, 2, 3, 3, 4])], "i int, x int")
    f = A.bins_right_closed if closed == "right" else A.bins_left_closed
    got = "".join(r["bin"] for r in f(df, "x", ("0", "1", "2")).orderBy("i").collect())
    assert got == {"right": "0000000222", "left": "0002222222"}[closed]


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0), (None, 1.0)], "a double, b double")
    r = A.spearman(df, "a", "b").first()
    assert r["n"] == 4
    assert r["rho"] == pytest.approx(0.9486832980505138)


def test_correlation_p_values():
    assert A.correlation_p(0.0, 10) == pytest.approx(1.0)
    assert A.correlation_p(1.0, 10) == 0.0
    assert A.correlation_p(0.6319, 10) == pytest.approx(0.05, abs=1e-3)
    assert math.isnan(A.correlation_p(0.5, 2))


def test_profile(spark):
    df = spark.createDataFrame([(1, -999.0, "a"), (2, float("nan"), "a"), (3, 5.0, None)], "id long, v double, s string")
    p = {r["column"]: r for r in A.profile(df).collect()}
    assert p["id"]["id_candidate"] and not p["s"]["id_candidate"]
    assert (p["v"]["n_missing"], p["v"]["n_sentinel_0"], p["v"]["n_distinct"]) == (1, 1, 2)


def test_calendar_of_a_leap_year(spark):
    days = spark.sql("SELECT explode(sequence(date'2020-01-01', date'2020-12-31')) AS date")
    named = days.withColumn("name", F.concat(F.date_format("date", "yyyy_MM_dd"), F.lit("_DMLST.tif")))
    want = F.concat(F.date_format("date", "yyyy_MM_dd"), F.lit("_DMLST.tif"))
    audit = lambda df: A.calendar_audit(df, "2020-01-01", "2020-12-31", expected_name=want).first()
    full = audit(named)
    assert full["complete"] and full["n_expected"] == 366
    assert audit(named.where("date NOT IN (date'2020-02-29', date'2020-12-31')"))["n_missing"] == 2
    twice = audit(named.where("date <> date'2020-03-01'").unionByName(named.where("date = date'2020-03-02'")))
    assert (twice["n_missing"], twice["n_repeated"], twice["complete"]) == (1, 1, False)
    other = audit(named.withColumn("date", F.when(F.col("date") == F.to_date(F.lit("2020-05-01")), F.to_date(F.lit("2019-05-01"))).otherwise(F.col("date"))))
    assert (other["n_unexpected"], other["n_missing"]) == (1, 1)
    assert audit(named.withColumn("name", F.upper("name")))["n_wrong_name"] == 366
    assert audit(named.limit(0))["n_missing"] == 366


def test_completeness_of_side_files(spark):
    df = spark.createDataFrame([("A.SHP",), ("a.shx",), ("a.dbf",), ("a.prj",), ("b.shp",), ("c.txt",)], "name string")
    got = {r["stem"]: (r["complete"], r["missing"], r["optional"]) for r in A.completeness(df).collect()}
    assert got == {"a": (True, [], [".prj"]), "b": (False, [".dbf", ".shx"], [])}


def test_samples(spark):
    df = spark.range(100)
    assert [r["id"] for r in A.spaced_sample(df, "id", 5).orderBy("id").collect()] == [0, 24, 49, 74, 99]
    assert A.spaced_sample(spark.range(3), "id", 5).count() == 3
    assert sorted(r["id"] for r in A.first_middle_last(df, "id").collect()) == [0, 50, 99]
    a, b = (sorted(r["id"] for r in A.hashed_sample(x, "id", 7).collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 7


def test_pairs_are_unordered(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (5, 4)], "i int, j int")
    assert sorted(tuple(r) for r in A.unordered_pairs(df).select("i", "j").collect()) == [(1, 2), (4, 5)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "x double, g boolean, k string")
    assert e.agg(A.mean_difference(F.col("x"), F.col("g")).alias("d")).first()["d"] is None
    assert A.average_rank(e, "x", "r").count() == 0
    assert A.match_rates(e, "k", "g").count() == 0
    assert A.stacked_means(e, "x", {"k": F.col("k")}).count() == 0
