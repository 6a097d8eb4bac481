import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import ordering as O


def test_row_numbers_and_sums(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"), F.lit(2).cast("long").alias("w")).repartition(6)
    ranks = {r["k"]: r["r"] for r in O.row_numbers(df, ["k"], "r").collect()}
    assert ranks == {k: i for i, k in enumerate(sorted(ranks))}
    sums = {r["k"]: r["s"] for r in O.prefix_sums(df, ["k"], F.col("w"), "s").collect()}
    assert sums == {k: 2 * i for k, i in ranks.items()}


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_match_numpy(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    assert np.allclose(O.exact_quantiles(df, "x", qs).first()[0], np.quantile(x, qs))


def test_quantiles_without_values(spark):
    assert O.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).first()[0] == [None]


def test_no_task_gets_all_rows(spark, capsys):
    O.row_numbers(spark.range(1000), ["id"], "r").explain()
    plan = capsys.readouterr().out
    # One row per partition is all that meets in one place.
    assert plan.count("Exchange SinglePartition") == 1


def test_groups_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 9 == 0 else f"g{i % 3}", int(rng.integers(0, 20)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, id int")
    numbered = {r["id"]: r["r"] for r in O.row_numbers(df, ["x", "id"], "r", ["g"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert [numbered[i] for _, i in own] == list(range(len(own)))
    got = {r["g"]: r["q"] for r in O.exact_quantiles(df, "x", [0.1, 0.5], "q", ["g"]).collect()}
    assert got.keys() == {r[0] for r in rows}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([x for h, x, _ in rows if h == g], [0.1, 0.5]))


def test_joins_of_hot_keys_lose_nothing(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id")
    table = df.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS v")
    out = O.join_counted(df, table, ["k"], "n")
    assert out.count() == 9000 and out.where("v <> k * 2").count() == 0
