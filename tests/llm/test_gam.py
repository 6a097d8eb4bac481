import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import gam, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    s, y, p = (np.array(x) for x in zip(*held, strict=True))
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.97
    assert (p == y).mean() > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_scores_dont_depend_on_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = gam.remainder(F.col("doc_id"), 5) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r["doc_id"]: r["score"] for r in gam.classify(docs, x).collect()}
    assert score(labels) == score(turned)


def test_scores_depend_on_the_text_alone(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = gam.train(docs, labels)
    a = {r["doc_id"]: r["score"] for r in gam.scored(docs, model).collect()}
    b = {r["doc_id"] - 1000: r["score"] for r in gam.scored(docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit("xx")).repartition(7), model).collect()}
    assert a == b


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    plain, paired = gam.Gam(pairs=0).fit(x, y), gam.Gam(pairs=1).fit(x, y)
    right = lambda m: ((m.score(x) > 0.5) == y).mean()
    assert right(plain) < 0.65
    assert right(paired) > 0.95
    assert {paired.pairs[0][0], paired.pairs[0][1]} == {0, 1}


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    m = gam.Gam(rounds=10, pair_rounds=5, pairs=2).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    bins = m.binned(x[:1])[0]
    raw = m.intercept + sum(t[b] for t, b in zip(m.tables, bins, strict=True)) + sum(t[bins[i], bins[j]] for i, j, t in m.pairs)
    assert m.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 200_000, "c"), (3, "x" * 200_000, "c"), (None, "word " * 50, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = gam.classify(docs, none).collect()
    assert len(rows) == 5 and all(r["score"] == 0.5 for r in rows)
    one = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert len(gam.classify(docs, one).collect()) == 5
    assert gam.classify(docs.limit(0), none).count() == 0


def test_filter_keeps_columns(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = gam.train(docs, labels)
    kept = gam.filtered(docs, model)
    want = {r["doc_id"] for r in gam.scored(docs, model).where("score >= 0.3").collect()}
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == want
