import zlib

import pytest
from pyspark.sql import functions as F

from panelforge.llm import queries, sharding


def check(rows, texts, shards=40):
    """The law: contiguous in the order of ids, near-equal in bytes, slots gapless."""
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append(r)
    largest = max((r["size"] for r in rows), default=0)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * largest
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] if r["doc_id"] is not None else -(2**63) for r in ordered]
    assert ids == sorted(ids)


def test_documents(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op7_shards(spark, data).collect()
    check(rows, texts)
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body))


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_result_doesnt_depend_on_partitions(spark, parts):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") * 7 % 90).cast("int")).alias("text"), F.lit(1).alias("size"))
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    got = sorted(map(key, sharding.shard_by_bytes(docs.repartition(parts), 7).collect()))
    assert got == sorted(map(key, sharding.shard_by_bytes(docs.coalesce(1), 7).collect()))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, ""), (2, "")], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 3).collect()
    check(rows, range(5), 3)
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0
    big = spark.createDataFrame([(i, "a" * (100_000 if i == 5 else 1)) for i in range(10)], "doc_id long, text string")
    check(sharding.shard_by_bytes(big, 4).collect(), range(10), 4)


def test_a_key_that_holds_a_third_of_all_rows(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    rows = sharding.shard_by_bytes(docs.repartition(8), 40).collect()
    check(rows, range(3000))
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) > 10
