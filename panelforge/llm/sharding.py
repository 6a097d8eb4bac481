"""Contiguous balanced shards by global byte-size prefix sums.

Law `bytes`: rows are put in the order of the key; the running byte total before a row, from
per-partition totals, tells which of the equal cuts the row falls into.

Defined cases: a null text has no bytes and only the fixed cost; an empty table gives an empty result; rows that
repeat are placed one by one (their order among each other is that of the input); null keys come first;
a text longer than a shard's share makes one large shard and may leave the next one empty. Only the key and the
text are read, so extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm._base import salted_partitions, store

_LOCAL = "part int, doc_id long, size long, text_crc32 long, before long, at long"


def _running(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte total and row count before each row, within its partition."""
    part, total, rows = TaskContext.get().partitionId(), 0, 0
    for batch in arrow:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column("size").to_numpy()
        ends = total + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, "int32")), batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(ends - size), pa.array(rows + np.arange(n))],
            names=["part", "doc_id", "size", "text_crc32", "before", "at"],
        )
        total, rows = int(ends[-1]), rows + n


def shard_by_bytes(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", fixed: int = 16) -> DataFrame:
    """Deals `docs` into contiguous shards of near-equal byte size.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null: this
    law has no growth rule). Texts are never shuffled: a narrow table of key, size and checksum is.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = store(docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(fixed)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("_order")), "sizes")
    # The order column follows the key, so a key that repeats is cut across partitions too.
    ordered = narrow.repartitionByRange(salted_partitions(spark), "doc_id", "_order").sortWithinPartitions("doc_id", "_order").drop("_order")
    local = store(ordered.mapInArrow(_running, _LOCAL), "running")
    # One row per partition: the only rows that meet in one place.
    totals = local.groupBy("part").agg(F.sum("size").alias("part_bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0))).withColumn("total", F.sum("part_bytes").over(Window.partitionBy()))
    middle = F.col("offset") + F.col("before") + F.floor(F.col("size") / 2)
    placed = local.join(F.broadcast(offsets), "part").withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int"))
    # Rows of a shard within a partition are contiguous, so counts by (shard, partition) give every slot.
    pieces = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    starts = pieces.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(starts.select("shard", "part", "first", "start")), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
