"""Connected components by alternating large-star and small-star rounds.

Each round is settled, so lineage stays short and a lost executor costs one round at most. The smallest neighbour of a node is a partial
aggregate, and the labels of the few hot nodes are broadcast, so no task gets all edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.ordering import settled

#: A node is hot if it has more than this share of all edge ends; so there are fewer than 1 / HOT of them, whatever the input.
HOT = 1 / 512


def _labelled(rows: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """`rows` with the label m of their node u: by a broadcast for hot nodes, by a shuffle for the rest."""
    bound = max(64, int(ends * HOT))
    hot, cold = (least.where(F.col("n") > bound).select("u", "m"), least.where(F.col("n") <= bound).select("u", "m"))
    return rows.join(F.broadcast(hot), "u").unionByName(rows.join(F.broadcast(hot.select("u")), "u", "left_anti").join(cold, "u"))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _labelled(both.where(F.col("v") > F.col("u")), least, 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _labelled(down, least, count).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame, rounds: int = 60, rows_per_task: int | None = None) -> DataFrame:
    """`edges` has columns u and v of one ordered type. Returns (node, root), root being the smallest node of the component, for every node of an
    edge. Self-edges and nulls are ignored; repeated edges don't matter; no edges give an empty table. With `rows_per_task`, rounds over few edges are
    written by few tasks, however many the session's shuffles have."""
    fewer = lambda df, n: df if rows_per_task is None else df.coalesce(max(4, n // rows_per_task + 1))
    edges = settled(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    for _ in range(rounds if seen[0] else 0):
        edges = fewer(edges, seen[0])
        star = settled(fewer(_large_star(edges, seen[0]), 2 * seen[0]))
        edges = settled(fewer(_small_star(star, seen[0]).where(F.col("u") != F.col("v")).distinct(), seen[0]))
        now = mark(edges)
        if seen == now:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    ends = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("root")))
