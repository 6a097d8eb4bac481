"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in vertical layout (one row per dimension). For each query, scores accumulate block of dimensions by block; after each
block a candidate whose partial score plus the most the remaining dimensions can add (product of the remaining norms, by
Cauchy-Schwarz) is under the k-th best score known so far is dropped, and the survivors are compacted. The result is exact.

Scale: candidates and queries are packed into bounded blocks; query blocks are dealt to every group of candidates, each task scores
one group against one block, and only k rows per query and group are shuffled.

Defined cases: components become floor(scale * x) as integers; vectors that are null, or hold a null or non-finite component, take no part;
vectors of different lengths are compared as if the shorter ended in zeros; a candidate row with the query's id is
the query's own; of query rows that repeat an id the one with the smallest vector asks; repeated candidate rows count each; equal scores go to the smaller id; scores beyond
64 bits stop at the limits of long; with fewer than k candidates all are returned; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm._base import salted_partitions

_LEAST, _MOST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): integer components as doubles, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    whole = v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return vectors.where(whole).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(rows: list[np.ndarray], dims: int) -> np.ndarray:
    """dims x n, padded with zeros."""
    out = np.zeros((dims, len(rows)))
    for i, r in enumerate(rows):
        out[: len(r), i] = r
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, table: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best in `table`; both matrices are dims x n and hold whole numbers
    whose inner products stay under 2**53."""
    dims, n = table.shape
    cuts = [*range(0, dims, step), dims]
    # Norms of what remains after each block of dimensions.
    rest = [np.sqrt((table[c:] ** 2).sum(axis=0)) for c in cuts[1:]]
    out_q, out_c, out_s = [], [], []
    for i, own in enumerate(query_ids):
        q = queries[:, i]
        alive, score, cols = None, np.zeros(n), table
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = q[lo:hi] @ (cols[lo:hi] if alive is None else table[lo:hi, alive])
            score = score + part
            if hi == dims:
                break
            m = len(score)
            if m > 4 * k:
                room = float(np.sqrt(q[hi:] @ q[hi:])) * (rest[b] if alive is None else rest[b][alive])
                floor_ = np.where((ids if alive is None else ids[alive]) == own, -np.inf, score - room)
                kth = np.partition(floor_, m - k)[m - k]
                keep = score + room >= kth - 1e-6 * (1 + abs(kth)) if np.isfinite(kth) else np.ones(m, bool)
                if keep.sum() < 0.7 * m:
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    score = score[keep]
        left = ids if alive is None else ids[alive]
        other = left != own
        left, score = left[other], score[other]
        at = _best(left, score, k)
        out_q.append(np.full(len(at), own))
        out_c.append(left[at])
        out_s.append(score[at])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s).astype(np.int64)


def _search_exact(query_ids, queries, ids, rows, k):
    """The same by Python's integers, for components so large that 53 bits don't hold a score."""
    out = []
    cand = [[int(x) for x in r] for r in rows]
    for own, q in zip(query_ids, queries, strict=True):
        q = [int(x) for x in q]
        scored = sorted((-min(_MOST, max(_LEAST, sum(a * b for a, b in zip(q, c, strict=False)))), int(i)) for i, c in zip(ids, cand, strict=True) if i != own)
        out += [(own, i, -s) for s, i in scored[:k]]
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 8192, group_rows: int = 1 << 15) -> DataFrame:
    """`candidates` and `queries` have columns id (long) and v (array of whole doubles). Returns query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    candidates, queries = candidates.where("id IS NOT NULL"), queries.where("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    groups = max(2, salted_partitions(spark) // 2, -(-candidates.count() // group_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    # Every (group, block) cell is one task: candidates go to each block of queries, queries to each group of candidates.
    c = candidates.select("id", "v", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    q = queries.select("id", "v", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["is_query"].to_numpy(bool)
        ids, v = pdf["id"].to_numpy(np.int64), [np.asarray(x, float) for x in pdf["v"]]
        qv, cv = [x for x, y in zip(v, is_query, strict=True) if y], [x for x, y in zip(v, is_query, strict=True) if not y]
        found = (np.empty(0, np.int64),) * 3
        if qv and cv:
            dims = max([1, *map(len, v)])
            most = max(np.abs(x).max(initial=0) for x in qv) * max(np.abs(x).max(initial=0) for x in cv) * dims
            found = search_block(ids[is_query], _matrix(qv, dims), ids[~is_query], _matrix(cv, dims), k) if most < 2**52 else _search_exact(ids[is_query], qv, ids[~is_query], cv, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    best = c.unionByName(q).groupBy("g", "b").applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
