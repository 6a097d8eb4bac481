"""Nearest neighbours: exact k-NN in blocks, mutual pairs under a separation, inverse-distance prediction, histories of pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from panelforge.functions.scalars import EARTH_KM, distance
from panelforge.operators.ordering import exact_quantiles, few, settled


@dataclass(frozen=True)
class _Rules:
    """Which candidates a query may have."""

    least_km: float | None
    same_group: str | None
    other_group: str | None

    def columns(self) -> list[str]:
        return [c for c in ("lat", "lon") if self.least_km is not None] + [c for c in (self.same_group, self.other_group) if c]

    def barred(self, q: pd.DataFrame, c: pd.DataFrame, paired: bool = False) -> np.ndarray:
        """For every query and candidate, or with `paired` for the rows side by side, whether the pair isn't allowed."""
        left, right = (lambda v: v, lambda v: v) if paired else (lambda v: v[:, None], lambda v: v[None, :])
        bad = left(q["id"].to_numpy()) == right(c["id"].to_numpy())
        if self.least_km is not None:
            la, lo, lb, mo = (np.radians(v.to_numpy(float)) for v in (q["lat"], q["lon"], c["lat"], c["lon"]))
            h = np.sin((right(lb) - left(la)) / 2) ** 2 + left(np.cos(la)) * right(np.cos(lb)) * np.sin((right(mo) - left(lo)) / 2) ** 2
            bad |= 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h))) < self.least_km
        return bad | self.ungrouped(q, c, paired)

    def ungrouped(self, q: pd.DataFrame, c: pd.DataFrame, paired: bool = False) -> np.ndarray | bool:
        """`barred` by the group columns alone."""
        bad = False
        for column, wrong in ((self.same_group, np.not_equal), (self.other_group, np.equal)):
            if column:
                a, b = q[column].to_numpy(), c[column].to_numpy()
                bad = bad | (wrong(a, b) if paired else wrong(a[:, None], b[None, :]))
        return bad


_FOUND = "i long, j long, d double"


def _nearest_of(q: pd.DataFrame, c: pd.DataFrame, k: int, rules: _Rules, rows: int = 256, pairs: int = 1 << 16) -> pd.DataFrame:
    """The k nearest of `c` for each row of `q`. Products of matrices pick the candidates; their distances are then taken anew, difference by difference, so that equal vectors tie."""
    out = [pd.DataFrame({"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "d": np.empty(0)})]
    if len(q) and len(c):
        c = c.sort_values("id")
        b, ids = np.array(c["x"].tolist(), float), c["id"].to_numpy(np.int64)
        norms = (b * b).sum(axis=1)
    for at in range(0, len(q) if len(c) else 0, rows):
        own = q.iloc[at : at + rows]
        a = np.array(own["x"].tolist(), float)
        mine = (a * a).sum(axis=1)
        rough = mine[:, None] + norms[None, :] - 2 * (a @ b.T)
        rough[rules.barred(own, c)] = np.inf
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(a), np.inf)
        slack = 1e-9 * (1 + mine + norms.max())
        r, s = np.nonzero((rough <= (kth + slack)[:, None]) & np.isfinite(rough))
        d = np.concatenate([np.sqrt(((a[r[x : x + pairs]] - b[s[x : x + pairs]]) ** 2).sum(axis=1)) for x in range(0, len(r), pairs)] or [np.empty(0)])
        order = np.lexsort((s, d, r))
        r, s, d = r[order], s[order], d[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append(pd.DataFrame({"i": own["id"].to_numpy(np.int64)[r[keep]], "j": ids[s[keep]], "d": d[keep]}))
    return pd.concat(out)


def _search(queries: DataFrame, candidates: DataFrame, on: list[str], k: int, rules: _Rules) -> DataFrame:
    """`_nearest_of` in each group of the columns `on`."""
    names = ["id", "x", *rules.columns(), *on]
    rows = queries.select(*names, F.lit(True).alias("asks")).unionByName(candidates.select(*names, F.lit(False).alias("asks")))
    return rows.groupBy(*on).applyInPandas(lambda pdf: _nearest_of(pdf[pdf["asks"]], pdf[~pdf["asks"]], k, rules), _FOUND)


def knn(queries: DataFrame, candidates: DataFrame, k: int, x: str = "x", key: str = "unit_id", least_km: float | None = None, same_group: str | None = None, other_group: str | None = None, block_rows: int = 8192) -> DataFrame:
    """(i, j, d, rank): the k nearest candidates of each query by Euclidean distance of arrays `x`, ties to smaller ids, never itself.

    `least_km`: candidates at least so far away on the sphere (columns lat, lon). `other_group`: candidates must differ in that column; `same_group`: must
    agree. A few candidates are compared with blocks of queries. More of them are dealt to the cells of pivots, and near cells' queries make up blocks of bounded size. A block first meets the candidates of its own
    cells; the distances found there tell, by the triangle inequality and the planes between pivots, which other cells can hold nearer ones, and only these are sent to it. A task
    holds the queries of one block while candidates pass by, so that only rows of candidates are shuffled, once for each block that asks for them.
    """
    rules = _Rules(least_km, same_group, other_group)
    side = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"), *rules.columns())
    c = side(candidates)
    q = c if queries is candidates else side(queries)
    nc = candidates.count()
    nq = nc if queries is candidates else queries.count()
    if nc <= 2 * block_rows:
        blocks = max(1, math.ceil(nq / block_rows))
        dealt = c.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        best = _search(q.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), dealt, ["a"], k, rules)
    else:
        return _knn_in_cells(q, c, nq, nc, k, rules, block_rows)
    w = Window.partitionBy("i").orderBy("d", "j")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (a @ pivots.T)))


def _slices(batches: Iterator[pd.DataFrame], rows: int = 2048) -> Iterator[pd.DataFrame]:
    return (pdf.iloc[at : at + rows] for pdf in batches for at in range(0, len(pdf), rows))


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            d = _distances(np.array(pdf["x"].tolist(), float), pivots)
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell.astype(np.int32), away=d[np.arange(len(d)), cell])

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("cell", IntegerType()), StructField("away", DoubleType())]))


def _knn_in_cells(q: DataFrame, c: DataFrame, nq: int, nc: int, k: int, rules: _Rules, block_rows: int) -> DataFrame:
    # At most 4096 pivots: a proven bound for what is collected and sent.
    taken = c.orderBy(F.xxhash64("id"), "id").select("x").limit(min(4096, math.ceil(nc / max(1, block_rows // 8)))).collect()
    pivots = np.array([r[0] for r in taken], float)
    whole = np.isfinite(pivots).all(axis=1)
    pivots = pivots[whole] if whole.any() else np.zeros_like(pivots[:1])
    same, c = q is c, settled(_with_cell(c, pivots))
    q = c if same else settled(_with_cell(q, pivots))
    radius = np.full(len(pivots), -np.inf)
    for r in c.groupBy("cell").agg(F.max("away")).collect():
        radius[r[0]] = r[1]
    sizes = np.zeros(len(pivots), np.int64)
    for r in q.groupBy("cell").count().collect():
        sizes[r[0]] = r[1]
    dealt = _blocks_of_cells(sizes, pivots, max(1, min(4 * block_rows, math.ceil(nq / 24))))
    spark = q.sparkSession
    homes = F.broadcast(spark.createDataFrame(dealt, "cell int, block int, parts int"))
    own = homes.select("cell", F.explode(F.sequence("block", F.col("block") + F.col("parts") - 1)).alias("block"))
    blocks = max((b + n for _, b, n in dealt), default=1)
    asking = q.join(homes, "cell").withColumn("block", F.col("block") + F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int")).drop("parts")
    asking = asking.withColumns({"js": F.array().cast("array<long>"), "ds": F.array().cast("array<double>")})
    first = settled(_met(asking, c.join(F.broadcast(own), "cell"), blocks, pivots, radius, k, rules))
    others = few(_near_cells(first, pivots, radius, k).distinct().join(F.broadcast(own), ["block", "cell"], "left_anti"), 1 << 20)
    best = _met(first, c.join(others, "cell"), blocks, pivots, radius, k, rules)
    found = best.select(F.col("id").alias("i"), F.posexplode(F.arrays_zip("js", "ds")).alias("at", "of"))
    return found.select("i", F.col("of.js").alias("j"), F.col("of.ds").alias("d"), (F.col("at") + 1).alias("rank"))


def _blocks_of_cells(sizes: np.ndarray, pivots: np.ndarray, rows: int) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks): a cell of more than `rows` queries has blocks of its own, smaller ones join those of the nearest pivots."""
    out, block, left = [], 0, {int(x) for x in np.flatnonzero(sizes)}
    for cell in [int(x) for x in np.argsort(-sizes, kind="stable") if sizes[x]]:
        if cell not in left:
            continue
        if sizes[cell] > rows:
            parts = math.ceil(sizes[cell] / rows)
            out.append((cell, block, parts))
            left.discard(cell)
            block += parts
            continue
        held = 0
        for near in np.argsort(((pivots - pivots[cell]) ** 2).sum(axis=1), kind="stable"):
            if int(near) in left and held + sizes[near] <= rows:
                out.append((int(near), block, 1))
                left.discard(int(near))
                held += sizes[near]
                if 8 * held > 7 * rows:
                    break
        block += 1
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _slack(*points: np.ndarray) -> float:
    """What products may be off, which bounds leave room for."""
    return 1e-6 * (1 + max(float(np.nanmax(np.abs(p), initial=0.0)) for p in points))


def _near_cells(found: DataFrame, pivots: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """(block, cell): the cells that hold candidates and aren't ruled out by the distances found, for some query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            x, cell, away, block = _matrix(batch.column("x")), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "away", "block"))
            full = batch.column("ds").value_lengths().to_numpy(zero_copy_only=False) >= k
            kth = np.full(len(x), np.inf)
            if full.any():
                kth[full] = _matrix(batch.column("ds").filter(pa.array(full)))[:, k - 1]
            for at in range(0, len(x), 256):
                r = slice(at, at + 256)
                r, at_cell = np.nonzero(_may_hold(_distances(x[r], pivots), away[r, None], _distances(pivots[cell[r]], pivots), kth[r, None], radius[None, :], _slack(x[r], pivots)) & (radius > -np.inf)[None, :])
                seen.update(zip(block[at + r].tolist(), at_cell.tolist(), strict=True))
        if seen:
            blocks, cells = zip(*sorted(seen), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(cells, pa.int32())], ["block", "cell"])

    return found.select("block", "cell", "away", "x", "ds").mapInArrow(run, "block int, cell int")


def _may_hold(to: np.ndarray, away: np.ndarray, between: np.ndarray, kth: np.ndarray, radius: np.ndarray, slack: float) -> np.ndarray:
    """Whether a cell can hold a candidate within `kth` of a query: `to` is the query's distance to the cell's pivot, `away` that to its own, `between` that of both pivots. What can't be compared may."""
    with np.errstate(invalid="ignore"):
        return ~(to - radius > kth + slack) & ~(to * to - away * away > 2 * between * (kth + slack) + slack * (1 + to))


class _Asking:
    """The queries of a block, and the nearest candidates of each among those met."""

    def __init__(self, rows: pa.Table, k: int, rules: _Rules, pivots: np.ndarray, radius: np.ndarray):
        rows = rows.combine_chunks()
        self.rows, self.k, self.rules, self.pivots, self.radius = rows, k, rules, pivots, radius
        self.x = _matrix(rows["x"].combine_chunks())
        self.frame = rows.select(["id", *rules.columns()]).to_pandas()
        self.cell, self.away = rows["cell"].to_numpy(), rows["away"].to_numpy()
        self.norms = (self.x * self.x).sum(axis=1)
        self.d, self.j = np.full((len(self.x), k), np.inf), np.full((len(self.x), k), np.iinfo(np.int64).max)
        held = np.arange(k)[None, :] < pc.list_value_length(rows["ds"]).to_numpy()[:, None]
        for name, own in (("ds", self.d), ("js", self.j)):
            own[held] = pc.list_flatten(rows[name]).to_numpy()

    def meet(self, batch: pa.RecordBatch, cell: int, rows: int = 256, pairs: int = 1 << 16) -> None:
        """Products of matrices pick the candidates within the k-th distance; their distances are then taken anew, difference by difference, so that equal vectors tie."""
        pivot = self.pivots[cell]
        between = np.sqrt(((self.pivots - pivot) ** 2).sum(axis=1))[self.cell]
        asks = np.flatnonzero(_may_hold(_distances(self.x, pivot[None, :])[:, 0], self.away, between, self.d[:, -1], self.radius[cell], _slack(self.x, self.pivots)))
        if not len(asks):
            return
        b, frame = _matrix(batch.column("x")), pa.Table.from_batches([batch.select(["id", *self.rules.columns()])]).to_pandas()
        ids, norms = frame["id"].to_numpy(np.int64), (b * b).sum(axis=1)
        most = np.nanmax(norms, initial=0.0)
        grouped = bool(self.rules.same_group or self.rules.other_group)
        for at in range(0, len(asks), rows):
            own = asks[at : at + rows]
            a, mine, kth = self.x[own], self.norms[own], self.d[own, -1]
            rough = a @ (-2 * b.T)
            rough += mine[:, None]
            rough += norms[None, :]
            slack = 1e-9 * (1 + mine + most)
            limit = kth * kth + slack
            if grouped:
                rough[self.rules.ungrouped(self.frame.iloc[own], frame)] = np.inf
            hit = np.flatnonzero(rough <= limit[:, None])
            every = len(hit) > 16 * self.k * len(own)
            if every:
                rough[self.rules.barred(self.frame.iloc[own], frame)] = np.inf
                if len(b) > self.k:
                    limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + slack)
                hit = np.flatnonzero((rough <= limit[:, None]) & np.isfinite(rough))
            r, s = np.divmod(hit, len(b))
            d = np.concatenate([np.sqrt(((a[r[x : x + pairs]] - b[s[x : x + pairs]]) ** 2).sum(axis=1)) for x in range(0, len(r), pairs)] or [np.empty(0)])
            keep = (d <= kth[r]) & np.isfinite(d)
            if not every:
                keep[keep] = ~self.rules.barred(self.frame.iloc[own[r[keep]]], frame.iloc[s[keep]], paired=True)
            r, s, d = r[keep], s[keep], d[keep]
            if len(r):
                touched = np.unique(r)
                at_r, at_d, at_j = np.r_[r, np.repeat(touched, self.k)], np.r_[d, self.d[own[touched]].ravel()], np.r_[ids[s], self.j[own[touched]].ravel()]
                order = np.lexsort((at_j, at_d, at_r))
                order = order[np.arange(len(order)) - np.searchsorted(at_r[order], at_r[order]) < self.k].reshape(len(touched), self.k)
                self.d[own[touched]], self.j[own[touched]] = at_d[order], at_j[order]

    def out(self) -> Iterator[pa.RecordBatch]:
        held = np.isfinite(self.d)
        offsets = pa.array(np.r_[0, np.cumsum(held.sum(axis=1))].astype(np.int32))
        rows = self.rows
        for name, own in (("js", self.j), ("ds", self.d)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.ListArray.from_arrays(offsets, pa.array(own[held])))
        yield from rows.to_batches(max_chunksize=4096)


def _met(asking: DataFrame, candidates: DataFrame, blocks: int, pivots: np.ndarray, radius: np.ndarray, k: int, rules: _Rules) -> DataFrame:
    """`asking` after each block's queries have met its candidates (with cell and block): js and ds hold the k nearest so far. Rows of a block come in order, queries first."""
    names = ["block", "cell", "id", "x", "away", *rules.columns(), "js", "ds"]
    side = lambda df, n: df.select(F.lit(n).alias("side"), *names)
    empty = {"js": F.lit(None).cast("array<long>"), "ds": F.lit(None).cast("array<double>")}
    rows = side(asking, 0).unionByName(side(candidates.withColumns(empty), 1)).repartition(4 * blocks, "block").sortWithinPartitions("block", "side", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, state = None, [], None
        opened = lambda: _Asking(pa.Table.from_batches(waiting), k, rules, pivots, radius)
        for batch in batches:
            if not batch.num_rows:
                continue
            block, part, cell = (batch.column(c).to_numpy() for c in ("block", "side", "cell"))
            turns = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | ((cell[1:] != cell[:-1]) & (part[1:] == 1))])
            for a, b in zip(turns, [*turns[1:], batch.num_rows], strict=True):
                own = batch.slice(int(a), int(b - a)).select(names)
                if block[a] != now:
                    if waiting:
                        yield from (state or opened()).out()
                    now, waiting, state = block[a], [], None
                if part[a] == 0:
                    waiting.append(own)
                elif waiting:
                    state = state or opened()
                    state.meet(own, int(cell[a]))
        if waiting:
            yield from (state or opened()).out()

    return rows.mapInArrow(run, StructType([f for n in names for f in asking.schema.fields if f.name == n]))


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """(i, j, d), i < j: pairs that are in each other's neighbourhoods."""
    neighbours = settled(neighbours.select("i", "j", "d"))  # read twice
    back = neighbours.select(F.col("i").alias("j"), F.col("j").alias("i"))
    return neighbours.where(F.col("i") < F.col("j")).join(back, ["i", "j"], "left_semi").select("i", "j", "d")


def with_ends(pairs: DataFrame, attributes: DataFrame, columns: list[str], key: str = "unit_id") -> DataFrame:
    """Attributes of both ends of each pair, as <column>_i and <column>_j."""
    for end in "ij":
        pairs = pairs.join(attributes.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def pair_distances(pairs: DataFrame, attributes: DataFrame, vectors: dict[str, str], key: str = "unit_id") -> DataFrame:
    """Adds distances between the ends: {name of the distance: array column}."""
    joined = with_ends(pairs, attributes, list(vectors.values()), key)
    for name, c in vectors.items():
        joined = joined.withColumn(name, distance(F.col(f"{c}_i"), F.col(f"{c}_j")))
    return joined.drop(*[f"{c}_{e}" for c in vectors.values() for e in "ij"])


def divergent_rate(pairs: DataFrame, near: str = "d_sc", far: str = "d_h", near_q: float = 0.25, far_q: float = 0.75, near_cut: float | None = None, far_cut: float | None = None) -> DataFrame:
    """One row: the cut-offs and the share of near pairs whose other distance is above its cut-off. Cut-offs are exact quantiles unless
    given."""
    pairs = settled(pairs.select(near, far))  # read for both cut-offs and for the share
    one = pairs.sparkSession.range(1)
    cut = lambda c, q, given, name: exact_quantiles(pairs, c, [q], "_q").select(F.col("_q")[0].alias(name)) if given is None else one.select(F.lit(float(given)).alias(name))
    own = pairs.join(F.broadcast(cut(near, near_q, near_cut, "near_cut"))).join(F.broadcast(cut(far, far_q, far_cut, "far_cut"))).where(F.col(near) <= F.col("near_cut"))
    return own.groupBy("near_cut", "far_cut").agg(F.count(F.lit(1)).alias("n_near"), F.avg((F.col(far) > F.col("far_cut")).cast("double")).alias("divergent_rate"))


def twin_candidates(pairs: DataFrame, attributes: DataFrame, n: int = 50, near: str = "d_sc", far: str = "d_h", near_q: float = 0.25) -> DataFrame:
    """The near pairs that differ most, with a summary line of each end (column `summary`)."""
    cut = exact_quantiles(pairs, near, [near_q], "_cut")
    top = pairs.join(F.broadcast(cut)).where(F.col(near) <= F.col("_cut")[0]).orderBy(F.desc(far), "i", "j").limit(n).drop("_cut")
    return with_ends(top, attributes, ["summary"])


def idw_predict(neighbours: DataFrame, donors: DataFrame, y: str, key: str = "unit_id", eps: float = 1e-9) -> DataFrame:
    """(i, prediction): mean of the donors' values weighted by inverse distance."""
    w = 1.0 / (F.col("d") + eps)
    return neighbours.join(donors.select(F.col(key).alias("j"), F.col(y).alias("_y")), "j").groupBy("i").agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("prediction"))


def neighbour_mean(neighbours: DataFrame, values: DataFrame, column: str, key: str = "unit_id") -> DataFrame:
    return neighbours.join(values.select(F.col(key).alias("j"), F.col(column).alias("_v")), "j").groupBy("i").agg(F.avg("_v").alias("neighbour_mean"))


def nearest(points: DataFrame, places: DataFrame, x: str = "x", key: str = "unit_id") -> DataFrame:
    """The nearest place of each point, ties to the smaller id; points keep their row."""
    return knn(points, places, 1, x, key).select(F.col("i").alias(key), F.col("j").alias("nearest_id"), F.col("d").alias("nearest_d"))


def as_point(*columns: Column) -> Column:
    return F.array(*[c.cast("double") for c in columns])
