"""Random forests with several outputs, leaves of a least size and no limit of depth, predicted out of fold.

Trees differ in which rows and features they look at, so rows that travelled with their trees would be copied for each of them. As long as all rows take few bytes, tasks
are therefore given trees, not rows: each gets the rows once, in packed columns, and grows its trees to the leaves; only its sums of predictions are shuffled. Beyond that, trees
are rows of data: nodes are split level by level by histograms that Spark adds up, until the rows of a node take few bytes, meet in one task and are split there.

Both ways give the same trees. Nodes with many rows take the cut of least squared error over all outputs among the bins' edges, others among all cuts between values. A task splits all nodes of
a level together. Rows of the held-out fold are in no sample, so a tree's predictions are where its leaves are, and no model reaches the driver.

Bootstrap weights and the features a node looks at are hashes of key, tree and node, so retries and other layouts give the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

from panelforge.operators.ordering import exact_quantiles, few, settled

#: Shares of draws with at most 0, 1, ... 7 copies of a row, by the Poisson law of mean one; more count as 8.
_COPIES = np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7]))
_ROOT = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits of the argument."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def copies(hashes: np.ndarray, model: int, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample."""
    own = mixed(mixed(np.uint64(seed * 1_000_003 + model)) ^ np.uint64(tree))
    uniform = (mixed(hashes.astype(np.int64).view(np.uint64) ^ own) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(_COPIES, uniform, side="right").astype(float)


def child(path: np.ndarray | np.uint64, right: np.ndarray | bool) -> np.ndarray:
    """The name of a node's child."""
    return mixed(np.asarray(path, np.uint64) * np.uint64(2) + np.asarray(right).astype(np.uint64))


def features_of(path: np.uint64, model: int, tree: int, width: int, seed: int) -> np.ndarray:
    """All features in the order in which a node looks at them."""
    own = mixed(np.uint64(seed * 1_000_003 + model)) ^ mixed(np.uint64(tree)) ^ np.uint64(path)
    return np.argsort(mixed(own ^ mixed(np.arange(width, dtype=np.uint64))), kind="stable")


def between(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Thresholds halfway; the lower value where no number lies between, since the half would round to the upper one and leave a side without rows."""
    half = (lower + upper) / 2
    return np.where(half < upper, half, lower)


def best_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """(gain, feature, threshold) of the cut that lowers the weighted squared error of all outputs most, over all cuts between values that leave `least` rows on both sides; the smaller
    feature, then the smaller threshold, where several do. None without such a cut."""
    features = np.sort(features)
    own = x[:, features]
    order = np.argsort(own, axis=0, kind="stable")
    values = np.take_along_axis(own, order, 0)
    wy = w[:, None] * y
    left_w, left_s = np.cumsum(w[order], axis=0)[:-1], np.cumsum(wy[order], axis=0)[:-1]
    all_w, all_s = w.sum(), wy.sum(axis=0)
    rank = np.arange(1, len(x))[:, None]
    fit = (values[1:] > values[:-1]) & (rank >= least) & (len(x) - rank >= least)
    if not fit.any():
        return None
    gain = (left_s**2).sum(axis=2) / left_w + ((all_s - left_s) ** 2).sum(axis=2) / (all_w - left_w) - (all_s**2).sum() / all_w
    gain = np.where(fit, gain, -np.inf)
    # Gains that rounding alone tells apart are ties.
    top = gain.max()
    at = np.flatnonzero((gain >= top - 1e-12 * max(1.0, abs(top))).T.ravel())[0]
    f, i = divmod(int(at), len(x) - 1)
    return float(top), int(features[f]), float(between(values[i, f], values[i + 1, f]))


def ranked(x: np.ndarray) -> np.ndarray:
    """Features x rows: the place of each value among the feature's distinct values."""
    return np.stack([np.unique(column, return_inverse=True)[1].astype(np.int32) for column in x.T]) if x.size else np.zeros(x.T.shape, np.int32)


def best_cuts(x: np.ndarray, wy: np.ndarray, w: np.ndarray, at: np.ndarray, n: np.ndarray, features: np.ndarray, least: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`best_cut` for several nodes at once: gains (-inf without a cut), features and thresholds. `at`: nodes x the rows of the largest, filled up with the last row of the arrays, which has a weight
    of zero and stands above all others; `n`: rows of each node; `features`: nodes x features, ascending; `ranks`: `ranked` values, if they are known."""
    ranks = ranked(x) if ranks is None else ranks
    # Ranks and places in one number: sorting these is a stable sort that brings the places along.
    order = ranks.ravel().take(features[:, :, None] * ranks.shape[1] + at[:, None, :]).astype(np.int64)
    order <<= 32
    order |= np.arange(at.shape[1])
    order.sort(axis=2)
    high = order >> 32
    rank = np.arange(1, at.shape[1])
    fit = (high[:, :, 1:] != high[:, :, :-1]) & ((rank >= least) & (n[:, None] - rank >= least))[:, None, :]
    order &= 0xFFFFFFFF
    order += (np.arange(len(at)) * at.shape[1])[:, None, None]
    own_w = w.take(at)
    left_w, all_w = np.cumsum(own_w.ravel().take(order), axis=2)[:, :, :-1], own_w.sum(axis=1)
    gain, whole = np.zeros(order.shape), np.zeros(len(at))
    for own in wy:
        # Sums of differences from the node's mean: those of both sides cancel, so one square tells the gain.
        here = own.take(at)
        every = np.add.reduce(here.T, axis=0)
        here -= own_w * (every / all_w)[:, None]
        left = here.ravel().take(order)
        np.cumsum(left, axis=2, out=left)
        left *= left
        gain += left
        whole += every**2
    gain = gain[:, :, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain *= all_w[:, None, None] / (left_w * (all_w[:, None, None] - left_w))
    # What rounding leaves of a node of equal outputs is no gain.
    gain[gain <= 1e-28 * (whole / all_w)[:, None, None]] = 0
    gain = np.where(fit, gain, -np.inf).reshape(len(at), -1)
    top = gain.max(axis=1)
    with np.errstate(invalid="ignore"):
        f, i = np.divmod(np.argmax(gain >= (top - 1e-12 * np.maximum(1.0, np.abs(top)))[:, None], axis=1), at.shape[1] - 1)
    g = np.arange(len(at))
    chosen, lower, upper = features[g, f], at.ravel()[order[g, f, i]], at.ravel()[order[g, f, i + 1]]
    return top, chosen, between(x[lower, chosen].astype(float), x[upper, chosen].astype(float))


def binned_cut(table: np.ndarray, edges: Sequence[np.ndarray], order: np.ndarray, look: int, least: int) -> tuple[float, int, float] | None:
    """(gain, feature, threshold) of the best cut at the bins' edges, None without one. `table`: features x bins x [rows, weight, weighted outputs]."""
    total, best = table[0].sum(axis=0), None
    for some in (order[:look], order[look:]):
        if best is not None:
            break
        for f in np.sort(some):
            left = np.cumsum(table[f], axis=0)[: len(edges[f])]
            rest = total - left
            fit = (left[:, 0] >= least) & (rest[:, 0] >= least)
            if not fit.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (left[:, 2:] ** 2).sum(axis=1) / left[:, 1] + (rest[:, 2:] ** 2).sum(axis=1) / rest[:, 1] - (total[2:] ** 2).sum() / total[1]
            i = int(np.argmax(np.where(fit, gain, -np.inf)))
            if best is None or gain[i] > best[0] * (1 + 1e-12):
                best = (float(gain[i]), int(f), float(edges[f][i]))
    return best


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Rows x features: the number of edges below each value."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)


def histogram(bins: np.ndarray, sums: np.ndarray, most: int) -> np.ndarray:
    """Features x bins x columns: `sums` (rows x columns) added up by feature and bin."""
    return np.stack([np.column_stack([np.bincount(b, c, most) for c in sums.T]) for b in bins.T])


def grown(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, path: np.uint64, model: int, tree: int, seed: int, least: int, look: int, deepest: int | None = None, depth: int = 0,
    asked: np.ndarray | None = None, edges: Sequence[np.ndarray] | None = None, local_rows: int = 4096, bins: np.ndarray | None = None, cells: int = 1 << 16, ranks: np.ndarray | None = None,
) -> np.ndarray:
    """Predictions (rows x outputs) of the subtree over these rows, of all or of those `asked` for (their places); rows of weight zero are predicted and nothing else.

    All nodes of a level are split together, those of like sizes in one array of about `cells` values. With `edges`, nodes of more than `local_rows` rows are cut at these only; `bins` (features x
    rows) and `ranks` are the rows' bins and `ranked` values, if they are known.
    """
    out, width = np.full(y.shape, np.nan), x.shape[1]
    asked = np.arange(len(x)) if asked is None else asked
    rows = np.flatnonzero(w > 0)
    if not len(rows):
        return out
    # The last row fills up nodes that are smaller than others.
    own_x, own_w = np.vstack([x[rows], np.full((1, width), np.inf, x.dtype)]), np.append(w[rows], 0.0)
    # Only the order counts, so ranks among more rows serve as well.
    ranks = np.ascontiguousarray(np.hstack([ranked(x[rows]) if ranks is None else ranks[:, rows], np.full((width, 1), np.iinfo(np.int32).max, np.int32)]))
    own_y = np.vstack([y[rows], np.zeros(y.shape[1])])
    wy = np.ascontiguousarray((own_w[:, None] * own_y).T)
    if edges is not None and bins is None and len(rows) > local_rows:
        bins = binned(x, edges).T
    most = max((len(e) for e in edges), default=0) + 1 if edges is not None else 0
    # Rows in the order of their nodes; the node of each row asked for.
    rows_at, starts, paths, of, level = np.arange(len(rows)), np.array([0, len(rows)]), np.array([path], np.uint64), np.zeros(len(asked), np.int64), depth
    looks = mixed(np.arange(width, dtype=np.uint64))
    while len(paths):
        n = np.diff(starts)
        feature, cut = np.full(len(n), -1), np.zeros(len(n))
        open_ = np.flatnonzero(n >= 2 * least) if deepest is None or level < deepest else np.empty(0, np.int64)
        if len(open_):
            own = mixed(np.uint64(seed * 1_000_003 + model)) ^ mixed(np.uint64(tree)) ^ paths[open_]
            order = np.argsort(mixed(own[:, None] ^ looks[None, :]), axis=1, kind="stable")
            large = (n[open_] > local_rows) if edges is not None else np.zeros(len(open_), bool)
            for g, some in zip(open_[large], order[large], strict=True):
                at = rows_at[starts[g] : starts[g + 1]]
                sums = np.column_stack([np.ones(len(at)), own_w[at], wy[:, at].T])
                found = None
                for span in (slice(look), slice(look, None)):
                    features = np.sort(some[span])
                    if found is None and len(features):
                        table = histogram(bins[features[:, None], rows[at]].T, sums, most)
                        found = binned_cut(table, [edges[f] for f in features], np.arange(len(features)), len(features), least)
                        found = found and (found[0], int(features[found[1]]), found[2])
                if found is not None and found[0] > 0:
                    feature[g], cut[g] = found[1:]
            todo, order = open_[~large], order[~large]
            for span in (slice(look), slice(look, None)):
                some = np.sort(order[:, span], axis=1)
                if not some.size:
                    break
                missed = np.zeros(len(todo), bool)
                sizes = np.ceil(2 * np.log2(n[todo])).astype(int)
                by_size = np.argsort(sizes, kind="stable")
                for group in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1):
                    longest = int(n[todo[group]].max())
                    step = max(1, cells // (longest * some.shape[1]))
                    for a in range(0, len(group), step):
                        pick = group[a : a + step]
                        g, place = todo[pick], np.arange(longest)
                        inside = place < n[g][:, None]
                        at = np.where(inside, rows_at[np.minimum(starts[g][:, None] + place, len(rows_at) - 1)], len(rows))
                        gain, f, c = best_cuts(own_x, wy, own_w, at, n[g], some[pick], least, ranks)
                        hit = gain > 0
                        feature[g[hit]], cut[g[hit]] = f[hit], c[hit]
                        missed[pick] = gain == -np.inf
                # Nodes that can't be cut at these features look at the others.
                todo, order = todo[missed], order[missed]
        node = np.repeat(np.arange(len(n)), n)
        leaf = feature < 0
        held = leaf[of]
        if held.any():
            means = np.add.reduceat(wy[:, rows_at], starts[:-1], axis=1) / np.add.reduceat(own_w[rows_at], starts[:-1])
            out[asked[held]] = means.T[of[held]]
        asked, of = asked[~held], of[~held]
        # Children of node k are 2 k and 2 k + 1 among the nodes that are cut.
        number = np.cumsum(~leaf) - 1
        keep = ~leaf[node]
        rows_at, node = rows_at[keep], node[keep]
        to = 2 * number[node] + (own_x[rows_at, feature[node]] > cut[node])
        order = np.argsort(to, kind="stable")
        rows_at = rows_at[order]
        of = 2 * number[of] + (x[asked, feature[of]] > cut[of])
        split = paths[~leaf]
        starts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=2 * len(split)))])
        paths = np.stack([child(split, False), child(split, True)], axis=1).ravel()
        level += 1
        if not len(asked):
            break
    return out


def forest_oof(
    df: DataFrame, x: str, width: int, ys: Sequence[str], fold: str = "fold", key: str = "unit_id", trees: int = 500, least_leaf: int = 5, share: float = 0.5,
    depth: int | None = None, seed: int = 7, local_rows: int = 4096, together: int = 20, bins: int = 64, task_bytes: int = 1 << 26,
) -> DataFrame:
    """Adds `pred_<y>` for every output: the mean over trees that were grown on the other folds. A split looks at `share` of the features; at the rest where none of these can be cut.
    Missing features count as zero.

    Nodes of more than `local_rows` rows are cut at up to `bins` quantiles. Up to `task_bytes` of rows, a task gets them all and grows `together` trees of one model at a time. Beyond that, trees are
    rows of data until a node's rows take no more than that.
    """
    outs = [f"pred_{y}" for y in ys]
    folds = [r[0] for r in few_values(df, fold)]
    names = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(folds)], f"_f {dict(df.dtypes)[fold]}, _own int") if folds else None
    if names is None:
        return df.withColumns({o: F.lit(None).cast("double") for o in outs})
    features = F.array(*[F.coalesce(F.nanvl(F.try_element_at(x, F.lit(i + 1)).cast("double"), F.lit(0.0)), F.lit(0.0)) for i in range(width)])
    rows = df.where(F.col(fold).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(key).alias("_h"), F.col(fold).alias("_f"), features.alias("_x"), F.array(*[F.col(y).cast("double") for y in ys]).alias("_y"))
    # Values that 32 bits hold are written and sent in these.
    held = rows.where(F.exists("_x", lambda v: (v.cast("float").cast("double") != v) | (F.abs(v) == float("inf")))).isEmpty()
    rows = rows.withColumn("_x", F.col("_x").cast("array<float>")) if held else rows
    rows = settled(rows.join(F.broadcast(names), "_f").drop("_f"))
    look, n, size = max(1, int(np.ceil(share * width))), rows.count(), (4 if held else 8) * width + 8 * (len(ys) + 4)
    most = max(local_rows, task_bytes // size)
    if n <= most:
        found = _grown_by_tasks(rows, width, len(ys), len(folds), trees, least_leaf, look, depth, seed, local_rows, together, bins if n > local_rows else 0)
    else:
        edges = None
        if n > local_rows:
            # One row per feature reaches the driver.
            values = rows.select(F.posexplode("_x").alias("_at", "_v"))
            cuts = {r["_at"]: np.unique(r["q"]) for r in exact_quantiles(values, "_v", [i / bins for i in range(1, bins)], "q", ["_at"]).collect()}
            edges = [cuts.get(f, np.empty(0)) for f in range(width)]
        rows = rows.withColumn("_x", F.col("_x").cast("array<double>"))
        found = _grown_by_levels(rows, width, len(ys), len(folds), trees, least_leaf, look, depth, seed, local_rows, edges, most)
    mean = found.groupBy("_key").agg(*[(F.sum(F.col("_p")[i]) / trees).alias(o) for i, o in enumerate(outs)])
    return df.join(mean.withColumnRenamed("_key", key), key, "left")


def _packed_rows(rows: DataFrame) -> DataFrame:
    """Rows in packed columns, a row per batch: keys, hashes, models, features and outputs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("_keys", ArrayType(rows.schema["_key"].dataType)), *(StructField(c, BinaryType()) for c in ("_hs", "_owns", "_xs", "_ys"))])
    kind = to_arrow_schema(schema).field("_keys").type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_x", "_y"))
                made = [batch.column("_h").to_numpy().tobytes(), batch.column("_own").to_numpy().astype(np.int32).tobytes(), np.nan_to_num(x).tobytes(), y.astype(float).tobytes()]
                keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("_key")).cast(kind)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([m], pa.binary()) for m in made)], names=schema.names)

    return rows.select("_key", "_h", "_own", "_x", "_y").mapInArrow(pack, schema)


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature its distinct exact quantiles, interpolated linearly: the cuts of nodes with many rows."""
    out = []
    for column in x.T:
        values, at = np.sort(column).astype(float), [(len(column) - 1) * (i / bins) for i in range(1, bins)]
        out.append(np.unique([(np.ceil(p) - p) * values[int(np.floor(p))] + (p - np.floor(p)) * values[int(np.ceil(p))] if np.floor(p) != np.ceil(p) else values[int(p)] for p in at]))
    return out


def _grown_by_tasks(
    rows: DataFrame, width: int, outputs: int, models: int, trees: int, least: int, look: int, deepest: int | None, seed: int, local_rows: int, together: int, bins: int
) -> DataFrame:
    """(_key, _p): sums of predictions of held-out rows. The rows take few bytes, as counted; each task gets them once, in packed columns, for all trees it grows, and finds the quantiles itself."""
    spark, schema = rows.sparkSession, StructType([StructField("_key", rows.schema["_key"].dataType), StructField("_p", ArrayType(DoubleType()))])
    kind_of = {"_hs": np.int64, "_owns": np.int32, "_xs": np.float32 if dict(rows.dtypes)["_x"] == "array<float>" else np.float64, "_ys": np.float64}
    # A task's trees are of few models, so it sums up predictions of few rows.
    batches = [(model, first) for model in range(models) for first in range(0, trees, together)]
    tasks = min(len(batches), 4 * spark.sparkContext.defaultParallelism)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, keys, parts = None, [], {c: [] for c in kind_of}
        for batch in arrow:
            for i in range(batch.num_rows):
                task = int(batch.column("_task")[i].as_py())
                keys.append(batch.column("_keys")[i].values)
                for c, own in parts.items():
                    own.append(np.frombuffer(batch.column(c)[i].as_py(), kind_of[c]))
        if task is None:
            return
        h, own, x, y = (np.concatenate(parts.pop(c)) for c in kind_of)
        x, y = x.reshape(-1, width), y.reshape(-1, outputs)
        # Rows of repeated keys are told apart by their values.
        order = np.lexsort((*y.T, x[:, 0], own, h))
        keys = pa.concat_arrays(keys).take(pa.array(order))
        h, own, x, y = h[order], own[order], x[order], y[order]
        edges = quantile_edges(x, bins) if bins else None
        ranks = ranked(x)
        # Bins in a byte or two, features first.
        at = np.stack([np.searchsorted(e, x[:, f], side="left").astype(np.int16) for f, e in enumerate(edges)]) if edges is not None else None
        total, before = None, None
        for model, first in batches[task * len(batches) // tasks : (task + 1) * len(batches) // tasks]:
            if model != before:
                if total is not None:
                    yield answered(keys, test, total)
                test = np.flatnonzero(own == model)
                total, before = np.zeros((len(test), outputs)), model
            for tree in range(first, min(trees, first + together)):
                w = np.where(own == model, 0.0, copies(h, model, tree, seed))
                total += grown(x, y, w, _ROOT, model, tree, seed, least, look, deepest, asked=test, edges=edges, local_rows=local_rows, bins=at, ranks=ranks)[test]
        if total is not None:
            yield answered(keys, test, total)

    def answered(keys: pa.Array, test: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(0, total.size + 1, outputs, dtype=np.int32)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(test)), pa.ListArray.from_arrays(ends, total.ravel()).cast(kinds.field("_p").type)], names=["_key", "_p"])

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    # One row per partition: every task has its own trees.
    asked = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("_task"))
    return asked.join(F.broadcast(_packed_rows(rows))).mapInArrow(run, schema)


def binned_tree(bins: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, model: int, tree: int, seed: int, least: int, look: int, depth: int, most: int) -> np.ndarray:
    """Predictions for the rows `asked` for, of one tree of at most `depth` levels of cuts. `bins`: features x rows, each below `most`; a node takes the cut between bins of least squared error
    among `look` features that leaves a weight of `least` on both sides. All nodes of a level are cut together."""
    rows, out, looks = np.flatnonzero(w > 0), np.full(len(asked), np.nan), mixed(np.arange(len(bins), dtype=np.uint64))
    if not len(rows):
        return out
    own, of, node, at = bins[:, rows], w[rows], np.zeros(len(rows), np.int64), np.zeros(len(asked), np.int64)
    sums, paths, places = of * y[rows], np.array([_ROOT], np.uint64), np.arange(len(asked))
    for level in range(depth + 1):
        k = len(paths)
        all_w, all_s = np.bincount(node, of, k), np.bincount(node, sums, k)
        whole = all_s**2 / all_w
        best, feature, cut = 1e-12 * whole, np.full(k, -1), np.zeros(k, np.int64)
        hashes = mixed(np.uint64(seed * 1_000_003 + model)) ^ mixed(np.uint64(tree)) ^ paths
        order = np.argsort(mixed(hashes[:, None] ^ looks[None, :]), axis=1, kind="stable")[:, :look]
        seen = np.zeros((k, len(bins)), bool)
        np.put_along_axis(seen, order, True, axis=1)
        seen &= ((all_w >= 2 * least) & (level < depth))[:, None]
        for f in np.flatnonzero(seen.any(axis=0)):
            cells = node * most + own[f]
            left_w, left_s = (np.cumsum(np.bincount(cells, c, k * most).reshape(k, most), axis=1)[:, :-1] for c in (of, sums))
            right_w = all_w[:, None] - left_w
            fit = (left_w >= least) & (right_w >= least) & seen[:, f, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fit, left_s**2 / left_w + (all_s[:, None] - left_s) ** 2 / right_w - whole[:, None], -np.inf)
            i = np.argmax(gain, axis=1)
            gain = gain[np.arange(k), i]
            better = gain > best * (1 + 1e-12)
            best[better], feature[better], cut[better] = gain[better], f, i[better]
        leaf = feature < 0
        held = leaf[at]
        out[places[held]] = (all_s / all_w)[at[held]]
        if leaf.all():
            break
        number, keep = np.cumsum(~leaf) - 1, ~leaf[node]
        if not keep.all():
            own, of, sums, node = own[:, keep], of[keep], sums[keep], node[keep]
        places, at = places[~held], at[~held]
        node = 2 * number[node] + (own[feature[node], np.arange(len(node))] > cut[node])
        at = 2 * number[at] + (bins[feature[at], asked[places]] > cut[at])
        paths = np.stack([child(paths[~leaf], False), child(paths[~leaf], True)], axis=1).ravel()
    return out


def binned_oof(rows: DataFrame, width: int, models: int, trees: int, least: int, look: int, depth: int, seed: int, together: int = 10, bins: int = 32) -> DataFrame:
    """(_row, _p): predictions of forests of `trees` trees on the rows of other models, cut at up to `bins` quantiles of each feature.

    `rows`, settled: _row, _h (hash that draws), _own (the model that doesn't learn from the row), _x (`width` values) and _y, NULL where the row is only predicted. Their bins are a byte per value,
    packed by batches; each task gets them once and grows `together` trees of a model at a time, so only sums of predictions are shuffled.
    """
    # One row per feature reaches the driver.
    values = rows.select(F.posexplode("_x").alias("_at", "_v"))
    cuts = {r["_at"]: np.unique(r["q"]) for r in exact_quantiles(values, "_v", [i / bins for i in range(1, bins)], "q", ["_at"]).collect()}
    edges = [cuts.get(f, np.empty(0)) for f in range(width)]
    kinds = {"_row": np.int64, "_h": np.int64, "_own": np.int32, "_y": np.float64}

    def pack(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                own = binned(np.array(pdf["_x"].tolist(), float), edges).astype(np.uint8)
                yield pd.DataFrame({c: [pdf[c].to_numpy(kind, na_value=np.nan).tobytes() if c == "_y" else pdf[c].to_numpy(kind).tobytes()] for c, kind in kinds.items()} | {"_bins": [own.tobytes()]})

    packed = rows.select(*kinds, "_x").mapInPandas(pack, ", ".join(f"{c} binary" for c in (*kinds, "_bins")))
    batches = [(model, first) for first in range(0, trees, together) for model in range(models)]
    spark = rows.sparkSession
    tasks = min(len(batches), 4 * spark.sparkContext.defaultParallelism)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts = None, {c: [] for c in (*kinds, "_bins")}
        for batch in arrow:
            for i in range(batch.num_rows):
                task = batch.column("_task")[i].as_py()
                for c, own in parts.items():
                    own.append(np.frombuffer(batch.column(c)[i].as_py(), kinds.get(c, np.uint8)))
        if task is None:
            return
        row, h, own, y = (np.concatenate(parts[c]) for c in kinds)
        order = np.lexsort((row, h))
        row, h, own, y = row[order], h[order], own[order], y[order]
        matrix = np.ascontiguousarray(np.concatenate(parts.pop("_bins")).reshape(-1, width)[order].T)
        for model, first in batches[task::tasks]:
            test = np.flatnonzero(own == model)
            total = np.zeros(len(test))
            for tree in range(first, min(trees, first + together)):
                w = np.where((own == model) | np.isnan(y), 0.0, copies(h, model, tree, seed))
                total += binned_tree(matrix, y, w, test, model, tree, seed, least, look, depth, bins)
            yield pa.RecordBatch.from_arrays([pa.array(row[test]), pa.array(total)], names=["_row", "_p"])

    # One row per partition: every task has its own trees.
    found = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("_task")).join(F.broadcast(packed)).mapInArrow(run, "_row long, _p double")
    return found.groupBy("_row").agg((F.sum("_p") / trees).alias("_p"))


def few_values(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The distinct values of a column, in order: each is a model, so more than `most` are refused."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}")
    return sorted(found)


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {
        "key": pdf["_key"].to_numpy(), "h": pdf["_h"].to_numpy(np.int64), "own": pdf["_own"].to_numpy(), "x": np.nan_to_num(np.array(pdf["_x"].tolist(), float)), "y": np.array(pdf["_y"].tolist(), float)
    }


_STATE = "_model int, _tree int, _node long, _depth int, _w double, _key {kind}, _h long, _own int, _x array<double>, _y array<double>"
_NODE = ["_model", "_tree", "_node"]


def _grown_by_levels(rows: DataFrame, width: int, outputs: int, models: int, trees: int, least: int, look: int, deepest: int | None, seed: int, local_rows: int, edges: list[np.ndarray], most: int) -> DataFrame:
    """(_key, _p): each tree's prediction of each held-out row. Nodes of more than `most` rows of positive weight are split by histograms of all tasks, the rest where their rows meet."""
    kind = dict(rows.dtypes)["_key"]

    def dealt(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for model in range(models):
                for tree in range(trees):
                    w = np.where(pdf["_own"] == model, 0.0, copies(pdf["_h"].to_numpy(np.int64), model, tree, seed))
                    own = pdf[(w > 0) | (pdf["_own"] == model)]
                    yield own.assign(_model=model, _tree=tree, _node=np.int64(1), _depth=0, _w=w[own.index - pdf.index[0]])[[c.split()[0] for c in _STATE.split(", ")]]

    state = settled(rows.mapInPandas(dealt, _STATE.format(kind=kind)))
    done: list[DataFrame] = []
    # Rows of nodes that are large; a level halves most of them. Levels are bounded by the rows of the largest node, since each cut takes away `least` rows.
    while True:
        sizes = state.groupBy(*_NODE, "_depth").agg(F.count_if(F.col("_w") > 0).alias("_n"))
        large = settled(sizes.where(F.col("_n") > most))
        if large.isEmpty():
            break
        mine = state.join(few(large.select(*_NODE)), _NODE)
        done.append(state.join(few(large.select(*_NODE)), _NODE, "left_anti"))
        split = settled(_histogram_cuts(mine, large, edges, width, outputs, least, look, deepest, seed))
        leaves = split.where("_feature < 0").select(*_NODE, "_mean")
        done_leaf = mine.join(few(leaves), _NODE).where("_own = _model").select("_key", F.col("_mean").alias("_p"))
        done.append(done_leaf)
        moved = mine.join(few(split.where("_feature >= 0").select(*_NODE, "_feature", "_cut", "_left", "_right")), _NODE)
        right = F.element_at("_x", F.col("_feature") + 1) > F.col("_cut")
        state = settled(moved.withColumn("_node", F.when(right, F.col("_right")).otherwise(F.col("_left"))).withColumn("_depth", F.col("_depth") + 1).select([c.split()[0] for c in _STATE.split(", ")]))
    done.append(state)

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable")
        data, w = _arrays(pdf), pdf["_w"].to_numpy(float)
        model, tree, node, at = (pdf[c].iloc[0] for c in ("_model", "_tree", "_node", "_depth"))
        test = data["own"] == model
        if not test.any():
            return pd.DataFrame({"_key": [], "_p": []})
        held = np.flatnonzero(test)
        p = grown(data["x"], data["y"], w, np.uint64(np.int64(node).view(np.uint64)), int(model), int(tree), seed, least, look, deepest, int(at), asked=held, edges=edges, local_rows=local_rows)
        return pd.DataFrame({"_key": data["key"][held], "_p": list(p[held])})

    out = None
    for part in done:
        own = part if "_p" in part.columns else part.groupBy(*_NODE).applyInPandas(rest, f"_key {kind}, _p array<double>")
        out = own if out is None else out.unionByName(own)
    return out


def _histogram_cuts(mine: DataFrame, large: DataFrame, edges: list[np.ndarray], width: int, outputs: int, least: int, look: int, deepest: int | None, seed: int) -> DataFrame:
    """(_model, _tree, _node, _feature, _cut, _left, _right, _mean): the best cut of each node at the bins' edges; feature -1 and the mean where there is none."""
    most = max((len(e) for e in edges), default=0) + 1
    columns = 2 + outputs

    def added(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            pdf = pdf[pdf["_w"] > 0]
            if not len(pdf):
                continue
            own = binned(np.nan_to_num(np.array(pdf["_x"].tolist(), float)), edges)
            w = pdf["_w"].to_numpy(float)
            sums = np.column_stack([np.ones(len(w)), w, w[:, None] * np.array(pdf["_y"].tolist(), float)])
            for (model, tree, node), at in pdf.groupby(_NODE, sort=False).indices.items():
                table = histogram(own[at], sums[at], most).reshape(-1, columns)
                full = np.flatnonzero(table[:, 0])
                yield pd.DataFrame({"_model": model, "_tree": tree, "_node": node, "_cell": full, "_s": list(table[full])})

    arrays = mine.select(*_NODE, "_w", "_x", "_y").mapInPandas(added, "_model int, _tree int, _node long, _cell int, _s array<double>")
    cells = arrays.groupBy(*_NODE, "_cell").agg(F.array(*[F.sum(F.col("_s")[c]) for c in range(columns)]).alias("_s"))

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        model, tree, node, level = (pdf[c].iloc[0] for c in (*_NODE, "_depth"))
        table = np.zeros((width * most, columns))
        table[pdf["_cell"].to_numpy()] = np.array(pdf["_s"].tolist(), float)
        table = table.reshape(width, most, columns)
        total = table[0].sum(axis=0)
        path = np.uint64(np.int64(node).view(np.uint64))
        best = binned_cut(table, edges, features_of(path, int(model), int(tree), width, seed), look, least) if deepest is None or level < deepest else None
        mean = (total[2:] / total[1]).tolist()
        name = lambda right: int(child(path, right).astype(np.int64))
        row = (-1, 0.0, 0, 0) if best is None or best[0] <= 0 else (best[1], best[2], name(False), name(True))
        return pd.DataFrame([(model, tree, node, *row, mean)], columns=[*_NODE, "_feature", "_cut", "_left", "_right", "_mean"])

    known = cells.join(few(large.select(*_NODE, "_depth")), _NODE)
    return known.groupBy(*_NODE).applyInPandas(chosen, "_model int, _tree int, _node long, _feature int, _cut double, _left long, _right long, _mean array<double>")
