"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, on binned features; their sums are one lookup table per feature. Then the pairs
with most to gain get two-way tables the same way. A score is the logistic of an intercept plus one table entry per feature and pair, so
scoring is vectorised bin additions.

Training reads features of a bounded sample of labelled rows (`most_labelled`, those with the smallest key hashes); the model that is sent to
workers is a few tables of fixed size. Everything else runs over whole texts of all rows.

Defined cases: null and empty texts have all-zero features and get the score the model gives those; without labels of both classes every
score is the share of ones (0.5 without labels); a document with several labels counts with each distinct one, and with the smallest of its texts if rows repeat its key; repeated rows score alike; texts of any length are read whole;
of features that split as well the first is taken; empty tables give
empty results; only key and text are read of the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import batches, utf8

#: Byte classes: A upper, a lower (and all beyond ASCII), 0 digit, . sentence end, comma, pipe, s symbol, q quote or bracket, blank, n line end.
_CLASS = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else ord(".") if chr(b) in ".!?" else ord(",") if chr(b) in ",;:" else ord("|") if chr(b) == "|" else ord("n") if b in (10, 13) else ord(" ") if b in (9, 11, 12, 32) else ord("q") if chr(b) in "'\"()-" else ord("s")
    for b in range(256)
)
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "pipe", "stops_per_word", "commas_per_word", "unique_words", "top_word", "top_three", "repeat_next", "lines_per_word", "unique_lines", "top_line", "short_words", "long_words", "title_words", "upper_words",
    "entropy", "beyond_ascii", "symbol_after_word", "double_stops", "ends_with_stop", "words_per_stop", "quotes", "once_words",
)


def features(text: bytes) -> list[float]:
    """Numbers that tell prose from lists, shouting, repetition and noise; all zeros for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(text), len(words)
    kinds = text.translate(_CLASS)
    count = kinds.count
    counts = Counter(words)
    tops = [c for _, c in counts.most_common(3)]
    lengths = np.fromiter(map(len, words), np.int64, w)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = octets[octets > 0] / n
    stops, letters = count(b"."), count(b"A") + count(b"a")
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(lengths.mean()), count(b"A") / max(1, letters), count(b"0") / n, count(b"s") / n, count(b"|") / n, stops / w, count(b",") / w, len(counts) / w, tops[0] / w, sum(tops) / w, sum(map(eq, words, words[1:])) / w, len(lines) / w, len(line_counts) / len(lines), max(line_counts.values()) / len(lines),
        float((lengths <= 3).mean()), float((lengths > 20).mean()), count(b" Aa") / w, count(b"AA") / w,
        float(-(shares * np.log2(shares)).sum()), float(octets[128:].sum()) / n, (count(b"as") + count(b"As")) / w, count(b"..") / w, float(kinds.rstrip(b" n")[-1:] == b"."), w / (stops + 1), count(b"q") / n, sum(c == 1 for c in counts.values()) / w,
    ]


class Gam:
    """Cut points, one table per feature, two-way tables of chosen pairs, and an intercept."""

    def __init__(self, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.15, penalty: float = 1.0, leaves: int = 3):
        self.bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.penalty, self.leaves = bins, rounds, pair_rounds, pairs, rate, penalty, leaves
        self.intercept, self.cuts, self.tables, self.pairs = 0.0, [], np.zeros((0, bins)), []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def _tree(self, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
        """A tree of a few leaves over ordered bins, grown best split first, as steps per bin."""
        g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
        worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + self.penalty)
        parts = [(0, len(gradient))]
        while len(parts) < self.leaves:
            best = (1e-9, None, 0)
            for k, (a, b) in enumerate(parts):
                if b - a > 1:
                    at = np.arange(a + 1, b)
                    gain = worth(a, at) + worth(at, b) - worth(a, b)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), k, int(at[i]))
            if best[1] is None:
                break
            a, b = parts[best[1]]
            parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
        step = np.zeros(len(gradient))
        for a, b in parts:
            step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + self.penalty)
        return step

    def _corner(self, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
        """The best tree that splits both features once: four leaves of a two-way table."""
        pad = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        g, h = pad(gradient), pad(hessian)
        k = len(gradient)
        gain, sums = 0.0, []
        for q in (
            (g[1:k, 1:k], h[1:k, 1:k]),
            (g[1:k, k:] - g[1:k, 1:k], h[1:k, k:] - h[1:k, 1:k]),
            (g[k:, 1:k] - g[1:k, 1:k], h[k:, 1:k] - h[1:k, 1:k]),
            (g[k, k] - g[1:k, k:] - g[k:, 1:k] + g[1:k, 1:k], h[k, k] - h[1:k, k:] - h[k:, 1:k] + h[1:k, 1:k]),
        ):
            gain = gain + q[0] ** 2 / (q[1] + self.penalty)
            sums.append(q[0] / (q[1] + self.penalty))
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        step = np.empty((k, k))
        step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = (s[i, j] for s in sums)
        return step, float(gain[i, j])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        k = self.bins
        share = float(y.mean()) if len(y) else 0.5
        self.intercept = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        if not len(y) or not 0 < share < 1:
            return self
        self.cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, k + 1)[1:-1])) for i in range(x.shape[1])]
        bins = self.binned(x)
        self.tables = np.zeros((x.shape[1], k))
        raw = np.full(len(y), self.intercept)
        slopes = lambda: (lambda p: (y - p, np.maximum(p * (1 - p), 1e-6)))(1 / (1 + np.exp(-raw)))
        for _ in range(self.rounds):
            for i in range(x.shape[1]):
                gradient, hessian = slopes()
                step = self.rate * self._tree(np.bincount(bins[:, i], gradient, k), np.bincount(bins[:, i], hessian, k))
                self.tables[i] += step
                raw += step[bins[:, i]]
        gradient, hessian = slopes()
        flat = lambda i, j: bins[:, i] * k + bins[:, j]
        grid = lambda i, j, v: np.bincount(flat(i, j), v, k * k).reshape(k, k)
        gains = sorted(((self._corner(grid(i, j, gradient), grid(i, j, hessian))[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
        self.pairs = [(i, j, np.zeros((k, k))) for _, i, j in gains[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, table in self.pairs:
                gradient, hessian = slopes()
                step = self.rate * self._corner(grid(i, j, gradient), grid(i, j, hessian))[0]
                table += step
                raw += step[bins[:, i], bins[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.intercept)
        if self.cuts:
            bins = self.binned(x)
            for i, table in enumerate(self.tables):
                raw += table[bins[:, i]]
            for i, j, table in self.pairs:
                raw += table[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-raw))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def _mapped(docs: DataFrame, key: str, text: str, put: Callable[[np.ndarray], list[pa.Array]], kind: str, names: list[str]) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text):
            x = np.array([features(t) for t in utf8(batch.column(text))], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != text] + put(x), names=[key, *names])

    return docs.mapInArrow(run, f"{key} long, {kind}")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, most_labelled: int = 20_000, **settings) -> Gam:
    """Fits on labelled rows outside the held-out fold: at most `most_labelled`, the ones with the smallest hash of the key."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(F.col(key).cast("long"), folds) != 0)).select(F.col(key).cast("long").alias("_k"), F.col(label).cast("int").alias("_y")).distinct()
    sample = known.orderBy(F.xxhash64("_k"), "_k", "_y").limit(most_labelled)
    # At most `most_labelled` rows of two numbers: a proven bound for the broadcast, and for what is collected.
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_text")).join(F.broadcast(sample.groupBy("_k").agg(F.collect_set("_y").alias("_y"))), "_k").groupBy("_k").agg(F.min("_text").alias("_text"))
    marked = _mapped(rows, "_k", "_text", lambda x: [pa.array(list(x), pa.list_(pa.float64()))], "x array<double>", ["x"])
    fitted = marked.join(F.broadcast(sample), "_k").select("_k", "_y", "x").toPandas().sort_values(["_k", "_y"])
    return Gam(**settings).fit(np.array(fitted["x"].tolist(), float).reshape(len(fitted), len(FEATURES)), fitted["_y"].to_numpy(float))


def scored(docs: DataFrame, model: Gam, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs.select(F.col(key).cast("long").alias(key), text), key, text, lambda x: [pa.array(sent.value.score(x))], "score double", ["score"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(docs, train(docs, labels, folds=folds, **settings))
    return rows.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model: Gam, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `docs`, in all their columns, that score `threshold` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text):
            x = np.array([features(t) for t in utf8(batch.column(text))], float).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(sent.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
