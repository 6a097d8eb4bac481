"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

A model file is compiled into: a normaliser (blanks to the word mark, a leading mark), an acceptor of the pieces with weights, and byte fallback for
characters without a piece. An input is composed with it into a lattice, and the encoding is the shortest path in the tropical semiring.

For unigram models the weight of a piece is minus its score. For BPE models a bigram acceptor weighs each pair of neighbouring pieces: zero if the
merges would keep them apart, infinite if they would join across the border. The merges' result is the one path of finite
weight, so shortest paths give BPE exactly. No piece has the word mark after another character, so the lattice falls apart at word starts:
each distinct word's path is found once and kept in a bounded table. Short words are solved together in arrays, long ones one by one, in time linear in their length.

Defined cases: null and empty texts have no pieces; a mark in the input reads as a blank after decoding; malformed UTF-8 is replaced; of unigram paths of equal weight the one found first stays, the same in every batch; texts and words of any length are read whole; repeated rows are encoded each; models that bring
their own character map or suffix marks are refused; only key and text are read.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import batches, utf8

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        head = varint()
        wire = head & 7
        if wire == 0:
            value: object = varint()
        else:
            n = varint() if wire == 2 else 4 if wire == 5 else 8
            value = data[at : at + n]
            at += n
        yield head >> 3, wire, value


class Table:
    """64-bit keys to non-negative numbers, looked up in whole arrays; -1 for keys it doesn't hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = todo[self.values[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.values[slot]
        miss = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            found[miss] = self.values[slot[miss]]
            miss = miss[(found[miss] >= 0) & (self.keys[slot[miss]] != keys[miss])]
        return found


_BASE = np.uint64(0x100000001B3)


def _key(text: str) -> int:
    h = 0
    for ch in text:
        h = (h * 0x100000001B3 + ord(ch) + 1) & (2**64 - 1)
    return h


class Transducer:
    """A compiled model. It is plain data of the vocabulary's size, and can be sent to workers."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        model_type, prefix, squeeze, suffix, char_map = 1, True, True, False, b""
        for field, _, value in _fields(model):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, _, v in _fields(value):
                    if f == 1:
                        piece = v.decode("utf-8")
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif field == 2:
                for f, _, v in _fields(value):
                    model_type = v if f == 3 else model_type
                    suffix = bool(v) if f == 24 else suffix
            elif field == 3:
                for f, _, v in _fields(value):
                    char_map = v if f == 2 else char_map
                    prefix = bool(v) if f == 3 else prefix
                    squeeze = bool(v) if f == 4 else squeeze
        if model_type not in (1, 2) or suffix or char_map:
            raise ValueError("only unigram and BPE models with plain normalisation and leading marks are supported")
        self.bpe, self.prefix, self.squeeze = model_type == 2, prefix, squeeze
        if any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL):
            raise ValueError("a piece crosses a word start")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.user = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER), key=len, reverse=True)
        self.all_ids = {p: i for i, p in enumerate(self.pieces)}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        known = {p for p in self.ids if len(p) == 1 and p != MARK}
        of = "".join(re.escape(c) for c in sorted(known))
        user = "|".join(re.escape(u) for u in self.user)
        # Word: marks, then characters with a piece. Anything else is one character, or a symbol of the user's.
        self.words = re.compile((f"(?:{user})|" if user else "") + (f"{MARK}*[{of}]+|" if of else "") + f"{MARK}+|.", re.S)
        self.longest = max(map(len, self.ids), default=1)
        self._weigh()
        names = list(self.ids)
        self.table = Table(np.array([_key(p) for p in names], np.uint64), np.array([self.ids[p] for p in names], np.int32))
        self.sizes = np.array([len(p) for p in self.pieces])
        self.letters = np.frombuffer("".join(self.pieces).encode("utf-32-le"), "<u4")
        self.heads = np.cumsum(self.sizes) - self.sizes
        self._forget()

    def _forget(self) -> None:
        """Empties the table of solved words: numbers of words, and their pieces one after another."""
        self.cache: dict[str, int] = {}
        self.solved: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "solved", "counts")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _keep(self, words: list[str], counts: np.ndarray, pieces: np.ndarray) -> None:
        n = len(self.cache)
        self.cache.update(zip(words, range(n, n + len(words)), strict=True))
        self.solved.append(pieces.astype(np.int32))
        self.counts.append(counts.astype(np.int64))

    def _weigh(self) -> None:
        """Ranks of merges and, for BPE, the last merge that makes each piece."""
        n = len(self.pieces)
        order = sorted(self.ids.values(), key=lambda i: (-self.scores[i], i))
        self.rank = np.full(n, 2**30, np.int64)
        self.rank[order] = np.arange(len(order))
        self.cost = np.array([-s for s in self.scores])
        self.left, self.right = np.arange(n), np.arange(n)
        self.usable = np.zeros(n, bool)
        if not self.bpe:
            self.usable[order] = True
            return
        keys, joined = [], []
        rank = self.rank.tolist()
        for i in order:
            piece = self.pieces[i]
            parts, last = self._merged(piece)
            self.usable[i] = parts == [i]
            if last and parts == [i]:
                self.left[i], self.right[i] = last
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    joined.append(rank[i])
        self.joins = dict(zip(keys, joined, strict=True))
        self.pairs = Table(np.array(keys, np.uint64), np.array(joined, np.int32))
        self.known_pairs: dict[int, bool] = {}

    def _merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """BPE of a piece's own text by its merges, to learn how it comes about; (pieces, the last merge)."""
        parts, last, rank = [self.ids.get(c, -1) for c in text], None, self.rank
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                if parts[k] >= 0 and parts[k + 1] >= 0:
                    i = self.ids.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])
                    if i is not None and (best is None or rank[i] < best[0]):
                        best = (rank[i], k, i)
            if best is None:
                break
            last = (parts[best[1]], parts[best[1] + 1])
            parts[best[1] : best[1] + 2] = [best[2]]
        return parts, last

    def _apart(self, a: int, b: int) -> bool:
        """Bigram weight of BPE: whether the merges keep pieces a and b apart. Their merges are undone, the latest first, and at each stage
        the pieces at the border must not have a merge that comes before the one undone (at equal rank, the left one comes first)."""
        key = (a << 32) | b
        known = self.known_pairs.get(key)
        if known is not None:
            return known
        limit, rank, x, y = 2**31, self.rank, a, b
        while True:
            r = self.joins.get((x << 32) | y)
            if r is not None and r < limit:
                out = False
                break
            if self.left[x] == x and self.left[y] == y:
                out = True
                break
            if self.left[y] == y or (self.left[x] != x and rank[x] > rank[y]):
                limit, x = rank[x], int(self.right[x])
            else:
                limit, y = rank[y] + 1, int(self.left[y])
        if len(self.known_pairs) > 1 << 17:
            self.known_pairs.clear()
        self.known_pairs[key] = out
        return out

    def _apart_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_apart` for whole arrays."""
        out = np.ones(len(a), bool)
        at, x, y, limit = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64), np.full(len(a), 2**31, np.int64)
        while len(at):
            r = self.pairs.get((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
            bad = (r >= 0) & (r < limit)
            out[at[bad]] = False
            x_leaf, y_leaf = self.left[x] == x, self.left[y] == y
            go = np.flatnonzero(~bad & ~(x_leaf & y_leaf))
            at, x, y, x_leaf, y_leaf = at[go], x[go], y[go], x_leaf[go], y_leaf[go]
            undo_x = y_leaf | (~x_leaf & (self.rank[x] > self.rank[y]))
            limit = np.where(undo_x, self.rank[x], self.rank[y] + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return out

    def _path(self, word: str) -> tuple[int, ...]:
        """Shortest path of one word: per position the best arc that ends there."""
        n, get = len(word), self.ids.get
        cost, last = [0.0] + [math.inf] * n, [-1] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                piece = get(word[i:j])
                if piece is None or not self.usable[piece] or cost[i] == math.inf:
                    continue
                c = cost[i] + (0.0 if self.bpe else self.cost[piece])
                if c < cost[j] and (not self.bpe or i == 0 or self._apart(last[i], piece)):
                    cost[j], last[j] = c, piece
        return self._back(word, last)

    def _back(self, word: str, last) -> tuple[int, ...]:
        out, j = [], len(word)
        while j > 0:
            if last[j] < 0:
                raise ValueError(f"no path for {word!r}")
            out.append(int(last[j]))
            j -= len(self.pieces[last[j]])
        return tuple(out[::-1])

    def _paths(self, words: list[str]) -> None:
        """Shortest paths of many words of one length into the table."""
        n, m = len(words[0]), len(words)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(m, n)
        prefix = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + (letters[:, j].astype(np.uint64) + np.uint64(1))
        powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(n + 1)], np.uint64)
        cost = np.full((n + 1, m), np.inf)
        cost[0] = 0
        last = np.full((n + 1, m), -1, np.int32)
        for j in range(1, n + 1):
            todo = np.arange(m)
            for i in range(max(0, j - self.longest), j):
                piece = self.table.get(prefix[j, todo] - prefix[i, todo] * powers[j - i])
                hit = np.flatnonzero(piece >= 0)
                hit = hit[self.usable[piece[hit]]]
                at, piece = todo[hit], piece[hit]
                c = cost[i, at] + (0.0 if self.bpe else self.cost[piece])
                better = c < cost[j, at]
                if self.bpe and i:
                    hit, at, piece, c = hit[better], at[better], piece[better], c[better]
                    better = self._apart_all(last[i, at], piece) if len(at) else better[:0]
                at, c = at[better], c[better]
                cost[j, at], last[j, at] = c, piece[better]
                if self.bpe and len(at):
                    # One path of BPE has finite weight, so these words need no other arc to this place.
                    todo = np.delete(todo, hit[better])
                    if not len(todo):
                        break
        # Walk back all words at once.
        where, steps = np.full(m, n), []
        while (where > 0).any():
            here = np.where(where > 0, last[where, np.arange(m)], -1)
            steps.append(here)
            where = np.where(where > 0, where - np.where(here >= 0, self.sizes[here], n), 0)
        grid = np.array(steps)[::-1].T
        held = grid >= 0
        flat, counts = grid[held], held.sum(axis=1)
        # Hashes stand for substrings above; this is the exact check, letter by letter.
        size = self.sizes[flat]
        spelled = self.letters[np.repeat(self.heads[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        if len(spelled) == m * n and np.array_equal(spelled, letters.ravel()):
            self._keep(words, counts, flat)
        else:
            self._one_by_one(words)

    def _one_by_one(self, words: list[str]) -> None:
        paths = [self._path(w) for w in words]
        self._keep(words, np.array([len(p) for p in paths]), np.array([i for p in paths for i in p]))

    def _solve(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) == 1 and w not in self.ids or w in self.user:
                ids = (self.all_ids[w],) if w in self.user else self._fallback(w)
                self._keep([w], np.array([len(ids)]), np.array(ids))
            else:
                by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            if len(group) < 48 or n > 48:
                self._one_by_one(group)
            else:
                for at in range(0, len(group), 1 << 15):
                    self._paths(group[at : at + (1 << 15)])

    def _fallback(self, ch: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in ch.encode("utf-8", "replace")) if len(self.bytes) == 256 else (self.unknown,)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of pieces of each text, all pieces one after another)."""
        if len(self.cache) > 400_000:
            self._forget()
        split = [self.words.findall(self.normalise(t)) for t in texts]
        self._solve(set(chain.from_iterable(split)).difference(self.cache))
        pool = np.concatenate(self.solved) if self.solved else np.empty(0, np.int32)
        counts = np.concatenate(self.counts) if self.counts else np.empty(0, np.int64)
        self.solved, self.counts = [pool], [counts]
        starts = np.cumsum(counts) - counts
        amounts = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(split)), np.int64, amounts.sum())
        n = counts[word]
        ends = np.cumsum(n)
        flat = pool[np.repeat(starts[word] - (ends - n), n) + np.arange(n.sum())]
        total = np.concatenate([[0], ends])[np.cumsum(amounts)]
        return np.diff(total, prepend=0), flat

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        lengths, flat = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] if len(texts) else []

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The inverse: pieces joined, bytes joined into characters, marks to blanks, the leading blank off."""
        if not hasattr(self, "_said"):
            self._said = ["" if k == CONTROL else f"\0{p[3:5]}" if k == BYTE else " ⁇ " if k == UNKNOWN else p.replace(MARK, " ") for p, k in zip(self.pieces, self.kinds, strict=True)]
        text = "".join(map(self._said.__getitem__, ids))
        if "\0" in text:
            text = re.sub("(?:\0[0-9A-F]{2})+", lambda m: bytes(int(x, 16) for x in m[0][1:].split("\0")).decode("utf-8", "replace"), text)
        return text[1:] if self.prefix and text.startswith(" ") else text


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a model file, in its order."""
    with open(path, "rb") as f:
        parts = [{k: v for k, _, v in _fields(value)} for field, _, value in _fields(f.read()) if field == 1]
    return [x[1].decode("utf-8") for x in parts if x.get(3, NORMAL) == NORMAL]


def load(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode_texts(docs: DataFrame, model: Transducer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids, round_trip (decoding gives the text back)."""
    # The size of the vocabulary bounds what is sent.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches(arrow, text, 4 << 20):
            texts = [x.decode("utf-8", "replace") for x in utf8(batch.column(text))]
            lengths, flat = m.encode_flat(texts)
            ends = np.cumsum(lengths)
            same = [m.decode(flat[b - n : b].tolist()) == t for n, b, t in zip(lengths.tolist(), ends.tolist(), texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(lengths, pa.int64()), lists, pa.array(same)], names=[key, "n_tokens", "ids", "round_trip"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, n_tokens long, ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, model: Transducer, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key and the text its ids stand for; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([None if i is None else sent.value.decode(i) for i in batch.column(ids).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(F.col(key).cast("long").alias(key), ids).mapInArrow(run, f"{key} long, text string")
