"""Spelling variants by anagram hashing.

A word's anagram value is the sum of its letters' fifth powers, whatever their order. Two words that differ by one inserted, deleted or
replaced letter have values that differ by one letter's power, or by the difference of two: so the value of one with a letter taken out equals
the value of the other (an addition or removal) or that of the other with a letter taken out (an exchange). Words meet on these values. What
is verified is the order of letters: rolling hashes of the letters before and after the place travel with the value, which splits words
that are anagrams of each other and nothing more, and pairs that are left are compared letter by letter.

Scale: words are counted batch by batch before they are shuffled, and only counted words are compared. A word makes two rows per letter, so long
words take linear room; a value, place and order are shared by one word per letter of the alphabet at most (about 90), so no group is
unbounded. Forms have at least `ratio` times the occurrences of their variants, so chains are short and roots take a fixed number of joins.

Defined cases: null and empty texts have no words; a null key counts as empty text in the draw of deletions; rows that repeat count each;
among equally frequent forms the smallest in code-point order wins; runs of any length are words; tables without rows or without words
give none; only the key and the text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import batches, importable, release, store, utf8

#: Maximal runs of letters, A-Z lowered before.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters of code points below this have a random number each in the rolling hashes.
_LETTERS = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)


def damaged(run: str, key: str, every: int) -> str:
    """`run` without one letter, where the checksum of key and run is divisible by `every`."""
    h = crc32(f"{key}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): words of at least `shortest` letters with at least `least` occurrences over all texts."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text):
            found: Counter = Counter()
            for own, octets in zip(batch.column("_key").to_pylist(), utf8(batch.column(text)), strict=True):
                for word, n in Counter(RUN.findall(octets.lower().decode())).items():
                    if len(word) >= shortest:
                        found[damaged(word, own, every)] += n
            kept = [(w, n) for w, n in found.items() if len(w) >= shortest]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    importable(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), text)
    return keyed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_values(codes: np.ndarray) -> np.ndarray:
    """Fifth powers of code points, modulo 2**64."""
    x = codes.astype(np.uint64)
    return x * x * x * x * x


def _places(words: list[str]) -> tuple[np.ndarray, ...]:
    """For every word, and every place of it: removals (kind 0 where a run of equal letters begins, else 1) and gaps (kind 2). Columns word (its
    index), kind, value of the letters left, place, hash of those before, hash of those after."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size) - size
    own = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - starts[own]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=0)), _BASE)]), dtype=np.uint64)
    mixed = np.random.default_rng(5).integers(1, 2**63, _LETTERS, dtype=np.uint64)[codes]
    value = letter_values(codes)
    summed = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    total, ahead, behind = summed(value), summed(mixed * powers[place]), summed(mixed * powers[size[own] - 1 - place])
    ends = starts + size
    whole = total[ends] - total[starts]
    at = np.arange(len(codes))
    first = (place == 0) | (codes != np.concatenate([codes[:1], codes[:-1]]))
    removed = (own, np.where(first, 0, 1), whole[own] - value, place, ahead[at] - ahead[starts[own]], behind[ends[own]] - behind[at + 1])
    # Gaps: before each letter, and behind the last one.
    who = np.concatenate([own, np.arange(len(words))])
    gap = np.concatenate([at, ends])
    gaps = (who, np.full(len(who), 2), whole[who], np.concatenate([place, size]), ahead[gap] - ahead[starts[who]], behind[ends[who]] - behind[gap])
    return tuple(np.concatenate(x) for x in zip(removed, gaps, strict=True))


def _near(place: Column, kind: Column, a: Column, b: Column) -> Column:
    """Whether a and b differ at that place only: an exchange (kind 1), or a letter that a has more (kind 0)."""
    head = F.left(a, place) == F.left(b, place)
    rest = lambda x, start: F.substr(x, start)
    return (a != b) & head & F.when(kind == 1, rest(a, place + 2) == rest(b, place + 2)).otherwise(rest(a, place + 2) == rest(b, place + 1))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): ids of words that differ by one letter, both ways. `words` has a unique long id and the word."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, "word", 1 << 19):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            who, kind, value, place, before, after = _places(batch.column("word").to_pylist())
            for at in range(0, len(who), 1 << 18):
                s = slice(at, at + (1 << 18))
                columns = [value[s].view(np.int64), place[s], before[s].view(np.int64), after[s].view(np.int64), kind[s].astype(np.int8), ids[who[s]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["value", "place", "before", "after", "kind", "id"])
            release()

    places = words.select("id", "word").mapInArrow(run, "value long, place long, before long, after long, kind byte, id long")
    met = places.groupBy("value", "place", "before", "after").agg(F.collect_list(F.struct("kind", "id")).alias("own")).where(F.size("own") > 1)
    x, y = F.col("x"), F.col("y")
    pairs = (
        met.select("place", "own", F.explode("own").alias("x"))
        .where("x.kind < 2")
        .select("place", "x", F.explode("own").alias("y"))
        .where(((y.kind < 2) & (x.id < y.id)) | ((x.kind == 0) & (y.kind == 2)))
        .select(F.col("place").cast("int").alias("place"), F.when(y.kind < 2, 1).otherwise(0).alias("kind"), x.id.alias("a"), y.id.alias("b"))
    )
    text = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"_{c}"))
    sure = pairs.join(text("a"), "a").join(text("b"), "b").where(_near(F.col("place"), F.col("kind"), F.col("_a"), F.col("_b"))).select("a", "b")
    return sure.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def spelling_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """`counts` has distinct words and n. Adds n_near, form (the most frequent near word, if it has `ratio` times the occurrences or more), form_n and
    root, the end of the chain of forms."""
    if ratio < 2:
        raise ValueError("forms are at least twice as frequent as their variants, so that chains end")
    words = store(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words)
    other = near.join(words.select(F.col("id").alias("b"), F.col("word").alias("_word"), F.col("n").alias("_n")), "b")
    first = F.min(F.struct((-F.col("_n")).alias("m"), F.col("_word").alias("word"), F.col("b").alias("id")))
    best = other.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    joined = words.join(best.withColumnRenamed("a", "id"), "id", "left")
    chosen = -F.col("best.m") >= ratio * F.col("n")
    taken = [F.when(chosen, x).alias(c) for c, x in (("form", F.col("best.word")), ("up", F.col("best.id")), ("form_n", -F.col("best.m")))]
    formed = joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *taken)
    formed = store(formed, "forms")
    low, high = formed.agg(F.min("n"), F.max("n")).first()
    longest = math.log(high / low, ratio) if high else 0
    # Pointer doubling: after k rounds `up` is 2**k forms away, or the root. A chain of s forms needs counts that differ by ratio ** s.
    ups = formed.where(F.col("up").isNotNull()).select("id", "up")
    for _ in range(math.ceil(math.log2(longest + 1.01))):
        above = ups.select(F.col("id").alias("up"), F.col("up").alias("_top"))
        ups = store(ups.join(above, "up", "left").select("id", F.coalesce("_top", "up").alias("up")), "ups")
    roots = ups.join(words.select(F.col("id").alias("up"), F.col("word").alias("root")), "up").select("id", "root")
    return formed.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
