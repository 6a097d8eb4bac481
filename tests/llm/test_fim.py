import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from panelforge.llm import fim, queries

TEXTS = [
    (1, "one\ntwo\nthree"), (2, "one\ntwo\nthree\n"), (3, ""), (4, None), (None, "a\nb\nc\nd"), (5, "\n\n\n"), (6, "holds <S> in\nit"), (7, "ends in <\nS>\n<"), (8, "é\U0001f600\r\n x\n\x00y"),
    (9, "no end of line"), (9, "no end of line"), (9, "same key\nanother text"), (10, "x" * 300_000 + "\n" + "y\n" * 5000),
]


def plain(key, text, rate=100, spm=50):
    """What a row must be, from the words of the contract."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(x in text for x in fim.SENTINELS) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, output string, n int")


def test_rows_and_round_trip(spark):
    made = fim.transform_texts(frame(spark))
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted((plain(k, t) for k, t in TEXTS), key=str)
    wanted = sorted(t or "" for _, t in TEXTS)
    assert sorted(r["back"] for r in rows) == wanted


@pytest.mark.parametrize("rate, spm", [(0, 50), (40, 100), (100, 0)])
def test_rates(spark, rate, spm):
    rows = [(i, "a\nb\nc\n" * (i % 5)) for i in range(200)]
    made = fim.transform_texts(frame(spark, rows), rate=rate, spm_rate=spm).collect()
    assert sorted((tuple(r)[:6] for r in made), key=str) == sorted((plain(k, t, rate, spm) for k, t in rows), key=str)


def test_offsets_equal_the_pattern():
    rng = random.Random(3)
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    splitter = Split(Regex(fim.LINES), behavior="isolated")
    for _ in range(500):
        text = "".join(rng.choice("\n\nab \r\té　\U0001f600\x00\x85") for _ in range(rng.randrange(30)))
        at = fim.offsets(splitter, text)
        assert [text[a:b] for a, b in zip(at, at[1:])] == re.findall(fim.LINES, text)


def test_other_units_and_sentinels(spark):
    words = fim.transform_texts(frame(spark), pattern=r"\w+|\W+", seed=3, sentinels=("<pre>", "<suf>", "<mid>"))
    rows = words.select("form", fim.restored(F.col("output"), F.col("form"), ("<pre>", "<suf>", "<mid>")).alias("back")).collect()
    assert sorted(r["back"] for r in rows) == sorted(t or "" for _, t in TEXTS) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for wrong in (("<P>", "<P>", "<M>"), ("P", "S", "M"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform_texts(frame(spark), sentinels=wrong)


def test_empty_table(spark):
    assert fim.transform_texts(frame(spark).limit(0)).count() == 0


def test_query(spark, data):
    rows = queries.op13_fill_in_middle(spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        wanted = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == wanted[1:5]
        assert r["output_sha256"] == sha256(wanted[5].encode()).hexdigest() and r["restored_sha256"] == sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
