"""Fill-in-middle transformation of texts over units of a regular expression.

A Split pre-tokenizer of the tokenizers library, with isolated matches, gives the code-point offsets of a text's units; nothing is trained. The
length of the offset array is n, and the offsets at two drawn ranks cut the text into prefix, middle and suffix. Draws are digests of the seed
and the key, so a retry, another partitioning or another engine gives the same rows.

Defined cases: a null text counts as empty, and is `plain`, as are texts that hold a sentinel; a null key draws by the seed alone; rows that
repeat a key draw alike; long texts are cut whole; a table without rows gives none; only the key and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from panelforge.llm._base import batches, importable

#: Lines with their ends; the last one may have none.
LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")


def draws(seed: int, key: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a key."""
    digest = sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def offsets(splitter: Split, text: str) -> list[int]:
    """Where each unit starts, in code points, and where the last one ends."""
    spans = [span for _, span in splitter.pre_tokenize_str(text)] if text else []
    return [*(start for start, _ in spans), spans[-1][1] if spans else 0]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    if len(set(sentinels)) != 3 or not all(re.fullmatch(r"<[^<>]+>", x) for x in sentinels):
        raise ValueError("sentinels are three different words in angle brackets, so that none can arise where two parts meet")
    return sentinels


def transform_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    pattern: str = LINES,
    rate: int = 100,
    spm_rate: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per row of `docs`: key, n (units), form (`plain`, `psm`, `spm`), prefix_chars, middle_chars (null where plain) and output.

    `rate` of 100 texts are transformed, `spm_rate` of 100 of these with the suffix first. The pattern's matches must cover every text.
    """
    first, second, third = _checked(sentinels)
    held = re.compile("|".join(map(re.escape, sentinels)))

    def transformed(splitter: Split, own: int | None, whole: str) -> tuple:
        at = offsets(splitter, whole)
        if at[0] or at[-1] != len(whole):
            raise ValueError("the pattern leaves a part of a text out")
        n = len(at) - 1
        h1, h2, h3, h4 = draws(seed, own)
        if not whole or h3 % 100 >= rate or held.search(whole):
            return n, "plain", None, None, whole
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = at[low], at[high]
        prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, f"{second}{suffix}{first}{prefix}{third}{middle}"
        return n, "psm", a, b - a, f"{first}{prefix}{second}{suffix}{third}{middle}"

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Split(Regex(pattern), behavior="isolated")
        for batch in batches(arrow, text):
            keys = batch.column(key).to_pylist()
            rows = [transformed(splitter, k, t or "") for k, t in zip(keys, batch.column(text).to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *columns, pa.array(output, pa.string())], names=[key, "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    importable(docs.sparkSession)
    schema = f"`{key}` long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `output` was made from. Its parts hold no sentinel, so cutting at the sentinels gives them back."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in _checked(sentinels)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
