import random
import struct

import pytest

from panelforge.llm import queries, wfst

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return wfst.load(queries.vocabulary())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())


CASES = ["", " ", "a", "  two  blanks  ", "tab\tand\nline", "日本語のテキスト", "😀 emoji \U0001f9ff", "\x00\x01", "▁marks▁", "<s> </s> <unk> <0x41>", "a" * 500, "ab" * 300, "é" * 60, "https://example.com/a?b=c&d=%20", "x" * 3000, " " * 200]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(model, library, text):
    ids = model.encode(text)
    assert ids == library.encode(text)
    assert model.decode(ids) == library.decode(ids)
    if "▁" not in text:
        assert model.decode(ids) == text


def test_random_texts(model, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghinsrt  etheé.,0123AB日ß") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    assert model.encode_all(texts) == [library.encode(t) for t in texts]


def test_documents(spark, data, model, library):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op2_sentencepiece(spark, data).collect():
        assert r["ids"] == library.encode(rows[r["doc_id"]])
        assert r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_nulls_and_empty_tables(spark, model):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a", 5), (None, "a", 5)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in wfst.encode_texts(df, model).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (2, 1)]
    assert wfst.encode_texts(df.limit(0), model).count() == 0
    back = wfst.decode_ids(wfst.encode_texts(df, model), model).collect()
    assert sorted(r["text"] for r in back) == ["", "", "a", "a"]


def message(pieces, kind):
    """A tiny model file: pieces as (text, score, type), and the model's type."""
    field = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in pieces)
    return body + field(2, bytes([3 << 3, kind])) + field(3, bytes([3 << 3, 1, 4 << 3, 0]))


def best_unigram(text, scores):
    best = {0: (0.0, ())}
    for j in range(1, len(text) + 1):
        found = [(best[i][0] - scores[text[i:j]], (*best[i][1], text[i:j])) for i in range(j) if i in best and text[i:j] in scores]
        if found:
            best[j] = min(found)
    return list(best[len(text)][1])


def test_unigram_shortest_paths():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁a": -2.2, "ba": -3.3, "aba": -4.9, "bab": -6.0}
    m = wfst.Transducer(message([("<unk>", 0.0, 2), *[(p, s, 1) for p, s in scores.items()]], 1))
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        got = [m.pieces[i] for i in m.encode(text)]
        assert sum(scores[p] for p in got) == pytest.approx(sum(scores[p] for p in best_unigram("▁" + text, scores)))
        assert m.decode(m.encode(text)) == text


def test_very_long_words_and_texts(model, library):
    rng = random.Random(6)
    word = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    assert model.encode(word) == library.encode(word)
    text = word + " é日" * 20_000
    assert model.decode(model.encode(text)) == text


def test_ties_of_unigram_paths():
    """Any of the lightest paths may be taken, the same one however texts are batched."""
    m = wfst.Transducer(message([("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -1.0, 1), ("aa", -2.0, 1)], 1))
    assert [m.pieces[i] for i in m.encode("aaa")] == [m.pieces[i] for i in m.encode_all(["aaa"] * 3)[0]]
    assert sum({"▁": 1, "a": 1, "aa": 2}[m.pieces[i]] for i in m.encode("aaa")) == 4


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError, match="only unigram and BPE"):
        wfst.Transducer(message([("<unk>", 0.0, 2), ("a", -1.0, 1)], 4))
    with pytest.raises(ValueError, match="crosses a word start"):
        wfst.Transducer(message([("<unk>", 0.0, 2), ("a▁b", -1.0, 1)], 1))
