"""Properties on generated texts, of the plain functions under the operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import decontam, gam, queries, secretscan, simhash, tagpath, wfst

from test_secretscan import brute as patterns
from test_simhash import mark

sentencepiece = pytest.importorskip("sentencepiece")
MODEL, LIBRARY = wfst.load(queries.vocabulary()), sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=80)
WORDY = st.lists(st.sampled_from(["the", "Of", "a", "é", "ß1", "\t", "\n", "  ", "x" * 20, "password: ", "token=", "AKIA" + "Z9" * 8, "0123456789abcdef", "deadbeef", "▁", "日本", "😀", "'", "=", ":"]), max_size=40).map("".join)
MARKUP = st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "<div>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", "<br>", "<!--", "-->", "<script>", "</script>", "text, here. ", "&amp;", "&#x;", "<", ">", '"', "<li>", "<ul>", "</ul>", "<table><tr><td>", "</nav>", "<nav>", "é"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT | WORDY)
def test_encoding_equals_the_library(text):
    ids = MODEL.encode(text)
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(TEXT | WORDY)
def test_fingerprints_equal_brute_force(text):
    assert simhash.fingerprint(text.encode()) == mark(text)


@settings(max_examples=300, deadline=None)
@given(TEXT | WORDY)
def test_base_spans_equal_the_patterns(text):
    raw = text.encode()
    spans = secretscan._points(raw, secretscan.find_spans(raw))
    assert secretscan.spans_text([s for s in spans if s[2] < 3]) == patterns(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_any_markup_is_read(page):
    text = tagpath.main_text(page)
    for block in text.split("\n"):
        assert block == " ".join(block.split())
    assert tagpath.main_text(page) == text


@settings(max_examples=200, deadline=None)
@given(TEXT | WORDY)
def test_features_are_finite(text):
    x = gam.features(text.encode())
    assert len(x) == len(gam.FEATURES)
    assert all(v == v and abs(v) != float("inf") for v in x)


@settings(max_examples=200, deadline=None)
@given(TEXT | WORDY)
def test_words_of_texts(text):
    import re

    assert decontam.tokens(text.encode()) == re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
