import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tablewright.llm import tokens

ODD = [
    None, "", " ", "Hello, world's end!! don't", "İstanbul ΟΔΟΣ ς Σ", "éa ́ x́", "a b c\x1cd\x85e",
    "<|endoftext|> a<|startoftext|>b", "0 1 20 x0y 0", "ﬁne ǅ ß ẞ ÀÉ×÷", "日本語 テキスト 한국어", "a'sb 'S 'll 'LL it's", "🙂🙂 x",
    "tab\tnew\nline\r\x0b\x0c end", "a.b,c;d--e '''s", "﻿bom",
]


@pytest.fixture(scope="module")
def both():
    e = tokens.Encoder(tokens.default_path())

    def check(texts):
        plain = [np.array(e.model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert e.encode(texts) == plain

    return check


def test_odd_texts(both):
    both(ODD)
    both([" ".join(t or "" for t in ODD)])


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(both, texts):
    both([t.encode("utf-8", "ignore").decode() for t in texts])


def test_every_plain_letter(both):
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]]
    both([" ".join(f"x{c}y{c}., {c}, {c}.\nc {c}{c}!? {c}" for c in letters), " ".join(letters), "".join(letters)])


def test_bounded_dictionaries(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 20)
    e = tokens.Encoder(tokens.default_path())
    texts = [" ".join(f"word{chr(97 + (i * j) % 26)}{'xyz'[j % 3]}" for j in range(9)) for i in range(200)]
    plain = [np.array(e.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == plain


def test_a_word_is_looked_up_once_for_many_texts():
    class Counting(dict):
        asked = 0

        def get(self, *args):
            Counting.asked += 1
            return super().get(*args)

    e = tokens.Encoder(tokens.default_path())
    e.words = Counting()
    texts = ["some words that come again, and again. " * 20, "", None, "and words"] * 100
    plain = [np.array(e.model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == plain
    assert Counting.asked < 100
