import os
import struct

import pytest
from tokenizers import Tokenizer, models

from lumisift.llm import tokens
from lumisift.llm.catalog import VOCABULARY
from lumisift.llm.common import table

MODEL = VOCABULARY.removeprefix("file://")
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return f.read()


def unigram(model):
    """The same pieces and scores cut by the library's own best path, without any cache."""
    pieces = [dict(tokens._fields(v)) for f, v in tokens._fields(model) if f == 1]

    vocabulary = [(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0) for p in pieces]
    vocabulary = [(p if i >= 259 else f"\x01{p}\x02", s) for i, (p, s) in enumerate(vocabulary)]  # special pieces match nothing
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False)), {p for p, _ in vocabulary}


def count_by_library(tokenizer, known, text):
    n = 0
    for token in tokenizer.encode("▁" + text.replace(" ", "▁")).tokens if text else []:
        n += 1 if token in known else len(token.encode())  # unknown characters, merged by the library
    return n


TEXTS = ["", " ", "a", "Hello world", "two  blanks   and    four", "tabs\tand\nlines\n\nx", "é ü ñ ß \U0001F600 日本語 \x00 ",
         "aaaaaaaaaaaaaaaaaaaa", "<s> <0x41> </s>", "the of and inthe thing ▁ mark"]


def test_equal_to_the_library(spark, model):
    tokenizer, known = unigram(model)
    texts = TEXTS + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert tokens.UnigramCounter(model).count(texts) == [count_by_library(tokenizer, known, t) for t in texts]


def test_forgetting_words_changes_nothing(model, monkeypatch):
    texts = [f"some words {i} and more" for i in range(50)]
    whole = tokens.UnigramCounter(model).count(texts)
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    assert tokens.UnigramCounter(model).count(texts) == whole


def test_query_on_messy_and_empty(make, messy, model):
    got = tokens.token_counts(make(messy), VOCABULARY).collect()
    alone = tokens.UnigramCounter(model).count([t or "" for _, t in messy])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((d, n) for (d, _), n in zip(messy, alone)), key=str)
    assert tokens.token_counts(make([]), VOCABULARY).collect() == []
