from __future__ import annotations

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sedgework.llm import bpe, tokenize
from sedgework.llm.bpe import PATTERN, Tokenizer, load_ranks, tokenizer

TEXTS = [
    None, "", " ", "   \n\n  ", "Hello world", "don't we'll I'M", "naïve façade — “quoted”", "日本語のテキスト。", "Приве́т мир", "🙂🙃 👩‍👩‍👧", "a" * 3000, "ab" * 2000, "=" * 500, "<|endoftext|> <|startoftext|>",
    "1234567890 3.14e-10", "\t\ttabs\r\nand nbsp em", "{{Infobox person\n| name = X}}\n[[Category:Y]]", "x" + " " * 400 + "y", "Ã¤Ã¶Ã¼ â€™", "\x00\x01\x7f", "ｆｕｌｌ ﬁ Ⅷ", "नमस्ते ไทย",
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(), special_tokens={}).encode_ordinary


def test_ids_equal_the_public_tokenizer(reference):
    own = Tokenizer()
    for text in TEXTS:
        assert own.encode(text) == (reference(text) if text else [])
        assert own.count(text) == len(own.encode(text))
        assert own.decode(own.encode(text)) == (text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    own = tokenizer()
    expected = [i for word in own.split(text) for i in own.transducer.merge(word.encode("utf-8", "surrogatepass"))]
    assert own.encode(text) == expected


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40))
def test_transducer_equals_merging(data):
    """On any bytes, also such as are no UTF-8."""
    transducer = tokenizer().transducer
    assert list(transducer.encode(data)) == transducer.merge(data)


def test_tokens_come_after_bounded_lookahead():
    transducer = tokenizer().transducer
    longest = max(map(len, transducer.ranks))
    state, out, read = transducer.START, [], 0
    for byte in b"interoperability of transducers" * 20:
        state, sure = transducer.move(state, byte)
        out += sure
        read += 1
        assert sum(len(transducer.tokens[i]) for i in out) >= read - 2 * longest


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_streams(size):
    own = tokenizer()
    for text in TEXTS:
        raw = (text or "").encode()
        assert list(own.encode_stream(raw[i : i + size] for i in range(0, len(raw), size))) == own.encode(text)
    half = own.encode("日本")[:1]
    assert "".join(own.decode_stream(half)) in ("日", "�", "")


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    own, usual = Tokenizer(), tokenizer()
    words = [random.Random(i).choice(["alpha", "beta", "gamma", "Ωmega", "  ", "42"]) + str(i % 17) for i in range(200)]
    assert own.encode(" ".join(words)) == usual.encode(" ".join(words))
    assert len(own.words) <= 5


def test_encoded_rows(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "SLICE_CHARS", 50)
    data = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "again", None), (1, "again", None), (None, "no id", None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, ids string").repartition(3)
    found = tokenize.encoded(docs)
    assert dict(found.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    own = tokenizer()
    assert sorted(((r["doc_id"], list(r["ids"])) for r in found.collect()), key=str) == sorted(((i, own.encode(t)) for i, t, _ in data), key=str)
    assert sorted(map(tuple, tokenize.token_counts(docs).collect()), key=str) == sorted(((i, own.count(t)) for i, t, _ in data), key=str)
    assert tokenize.encoded(docs.limit(0)).collect() == []


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1 AS doc_id, CAST(X'61ff62' AS STRING) AS text")
    assert list(tokenize.encoded(docs).first()["ids"]) == tokenizer().encode("a�b")
