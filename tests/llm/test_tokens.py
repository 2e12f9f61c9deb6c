import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import tokens

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokens.RANKS), reason="no rank file here")


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.RANKS)


def test_chunks_change_nothing(enc, monkeypatch):
    rng = random.Random(0)
    parts = ["word", " ", "  ", "\n", "\t", "don't", "'s", "数据", "🙂", "é", "123", "--", "\u00a0", "\u2003", "<|endoftext|>", "\x1c", "\u0085", "ß"]
    for _ in range(200):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 9]) for _ in range(60))
        whole = enc.encode_ordinary(text)
        for chunk, run in ((3, 4), (7, 2), (50, 3)):
            monkeypatch.setattr(tokens, "CHUNK", chunk)
            monkeypatch.setattr(tokens, "LONG_RUN", 1)
            monkeypatch.setattr(tokens, "_RUN", tokens.re.compile(f"[{tokens.SPACE}]{{{run},}}+"))
            assert tokens.encode(enc, text) == whole, (text, chunk, run)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    enc = tokens.encoder(tokens.RANKS)
    ids = tokens.encode(enc, text)
    assert tokens.decode(enc, ids) == text.encode() and ids == enc.encode_ordinary(text)


def test_very_long(enc):
    for text in (" " * 1_000_000, "a" * 300_000, "ab " * 100_000, "x" + "\n" * 50_000 + "y", " " * 5000):
        assert tokens.decode(enc, tokens.encode(enc, text)) == text.encode()


def test_operator(spark, enc):
    df = spark.createDataFrame([(1, "Hello <|endoftext|>"), (2, None), (3, ""), (4, " "), (1, "Hello <|endoftext|>"), (None, "x")], "doc_id bigint, text string").selectExpr("*", "5 AS ids", "6 AS n_tokens")
    got = sorted((r.doc_id or 0, r.ids) for r in tokens.encode_corpus(df).collect())
    hello = enc.encode_ordinary("Hello <|endoftext|>")
    assert got == [(0, enc.encode_ordinary("x")), (1, hello), (1, hello), (2, []), (3, []), (4, enc.encode_ordinary(" "))] and 50256 not in hello
    assert sorted(r.n for r in tokens.count_tokens(df.select("doc_id", "text"), name="n").collect()) == sorted(len(x) for _, x in got)
    back = tokens.ids_to_bytes(tokens.encode_corpus(df))
    assert {bytes(r.raw) for r in back.collect()} == {b"Hello <|endoftext|>", b"", b" ", b"x"}
    assert tokens.encode_corpus(df.limit(0)).count() == 0
