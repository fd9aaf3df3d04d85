"""Byte-level BPE against the public reference library, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sightline.llm import bpe


@pytest.fixture(scope="module")
def tokens():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def random_texts(n):
    rng = random.Random(1)
    alphabet = "abc ABC the 's'll\n\t\r\x0b\x1c\x85 ​ éüß漢字😀1२३²Ⅷ_-#▁\x00⠀"
    for _ in range(n):
        yield "".join(rng.choice(alphabet) if rng.random() < 0.8 else chr(rng.randrange(0xD800)) for _ in range(rng.randrange(80)))


def test_like_tiktoken(spark, tokens):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rows = [(i, t) for i, t in enumerate([*random_texts(600), "", "<|endoftext|>", "x" * 90_000 + " " + "é" * 30_000, "same", "same"])]
    rows += [(None, "no id"), (7777, None)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    encoded = bpe.encode(docs, tokens, public_tokenizers.PATTERN)
    back = {r.doc_id: r for r in bpe.decode(encoded, tokens).collect()}
    assert len(back) == len(rows)
    for i, text in rows:
        ids, row = other.encode_ordinary(text or ""), back[i]
        assert (row.text, row.ids, row.n_tokens) == (text, ids, len(ids))
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert bytes(row.decoded) == (text or "").encode()


def test_memory_can_be_short(tokens, monkeypatch):
    texts = list(random_texts(200))
    full = bpe.Tokenizer(tokens, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "GROUP", 20)
    short = bpe.Tokenizer(tokens, public_tokenizers.PATTERN)
    assert [d for _, d in short.encode_all(texts)] == [d for _, d in full.encode_all(texts)]


def test_empty_table(spark, tokens):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, tokens, public_tokenizers.PATTERN).collect() == []
