"""Alignment of two tokenizers against overlaps counted pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ENCODE_A, _ = ta.byte_level_tokenizer(open(A, "rb").read())
ENCODE_B, PIECES_B = ta.piece_tokenizer(open(B, "rb").read())
SPACE_B = len(PIECES_B) - 1 - PIECES_B[::-1].index(b" ")


def overlaps(ends_a, ends_b):
    spans = [list(zip([0, *ends], ends)) for ends in (ends_a, ends_b)]
    return [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (s2, e2) in enumerate(spans[1]) if s < e2 and s2 < e]


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_align(data):
    n = data.draw(st.integers(1, 60))
    draw = lambda: sorted({*data.draw(st.sets(st.integers(1, n))), n})
    a, b = (list(range(1, n + 1)), draw()) if data.draw(st.booleans()) else (draw(), draw())
    last_a, last_b = ta.groups_of(ta.align(a, b), np.array(a), np.array(b))
    common = sorted(set(a) & set(b))
    assert [a[k - 1] for k in last_a] == common and [b[k - 1] for k in last_b] == common
    link_a, link_b = ta.links_of(np.array(a), np.array(b))
    assert list(zip(link_a.tolist(), link_b.tolist())) == overlaps(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("ab é漢\n\x85\u3000'1!▁<s>", max_size=40))
def test_words_are_encoded_alone(text):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    assert ENCODE_B([text])[0].tolist() == (SentencePieceProcessor(model_file=B).encode(text) if text else [SPACE_B])
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    assert "".join(ta._CHUNK.findall(" " + text)) == " " + text
    assert ENCODE_A([text])[0].tolist() == whole.encode(" " + text, add_special_tokens=False).ids


def brute(rows):
    (encode_a, bytes_a), (encode_b, bytes_b) = ta.byte_level_tokenizer(open(A, 'rb').read()), ta.piece_tokenizer(open(B, 'rb').read())
    parsed, counts = [], Counter()
    for _, text in rows:
        ids = (encode_a([text])[0].tolist(), encode_b([text])[0].tolist()) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or any(b"".join(t[i] for i in x) != whole for t, x in zip((bytes_a, bytes_b), ids)):
            parsed.append(([], [], [], ""))
            continue
        ends = []
        for table, x in zip((bytes_a, bytes_b), ids):
            at = 0
            ends.append([at := at + len(table[i]) for i in x])
        links = [(ids[0][i], ids[1][j]) for i, j in overlaps(*ends)]
        common, groups, i, j = set(ends[0]) & set(ends[1]), [], 0, 0
        for end in sorted(common):
            i2, j2 = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, ids[0][i:i2])) + "|" + ",".join(map(str, ids[1][j:j2])))
            i, j = i2, j2
        parsed.append((*ids, links, ";".join(groups)))
        counts.update(links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    for (doc_id, _), (a, b, links, groups) in zip(rows, parsed):
        best = sum(counts[x] == top[x[1]] for x in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        yield (doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), best, sum(counts[x] for x in links), digest, groups)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = "the quick  brown\nfoxes <|endoftext|> </s> <s> naïve 漢字 😀 12345 don't\tstop ▁x über-all \x00 __init__ a".split(" ")
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(180)]
    return [*made, (500, None), (501, ""), (502, " "), (503, "<|endoftext|>"), (None, "no id"), (None, "no id"), (504, "word " * 3000), (505, "x" * 5000)]


def test_like_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(ta, "CALL_BYTES", 300)
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, block int, n_best string").repartition(5)
    found = ta.align_tokenizers(docs, A, B).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in found))) == sorted(map(repr, brute(rows)))
    assert sum(r.n_links > 0 for r in found) > 60 and any(0 < r.n_best < r.n_links for r in found)


def test_empty_table_and_without_groups(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align_tokenizers(docs, A, B).collect() == []
    only = spark.createDataFrame([(1, None)], "doc_id long, text string")
    (row,) = ta.align_tokenizers(only, A, B, keep_groups=False).collect()
    assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256) == (0, 0, 0, 0, 0, 0, "")
    assert "groups" not in row.asDict()
