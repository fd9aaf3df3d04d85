"""Language-model scoring: word counts against brute force, the attention model against its definition."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import attention_lm as A
from sightline.llm import bpe
from sightline.llm import lm_scoring as L

SCHEMA = "doc_id long, text string, score string, train boolean"


@pytest.fixture(scope="module")
def tokens():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def random_model(tokens, seed=0):
    rng = np.random.default_rng(seed)
    classes = L.class_of_subwords(tokens)
    w = A.initial(classes, rng.integers(0, 50, A.VOCABULARY))
    return classes, {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in w.items()}


def slow_score(w, classes, ids):
    """Window by window, token by token, in double precision, with a softmax over the whole vocabulary."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    member, total, given = A.member_of(classes), 0.0, [A.END, *ids[:-1]]
    for t, target in enumerate(ids):
        window = 0 if t < A.CONTEXT else -(-(t - A.CONTEXT + 1) // A.STRIDE)
        start = window * A.STRIDE
        x = np.array([w["E"][i] for i in given[start : t + 1]]) + w["P"][: t + 1 - start]
        a = np.exp((x[-1] @ w["Q"]) @ (x @ w["K"]).T / math.sqrt(A.WIDTH))
        h = x[-1] + (a / a.sum()) @ (x @ w["V"]) @ w["O"]
        by_class = np.exp(h @ w["C"] + w["c"])
        inner = np.exp(np.einsum("d,kdm->km", h, w["M"]) + w["m"])
        p = (by_class / by_class.sum())[classes] * (inner / inner.sum(1, keepdims=True))[classes, member]
        assert abs(p.sum() - 1) < 1e-9
        total += math.log(p[target])
    return total


def test_each_token_is_scored_once(tokens):
    classes, w = random_model(tokens)
    rng = np.random.default_rng(1)
    sizes = [1, 2, A.CONTEXT - 1, A.CONTEXT, A.CONTEXT + 1, A.CONTEXT + A.STRIDE, A.CONTEXT + A.STRIDE + 1, 130, 1]
    streams = [[*rng.integers(0, A.END, n - 1).tolist(), A.END] for n in sizes]
    first = np.concatenate([[0], np.cumsum(sizes)])
    data = A.windows(np.concatenate(streams), first)
    assert data.counted.sum() == sum(sizes)
    got = A.score(w, classes, np.concatenate(streams), first)
    assert np.allclose(got, [slow_score(w, classes, s) for s in streams], rtol=1e-4)


def test_gradient(tokens):
    classes, w = random_model(tokens, 3)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    rng = np.random.default_rng(2)
    data = A.windows(np.append(rng.integers(0, A.END, 40), A.END), np.array([0, 41]))
    _, g = A.gradient(w, classes, A.member_of(classes), data)
    for name, value in w.items():
        biggest = np.unravel_index(np.abs(g[name]).argmax(), value.shape)
        up, down = ({**w, name: value.copy()} for _ in range(2))
        up[name][biggest] += 1e-5
        down[name][biggest] -= 1e-5
        slope = (A.gradient(up, classes, A.member_of(classes), data)[0] - A.gradient(down, classes, A.member_of(classes), data)[0]) / 2e-5
        assert abs(slope - g[name][biggest]) < 1e-4 * max(1, abs(slope)), name


def test_subwords_are_whole(tokens):
    lexicon = L.Lexicon(pa.array(["The  cat\nÉ É", "", None, "the " * 5, "x" * 5000]))
    ids, first = L.Subwords(tokens).streams(lexicon)
    texts = [b"".join(tokens[i] for i in ids[a : b - 1]) for a, b in zip(first, first[1:])]
    assert texts == [" the cat É É".encode(), b"", b"", b" the" * 5, b" " + b"x" * 5000]
    assert all(ids[b - 1] == A.END for b in first[1:])


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 500])
def test_base_score_like_brute_force(spark, tokens, bucket_bytes):
    rng = random.Random(4)
    vocabulary = [f"W{k}" for k in range(40)] + ["é", "a" * 50]
    rows = [(k, rng.choice([" ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "only here"), (103, "w1 " * 20_000), (5, rows[5][1]), (None, "w1 w2")]
    data = [(i, t, "clash", None if i is None else i % 5 != 1) for i, t in rows]
    got = L.score_documents(spark.createDataFrame(data, SCHEMA), F.col("train"), tokens, steps=20, bucket_bytes=bucket_bytes).collect()
    split = lambda t: [w.lower() for w in (t or "").encode().split()] + [None]
    c = Counter(w for _, t, _, train in data if train for w in split(t))
    n, base = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    want = sorted((str(i), not train, len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10(c[w] + 0.5) - base for w in split(t)), 6)) for i, t, _, train in data)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_model_learns(spark, tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    got = {steps: L.score_documents(docs, part != 1, tokens, steps=steps).where("held_out").agg(F.sum("score"), F.sum("base_score")).first() for steps in (0, 300)}
    assert got[300][0] > 0.75 * got[0][0]


def test_empty_table(spark, tokens):
    assert L.score_documents(spark.createDataFrame([], SCHEMA), F.col("train"), tokens, steps=2).collect() == []


def test_score_learns_from_documents_outside_the_sample(spark, tokens):
    """With a sample of no document, what the model knows comes from the pass over all of them."""
    rows = [(k, "the cat sat on the mat and the dog lay by the door " * 20, None, k % 5 != 1) for k in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {steps: L.score_documents(docs, F.col("train"), tokens, sample_bytes=0, steps=steps, bucket_bytes=400_000).where("held_out").agg(F.sum("score")).first()[0] for steps in (0, 1)}
    assert got[1] > 0.5 * got[0]


def test_counts_and_model_beat_counts(spark, tokens):
    """With the corpus counts beside it, the model gives held-out documents more than word frequencies alone do."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = L.score_documents(docs, part != 1, tokens, steps=600, count_share=L.COUNT_SHARE).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_mixture_by_words(spark, tokens):
    """The mixture against its definition, from the same model and the counts."""
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice(["the", "cat", "sat", "unheardof", "é"]) for _ in range(rng.randrange(9))), None, k % 4 != 1) for k in range(40)]
    docs = spark.createDataFrame([*rows, (90, None, None, False), (91, "", None, True)], SCHEMA)
    got = {share: {r.doc_id: r for r in L.score_documents(docs, F.col("train"), tokens, steps=0, count_share=share).collect()} for share in (0.0, 0.3, 1 - 1e-12)}
    c = Counter(w for _, t, _, train in rows if train for w in [*t.split(), None]) + Counter({None: 1})
    base = sum(c.values()) + 0.5 * (len(c) + 1)
    words = [len(t.split()) for _, t, _, _ in rows]
    assert max(words) > 4 and min(words) == 0
    classes = L.class_of_subwords(tokens)
    w = A.initial(classes, np.bincount(L.Subwords(tokens).streams(L.Lexicon(pa.array([r[1] for r in rows if r[3]] + [""])))[0], minlength=A.VOCABULARY))
    for k, t, _, _ in rows:
        lexicon = L.Lexicon(pa.array([t]))
        ids, first = L.Subwords(tokens).streams(lexicon)
        logs, at, total = A.token_scores(w, classes, ids, first), 0, 0.0
        for word in [*t.split(), None]:
            n = 1 if word is None else int(L.Subwords(tokens).encode([word.encode()]).sizes[0])
            total += math.log(0.3 * (c[word] + 0.5) / base + 0.7 * math.exp(logs[at : at + n].sum()))
            at += n
        assert abs(got[0.3][k].score - total / math.log(10)) < 1e-4 * max(1, abs(total))
        assert abs(got[1 - 1e-12][k].score - got[0.0][k].base_score) < 1e-6
        assert abs(got[0.0][k].score - logs.sum() / math.log(10)) < 1e-4 * max(1, abs(logs.sum()))
