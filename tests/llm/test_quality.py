"""Quality rules against brute force, and the n-gram models against their definition."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import kneser_ney as K
from sightline.llm.quality import base_counts, judge
from sightline.llm.textarrays import bounded

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, kept string"


def brute(text):
    words = [w.decode() for w in (text or "").encode().split()]
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if line.strip(SPACE)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def random_text(rng, n):
    return "".join(rng.choice(["a", "b ", "c\n", "é ", "#", "|\n", "\x1c", " ", "word ", "漢"]) for _ in range(n))


def test_base_counts_like_brute_force():
    rng = random.Random(1)
    texts = [None, "", "\n", "a b c a b c", "x " * 70_000] + [random_text(rng, rng.randrange(200)) for _ in range(300)]
    counts = base_counts(pa.array(texts))
    got = list(zip(*(counts[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute(t) for t in texts]


def test_bounded_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c" * 5] * 50)], names=["t"])
    parts = list(bounded(iter([batch]), 0, 64))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist() and len(parts) > 50


def slow_model(texts, order):
    """Dictionary version of interpolated modified Kneser-Ney over bytes."""
    counts = {order: Counter()}
    for t in texts:
        padded = b" " * (order - 1) + t
        counts[order].update(padded[k : k + order] for k in range(len(padded) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = {}
    for n in range(1, order + 1):
        t = [sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]
        y = t[0] / max(1, t[0] + 2 * t[1])
        d = [k - (k + 1) * y * t[k] / max(1, t[k - 1]) for k in (1, 2, 3)]
        d = [x if 0 < x < k else f for x, k, f in zip(d, (1, 2, 3), (0.5, 0.75, 1.0))]
        total, spare = defaultdict(float), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            spare[g[:-1]] += d[min(c, 3) - 1]
        tables[n] = (counts[n], d, total, spare)

    def p(g):
        if not g:
            return 1 / 256
        c, d, total, spare = tables[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        return max(0, c[g] - d[min(c[g], 3) - 1] if c[g] else 0) / total[g[:-1]] + spare[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_model_like_its_definition(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab bcé ") for _ in range(rng.randrange(60))) for _ in range(80)] + ["", "x" * 3000]
    rows = spark.createDataFrame([(rng.choice(["l", "m"]), t) for t in texts] + [(None, "n"), ("l", None)], "lang string, text string")
    counts = K.count_ngrams(rows, "lang", "text", str.encode, 3)
    models = K.fit(counts, 3)
    by_label = {"l": [], "m": []}
    for r in rows.collect():
        if r.lang and r.text is not None:
            by_label[r.lang].append(r.text.encode())
    new = [b"", b"ab", b"zzz a", "é bc".encode(), b"q" * 50, *[t.encode() for t in texts[:20]]]
    got = K.Scorer([models["l"], models["m"]], memory=64).score(new)
    for k, name in enumerate("lm"):
        p = slow_model(by_label[name], 3)
        want = [sum(math.log(p((b"  " + t)[i : i + 3])) for i in range(len(t))) for t in new]
        assert np.allclose(got[:, k], want, rtol=1e-4), name


def test_long_texts_in_pieces(monkeypatch):
    text = bytes(random.Random(3).choices(b"abc d", k=5000))
    whole = [c for c, _ in K.text_codes([b"q", text, b"", b"rs"], 4)]
    monkeypatch.setattr(K, "CHUNK", 64)
    parts = list(K.text_codes([b"q", text, b"", b"rs"], 4))
    assert np.array_equal(np.concatenate(whole), np.concatenate([c for c, _ in parts]))
    assert np.array_equal(np.bincount(np.concatenate([o for _, o in parts]), minlength=4), [1, 5000, 0, 2])


def test_verdicts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    clean = [(k, " ".join(rng.choice(words) for _ in range(120)), rng.choice(["en", None]), "x") for k in range(200)]
    noise = [(1000 + k, " ".join("".join(rng.choice("XQZ0123456789@^~") for _ in range(9)) for _ in range(80)), "en", "x") for k in range(4)]
    bad = [(2000, "too short", "en", "x"), (2001, "the same line\n" * 60, "en", "x"), (2002, None, "en", "x"), (2003, "", None, "x"), (None, clean[0][1], "other", "x"), clean[0]]
    got = judge(spark.createDataFrame(clean + noise + bad, SCHEMA))
    assert got.columns == ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "low", "high", "kept"]
    rows = got.collect()
    assert len(rows) == 210
    texts = dict((i, t) for i, t, *_ in clean + noise + bad)
    for r in rows:
        n, chars, symbols, lines, repeat = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
    kept = Counter((r.doc_id // 1000 if r.doc_id is not None else -1, r.kept) for r in rows)
    assert kept == {(0, True): 201, (1, False): 4, (2, False): 4, (-1, True): 1}


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_symbols_alone_are_not_kept(spark):
    rng = random.Random(6)
    junk = " ".join("".join(rng.choice("#*$%&|<>!?-") for _ in range(7)) for _ in range(80))
    clean = " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(80))
    got = judge(spark.createDataFrame([(1, junk, "en", "x"), (2, clean, "en", "x"), (3, junk, None, "x")], SCHEMA)).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in got} == {1: (False, False), 2: (False, True), 3: (False, False)}


@pytest.mark.parametrize("share", [0.01, 0.05])
def test_random_junk_is_rejected(spark, share):
    """Texts of random letters and digits, as many as one in twenty, among the given documents."""
    rng = random.Random(11)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang IS NOT NULL")
    n = docs.count()
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(2, 10)))
    junk = [(-k - 1, " ".join(word() for _ in range(rng.randrange(60, 300))), rng.choice(["en", "de", "fr", "es"])) for k in range(int(share * n))]
    rows = judge(docs.union(spark.createDataFrame(junk, docs.schema))).where("NOT base_failed").collect()
    kept = Counter((r.doc_id < 0, r.kept) for r in rows)
    assert kept[True, False] >= 0.9 * len(junk) and kept[True, True] + kept[True, False] == len(junk)
    assert kept[False, True] >= 0.985 * (kept[False, True] + kept[False, False])


def test_bands_like_brute_force(spark):
    """Quartiles and verdicts from the measured perplexities, in plain Python, with copies counted once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = judge(docs.union(docs.where("doc_id < 20")), carry_text=True).collect()
    by_lang = {}
    for r in rows:
        if not r.base_failed:
            by_lang.setdefault(r.lang, {})[r.text] = r.log_perplexity
    for r in rows:
        values = sorted(by_lang[r.lang].values())
        q1, q3 = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.75))
        low, high = q1 - max(6 * (q3 - q1), 1.0), q3 + max(4 * (q3 - q1), 0.4)
        assert (abs(r.low - low), abs(r.high - high)) < (1e-9, 1e-9)
        assert r.kept == (not r.base_failed and low <= r.log_perplexity <= high)
