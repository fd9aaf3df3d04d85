"""Substring deduplication against brute force."""

import hashlib
import random

import pytest

from sightline.llm import exchange as X
from sightline.llm.substring_dedup import remove_repeated_passages

SCHEMA = "doc_id long, text string, n_words string, note map<string,int>"


def brute(rows, width=13):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes", [X.BUCKET_BYTES, 600])
def test_like_brute_force(spark, bucket_bytes):
    rng = random.Random(5)
    vocabulary = [f"w{k}" * rng.choice([1, 1, 4, 9]) for k in range(60)] + ["é", "ü" * 30, "\x1c", " x"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = [(None, " ".join(passage)), (None, None), (1, None), (2, ""), (3, " \t\n "), (900, " ".join(passage)), (900, " ".join(passage))]
    for i in range(120):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 12, 13, 14, 60, 300]))]
        if i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[rng.randrange(20) :]
        if i % 11 == 0:
            own = passage * 2
        rows.append((rng.choice([i, i - 5000]), rng.choice([" ", "\n", " \x0b "]).join(own)))
    rows.append((77777, " ".join(["same"] * 50_000)))
    rows.append((77778, "x" * 200_000 + " " + " ".join(["same"] * 13)))
    docs = spark.createDataFrame([(i, t, "clash", {"k": 1}) for i, t in rows], SCHEMA)
    got = remove_repeated_passages(docs, bucket_bytes=bucket_bytes)
    assert got.columns == ["doc_id", "text", "note", "n_words", "n_removed", "kept_sha256"]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute(rows)
    texts = {t for _, t in rows}
    assert all(r.text in texts if not r.n_removed else hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_empty_table(spark):
    assert remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
