"""The pipeline against a brute-force version of its stages."""

import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from sightline.llm import bpe
from sightline.llm.langid import identify
from sightline.llm.queries import BYTE_BPE, fifth
from tests.llm.test_simhash import classes, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_template(text):
    return ["".join(c for c in w.lower() if c.isalnum()) for w in text.split()]


def test_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in identify(docs, fifth() != 0).where("rejected").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    root = classes(near, prints)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    words, first, cut = {i: t.split() for i, t in texts.items()}, {}, {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        cut[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]
    items = [plain_template(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(t[k : k + 13]) for t in items for k in range(len(t) - 12)}
    leaks = {i for i, t in cut.items() if any(tuple(x[k : k + 13]) in grams for x in [plain_template(t)] for k in range(len(x) - 12))}
    tokens = bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, other.encode_ordinary(t))).encode()).hexdigest() for i, t in cut.items() if i not in leaks}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids_sha256 for r in got} == want and len(got) == len(want)
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(cut[i].encode()).hexdigest() for i in want}
    assert leaks


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(50), SF).dtypes == docs.dtypes, name


def test_empty_and_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "the and of " * 2000, None, None, 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_documents_without_own_id(spark):
    """Unlike documents without id, or with one shared id, all stay; a leak takes no other document along."""
    rng = random.Random(8)
    words = "river stone garden letter window market quiet silver morning paper bridge winter candle forest yellow".split()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for ids in (range(40), [None] * 40, [7] * 40):
        rows = [(i, " ".join(rng.choice(words) + str(k) for _ in range(80)), "en", "s", 1) for k, i in enumerate(ids)]
        docs = spark.createDataFrame(rows, schema)
        assert sorted(r.text for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()) == sorted(r[1] for r in rows)
        copies = docs.union(docs).union(spark.createDataFrame([(None, rows[0][1], "en", "s", 1)], schema))
        assert sorted(r.text for r in corpus_pipeline.simhash_dedup(spark, copies, SF).collect()) == sorted(r[1] for r in rows)
        leaking = docs.union(spark.createDataFrame([(ids[0], f"{rows[3][1]} {item}", "en", "s", 1)], schema))
        assert sorted(r.text for r in corpus_pipeline.decontamination(spark, leaking, SF).collect()) == sorted(r[1] for r in rows)
