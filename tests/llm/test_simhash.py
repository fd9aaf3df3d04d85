"""SimHash groups against brute force over all pairs."""

import random

import pytest
import xxhash

from sightline.llm import simhash
from sightline.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_plain_one():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 50, 70_000):
        text = " ".join(rng.choice(["Aa", "É", "b\tC", "zzz", "\x1c"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("tile", [2048, 7])
def test_links_connect_like_all_pairs(spark, tile):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    chain, dense = rng.getrandbits(64), rng.getrandbits(64)
    for _ in range(60):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(chain)
        prints.add(dense ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    table = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = simhash.links(table, len(prints), tile=tile)
    got = [(r.a % 2**64, r.b % 2**64) for r in found.collect()]
    assert all((a ^ b) for a, b in got)
    assert classes(got, prints) == classes(near, prints)
    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(found).collect()}
    want = classes(near, prints)
    assert set(roots) == {n for pair in near for n in pair}
    assert all((roots[a] == roots[b]) == (want[a] == want[b]) for a in roots for b in roots)


def test_every_near_pair_shares_a_key():
    rng = random.Random(4)
    for count in (10, 10**5, 10**8, 10**10):
        masks = simhash.block_keys(simhash.block_count(count, 4), 4)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_groups_and_kept_rows(spark):
    rng = random.Random(6)
    vocabulary = [f"word{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = [(5, " ".join(base)), (3, " ".join(base)), (9, " ".join(base).upper()), (20, None), (21, ""), (22, " \n"), (None, None), (8, "one"), (8, "one")]
    for i in range(30, 60):
        own = list(base) if i % 2 else [rng.choice(vocabulary) for _ in range(200)]
        own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicate_groups(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    near = [(a, b) for a in prints for b in prints if a is not None and b is not None and a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = classes(near, [i for i in prints if i is not None])
    assert got == {(i, prints[i], want.get(i, 20)) for i, _ in rows}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_exploded_keys_are_never_broadcast(spark):
    fps = spark.range(1000).selectExpr("xxhash64(id) AS fp")
    plan = simhash.links(fps, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []
