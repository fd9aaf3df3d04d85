"""Two-way exchange of compact per-bucket statistics.

A corpus statistic such as "in how many documents does this window occur" has one entry per word.  As Spark
rows such entries cost a multiple of the text.  Here documents are dealt into buckets of a bounded size once;
each bucket sends its sorted entries, delta-coded, to shards of the hash space, and each shard sends its
answers back to the buckets.  An entry costs one to two bytes, a hot entry arrives at most once per bucket,
and no shard and no bucket grows with the corpus: their number does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "__bucket"
#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 8 << 20


def deal(docs: DataFrame, id_column: str, text_column: str, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Documents dealt into buckets by a hash of their id, and the bytes of all texts.

    The returned frame may be used several times in one plan: Spark shuffles the documents once and reuses the
    exchange.  Rows with the same id share a bucket.
    """
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    key: Column = F.pmod(F.xxhash64(F.col(id_column)), F.lit(buckets)).cast("int")
    return docs.withColumn(BUCKET, key).repartition(buckets, BUCKET), total


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; small values cost few bytes."""
    if not len(values):
        return b""
    raw = values.astype(np.uint64)
    planes = max(1, (int(raw.max()).bit_length() + 7) // 8)
    body = raw.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([planes]) + pa.compress(body, "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, planes = int.from_bytes(blob[:8], "little"), blob[8]
    body = pa.decompress(blob[9:], n * planes, "zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(body, np.uint8).reshape(planes, n).T
    return out.view(np.uint64).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers, by their differences."""
    raw = values.astype(np.uint64)
    return pack(np.diff(raw, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def shard_slices(keys: np.ndarray, shard_width: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of ascending keys, for shards that are ranges of ``shard_width`` keys."""
    if not len(keys):
        return []
    shards = keys // np.uint64(shard_width)
    cuts = np.flatnonzero(np.diff(shards)) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return [(int(shards[a]), a, b) for a, b in zip(edges, edges[1:])]


def contains(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` occur in ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == wanted
