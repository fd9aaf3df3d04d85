"""SimHash near-duplicate detection: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint has 64 bits.  Two fingerprints that differ in at most ``max_bits`` bits agree on at least
``blocks - max_bits`` of ``blocks`` blocks, so they meet under at least one key made of that many blocks.
Only distinct fingerprints are joined, so copies cost nothing.  ``blocks`` follows the number of distinct
fingerprints, which keeps the chance meetings per fingerprint bounded at every size.

Groups of fingerprints under one key are compared in tiles, and a group yields a spanning forest of its
links, never all its pairs.  Groups beyond ``tile`` fingerprints are split into tiles and each pair of tiles
is compared on its own, so no task holds more than two tiles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.components import connected_components
from sightline.llm.salting import join_to_rows
from sightline.llm.textarrays import bounded
from sightline.session import materialise

BITS = 64
SEED = 42
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of word shingles; ASCII upper case is folded, repeats count, no words give zero."""
    words = (text or "").encode().translate(_ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, fp) of every row, and its ``carry`` columns; ``fp`` is the fingerprint as a signed 64-bit number."""
    kept = docs.select(id_column, *carry)
    schema = T.StructType([*kept.schema.fields, T.StructField("fp", T.LongType())])
    at = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            found = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(id_column, *carry, text_column).mapInArrow(run, schema)


def block_count(fingerprint_count: int, max_bits: int) -> int:
    """Blocks such that a key of ``blocks - max_bits`` blocks has four bits more than the fingerprints need."""
    wanted = math.log2(max(2, fingerprint_count)) + 4
    blocks = max_bits + 1
    while (blocks - max_bits) * (BITS // blocks) < wanted and blocks < 4 * max_bits:
        blocks += 1
    return blocks


def block_keys(blocks: int, max_bits: int) -> list[int]:
    """Bit masks of all choices of ``blocks - max_bits`` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(masks, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fps: np.ndarray, max_bits: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links (fingerprint, root) that connect ``fps`` as all links within ``max_bits`` bits would.

    With ``split``, only links between ``fps[:split]`` and ``fps[split:]`` count.
    """
    n = len(fps)
    label = np.arange(n)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits if n <= 256 else None
    side = np.arange(n) >= (split or 0)
    while True:
        before = label.copy()
        for at in range(0, n, 256):
            rows = slice(at, min(at + 256, n))
            close = near if near is not None else np.bitwise_count(fps[rows, None] ^ fps[None, :]) <= max_bits
            if split is not None:
                close = close & (side[rows, None] != side[None, :])
            best = np.where(close, label[None, :], n).min(axis=1)
            np.minimum.at(label, label[rows].copy(), np.minimum(best, label[rows]))
            label[rows] = np.minimum(label[rows], best)
        label = label[label]
        if (label == before).all():
            return [(int(fps[i]), int(fps[label[i]])) for i in np.flatnonzero(label != np.arange(n))]


def links(fps: DataFrame, fingerprint_count: int, max_bits: int = 4, tile: int = 2048) -> DataFrame:
    """(a, b) links among distinct fingerprints ``fp``, enough to connect all within ``max_bits`` bits."""
    masks = block_keys(block_count(fingerprint_count, max_bits), max_bits)
    keyed = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key")
    )
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("tile")), tiles).cast("int")
    # a fingerprint of tile t meets tile u in the pair (min, max); few groups have more than one tile
    # Spark sizes the exploded keys as if there were one for a fingerprint, so it must not choose what to broadcast
    placed = keyed.join(sizes.hint("merge"), ["choice", "key"]).select(
        "choice", "key", "fp", own.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    )
    pairs = placed.select(
        "choice", "key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "fp"
    )
    grouped = pairs.repartition("choice", "key", "lo", "hi").sortWithinPartitions("choice", "key", "lo", "hi", "tile", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, last = held, True
            else:
                rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
                rows, last = (rows if held is None else np.concatenate([held, rows])), False
            if rows is None or not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), len(rows)]
            found = []
            for a, b in zip(edges, edges[1:] if last else edges[1:-1]):
                if b - a > 1:
                    group, lo, hi = rows[a:b], rows[a, 2], rows[a, 3]
                    split = None if lo == hi else int((group[:, 4] == lo).sum())
                    found += _forest(np.ascontiguousarray(group[:, 5]).view(np.uint64), max_bits, split)
            held = None if last else rows[edges[-2] :]
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return grouped.mapInArrow(compare, "a long, b long").distinct()


def classes(prints: DataFrame, id_column: str, max_bits: int = 4) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint: the least fingerprint of its class, and the least id."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(id_column).alias("least")), "fingerprint_classes")
    found = materialise(links(distinct.select("fp"), distinct.count(), max_bits), "fingerprint_links")
    roots = connected_components(found)
    linked = distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    renamed = linked.join(named, "root").select("fp", "root", "component_id")
    # few fingerprints are linked to others; the class of the rest is named by their own rows
    every = distinct.join(renamed, "fp", "left")
    return every.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, max_bits: int = 4,
) -> DataFrame:
    """(id, fingerprint, component_id): the class of each row under chains of near fingerprints.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id reachable, the row's own
    included.  Null and wordless texts have fingerprint zero and link like any other; rows with equal
    fingerprints share a class.  Rows with a null id get a class but never name it, unless all ids of the
    class are null.  Rows may repeat.  Other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    by_print = materialise(classes(prints, id_column, max_bits).select("fp", "component_id"), "fingerprint_names")
    return join_to_rows(prints, by_print, ["fp"], id_column).select(
        id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, max_bits: int = 4,
) -> DataFrame:
    """One row of each class of near copies, with all its columns: the one with the smallest id, null last.

    A row is known by 128 bits of hash over all its columns, not by its id: unlike texts without id, or with one
    id, are all kept.  Among rows of a class with the same id the one with the least hash stays; rows that
    repeat in every column are one.
    """
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.withColumn("__k1", F.xxhash64(*columns)).withColumn("__k2", F.xxhash64(F.lit("second"), *columns))
    prints = materialise(fingerprints(keyed, id_column, text_column, shingle, carry=("__k1", "__k2")), "fingerprints")
    roots = materialise(classes(prints, id_column, max_bits).select("fp", "root"), "fingerprint_roots")
    placed = join_to_rows(prints, roots, ["fp"], "__k1")
    first = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), F.col("__k1"), F.col("__k2"))
    chosen = placed.groupBy("root").agg(F.min(first).alias("row")).select("row.__k1", "row.__k2")
    copies = prints.groupBy("__k1", "__k2").agg(F.count("*").alias("__rows"))
    kept = materialise(chosen.join(copies, ["__k1", "__k2"]), "kept_rows")

    def rows(which: DataFrame) -> DataFrame:
        # the same join at every size: texts are shuffled once, to where the keys are
        return keyed.join(which.select("__k1", "__k2").hint("merge"), ["__k1", "__k2"], "left_semi")

    if kept.where("__rows > 1").isEmpty():
        return rows(kept).select(docs.columns)
    once = rows(kept.where("__rows > 1")).dropDuplicates(["__k1", "__k2"])
    return rows(kept.where("__rows = 1")).unionByName(once).select(docs.columns)
