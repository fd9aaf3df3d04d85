"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words of one document.  A word goes if a window that covers it has the same
words as a window of a document with a smaller id.  Windows are judged on the input.

1. Each bucket of documents builds a count-min sketch of its windows (``depth`` rows, counters that stop at
   two).  Sketches are merged shard by shard, a shard being a range of cells.  A counter never falls short,
   so every window that two documents share is estimated as repeated.
2. Only windows estimated as repeated are grouped exactly, by 96 bits of hash, to find the first document.
3. Each bucket marks the covered words.

The sketch width follows the number of words, so the share of false candidates is the same at every size, and
no sketch is ever whole in one place.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sightline.llm import exchange as X
from sightline.llm.textarrays import Words, hash_words, mix, split_words, window_hashes

#: Cells of a sketch row for each byte of text; about four for each word.
CELLS_PER_BYTE = 0.75
SHARD_CELLS = 1 << 22
#: Bytes of text in a bucket; a worker holds about 25 times as much in arrays of one entry for each word.
BUCKET_BYTES = 4 << 20
_ROW_SEED = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]

_CELLS = "shard long, __bucket int, cells binary"
_EXACT = "shard long, __bucket int, hashes binary, checks binary, docs binary"
_FIRST = "__bucket int, hashes binary, docs binary"


def _sorted_firsts(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the place of one entry of each, and the smallest id of each."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.zeros(0, np.int64)
    smallest = np.minimum.reduceat(ids[order], heads) if len(heads) else np.zeros(0, np.int64)
    return ordered[heads], order[heads], smallest


class _Windows:
    """Windows of one bucket: hash, first word and document id of each; documents without id have none."""

    def __init__(self, table: pa.Table, id_column: str, text_column: str, width: int, check: bool = False):
        self.words: Words = split_words(table[text_column])
        ids = table[id_column].cast(pa.int64())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        text = self.words.text_of_word
        self.hashes, self.starts = window_hashes(hash_words(self.words, 1), self.words.first, width)
        owner = text[self.starts]
        keep = known[owner]
        if not keep.all():
            self.hashes, self.starts, owner = self.hashes[keep], self.starts[keep], owner[keep]
        self.ids = ids[owner]
        self.checks = None
        if check:
            second, starts = window_hashes(hash_words(self.words, 2), self.words.first, width)
            self.checks = (second[keep] if not keep.all() else second) >> np.uint64(32)

    def cells(self, row: int, width: int) -> np.ndarray:
        """The cell of each window in sketch row ``row``; rows follow each other."""
        h = mix(self.hashes ^ _ROW_SEED[row])
        return (h >> np.uint64(11)) % np.uint64(width) + np.uint64(row * width)


def kept_words(words: Words, text: int, keep: np.ndarray) -> bytes:
    """The kept words of one text, joined by one space."""
    lo, hi = words.first[text], words.first[text + 1]
    data = words.data
    return b" ".join([data[s:e].tobytes() for s, e in zip(words.starts[lo:hi][keep[lo:hi]], words.ends[lo:hi][keep[lo:hi]])])


def remove_repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 13, depth: int = 2,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Return ``docs`` with repeated words removed, and ``n_words``, ``n_removed`` and ``kept_sha256``.

    A text that loses no word is returned unchanged; of another the kept words remain, joined by one space.
    ``kept_sha256`` is always the digest of the kept words joined by one space.
    Null text: no words, stays null.  Texts shorter than ``width`` words: nothing is removed.  Rows that share
    an id are separate documents of equal rank, so they never remove each other.  A null id is never the
    smaller one: such a row keeps all words and removes none.  An existing column with the name of a result
    column is replaced.  Rows keep all other columns; row order is not kept.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", X.BUCKET)
    dealt, total = X.deal(docs, id_column, text_column, bucket_bytes)
    cells = max(SHARD_CELLS // 8, math.ceil(total * CELLS_PER_BYTE))
    hash_shards = max(1, math.ceil(total / (32 << 20)))

    def sketch(table: pa.Table) -> pa.Table:
        bucket = table[X.BUCKET][0].as_py()
        windows, rows = _Windows(table, id_column, text_column, width), []
        for row in range(depth):
            found = np.sort(windows.cells(row, cells))
            if not len(found):
                continue
            heads = np.concatenate([[True], found[1:] != found[:-1]])
            again = np.concatenate([found[1:] == found[:-1], [False]])[heads].astype(np.uint64)
            found = found[heads]
            # the lowest bit tells a counter of one from a counter of two or more
            rows += [(s, bucket, X.pack_sorted(found[a:b] * np.uint64(2) + again[a:b])) for s, a, b in X.shard_slices(found, SHARD_CELLS)]
        return _table(rows, ["shard", X.BUCKET, "cells"], [pa.int64(), pa.int32(), pa.binary()])

    def merge(table: pa.Table) -> pa.Table:
        base, counters, rows = table["shard"][0].as_py() * SHARD_CELLS, np.zeros(SHARD_CELLS, np.uint8), []
        blobs = table["cells"].to_pylist()
        for blob in blobs:
            coded = X.unpack_sorted(blob)
            at = (coded >> np.uint64(1)).astype(np.int64) - base
            counters[at] = np.minimum(counters[at] + 1 + (coded & np.uint64(1)).astype(np.uint8), 2)
        for bucket, blob in zip(table[X.BUCKET].to_pylist(), blobs):
            own = X.unpack_sorted(blob) >> np.uint64(1)
            own = own[counters[own.astype(np.int64) - base] > 1]
            if len(own):
                rows.append((table["shard"][0].as_py(), bucket, X.pack_sorted(own)))
        return _table(rows, ["shard", X.BUCKET, "cells"], [pa.int64(), pa.int32(), pa.binary()])

    def candidates(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not table.num_rows or not repeated.num_rows:
            return _table([], ["shard", X.BUCKET, "hashes", "checks", "docs"], [pa.int64(), pa.int32(), *[pa.binary()] * 3])
        bucket = table[X.BUCKET][0].as_py()
        windows = _Windows(table, id_column, text_column, width, check=True)
        cell = np.sort(np.concatenate([X.unpack_sorted(x) for x in repeated["cells"].to_pylist()]))
        hit = np.ones(len(windows.hashes), bool)
        for row in range(depth):
            hit &= X.contains(cell, windows.cells(row, cells))
        at = np.flatnonzero(hit)
        hashes, place, smallest = _sorted_firsts(windows.hashes[at], windows.ids[at])
        checks, rows = windows.checks[at][place], []
        for s, a, b in X.shard_slices(hashes, min(2**64 // hash_shards + 1, 2**64 - 1)):
            rows.append((s, bucket, X.pack_sorted(hashes[a:b]), X.pack(checks[a:b]), X.pack(smallest[a:b])))
        return _table(rows, ["shard", X.BUCKET, "hashes", "checks", "docs"], [pa.int64(), pa.int32(), *[pa.binary()] * 3])

    def group(table: pa.Table) -> pa.Table:
        parts = [[f(b) for b in table[c].to_pylist()] for c, f in (("hashes", X.unpack_sorted), ("checks", X.unpack), ("docs", X.unpack))]
        hashes, checks, ids = (np.concatenate(p) for p in parts)
        ids = ids.view(np.int64)
        owner = np.repeat(np.array(table[X.BUCKET].to_pylist()), [len(p) for p in parts[0]])
        order = np.lexsort((ids, checks, hashes))
        hashes, checks, ids, owner = hashes[order], checks[order], ids[order], owner[order]
        head = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
        first = ids[np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))]
        later = np.flatnonzero(first < ids)
        later = later[np.argsort(owner[later], kind="stable")]
        rows, owners = [], owner[later]
        edges = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(later)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                rows.append((int(owners[a]), X.pack_sorted(hashes[later[a:b]]), X.pack(first[later[a:b]])))
        return _table(rows, [X.BUCKET, "hashes", "docs"], [pa.int32(), pa.binary(), pa.binary()])

    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def remove(table: pa.Table, firsts: pa.Table) -> pa.Table:
        windows = _Windows(table, id_column, text_column, width)
        words, keep = windows.words, np.ones(len(windows.words.starts), bool)
        if len(windows.hashes):
            hashes, _, smallest = _sorted_firsts(windows.hashes, windows.ids)
            if firsts.num_rows:
                far = np.concatenate([X.unpack_sorted(x) for x in firsts["hashes"].to_pylist()])
                first = np.concatenate([X.unpack(x) for x in firsts["docs"].to_pylist()]).view(np.int64)
                at = np.searchsorted(hashes, far)
                np.minimum.at(smallest, at, first)
            gone = windows.starts[smallest[np.searchsorted(hashes, windows.hashes)] < windows.ids]
            cover = np.zeros(len(keep) + 1, np.int64)
            cover[gone] += 1
            cover[np.minimum(gone + width, len(keep))] -= 1  # one window starts at a word, so one ends there
            keep = np.cumsum(cover[:-1]) == 0
        total_words = np.diff(words.first)
        texts, kept, removed = table[text_column].to_pylist(), [], []
        for i, n in enumerate(total_words):
            joined = kept_words(words, i, keep)
            kept.append(hashlib.sha256(joined).hexdigest())
            removed.append(int(n - keep[words.first[i] : words.first[i + 1]].sum()))
            if removed[-1]:
                texts[i] = joined.decode()
        at = table.column_names.index(text_column)
        result = table.set_column(at, table.schema.field(at), pa.chunked_array([pa.array(texts, table.schema.field(at).type)]))
        result = result.drop_columns([X.BUCKET])
        for name, values, kind in (("n_words", total_words, pa.int64()), ("n_removed", removed, pa.int64()), ("kept_sha256", kept, pa.string())):
            result = result.append_column(name, pa.array(values, kind))
        return result

    repeated = dealt.groupBy(X.BUCKET).applyInArrow(sketch, _CELLS).groupBy("shard").applyInArrow(merge, _CELLS)
    exact = dealt.groupBy(X.BUCKET).cogroup(repeated.groupBy(X.BUCKET)).applyInArrow(candidates, _EXACT)
    firsts = exact.groupBy("shard").applyInArrow(group, _FIRST)
    return dealt.groupBy(X.BUCKET).cogroup(firsts.groupBy(X.BUCKET)).applyInArrow(remove, out)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
