"""Cross-tokenizer alignment: groups of tokens with common borders, linked pairs and their corpus-wide counts.

Two tokenizers cut the same bytes.  Their tokens are aligned by their end offsets: at the current index shift an
exponential probe compares slices of the two arrays of ends and jumps whole one-to-one stretches; an irregular
group is walked token by token, which gives its links and the next shift.

Link counts are corpus-wide.  The documents of a task are taken in blocks of a bounded size; a block keeps its
distinct pairs of ids once, and each document keeps places in that list.  One plain row for each block and pair
goes to the counts and back, so a pair that occurs everywhere has one row a block.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.textarrays import bounded
from sightline.session import materialise

#: Bytes of text in a block, and of the texts that are encoded together.
BLOCK_BYTES = 8 << 20
CALL_BYTES = 1 << 20

#: Distinct words whose ids a worker remembers.
MEMORY = 500_000
#: Characters that some standard counts as white space or control; any other ends a word where a space follows.
_DOUBTFUL = r"\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff"
#: A word with the space before it; a space after a doubtful character does not end one.
_CHUNK = re.compile(rf" ?[^ ]+(?:(?<=[{_DOUBTFUL}]) [^ ]*)*| (?:(?<=[{_DOUBTFUL}]) [^ ]*)*")
_JOINS = re.compile(rf" .*[^{_DOUBTFUL}]", re.DOTALL).fullmatch

Encoder = Callable[[list[str]], list[np.ndarray]]


def _byte_of_character() -> dict[str, int]:
    """The byte for each character of byte-level vocabularies: printable bytes stand for themselves, the others
    follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level_tokenizer(content: bytes) -> tuple[Encoder, list[bytes]]:
    """Encoder of " " + text by a byte-level file of the tokenizers library, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.encode_special_tokens = True
    byte_of = _byte_of_character()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    entries = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        entries[i] = bytes(map(byte_of.__getitem__, entry)) if all(c in byte_of for c in entry) else entry.encode()
    sizes = np.array([len(e) for e in entries])
    # only a byte-level pattern without normalisation always cuts before a space that follows another character
    cuts = tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, ByteLevel)

    def encoded(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(new: list[str]) -> Iterator[tuple[str, bytes]]:
        alone = [c for c in new if not _JOINS(c)]
        yield from ((c, ids.tobytes()) for c, ids in zip(alone, encoded(alone)))
        joined = [c for c in new if _JOINS(c)]
        for at in range(0, len(joined), 10_000):  # many words are one text: a call for each would cost more than its tokens
            words = joined[at : at + 10_000]
            (ids,) = encoded(["".join(words)])
            last = (4 * np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(w.encode()) for w in words])) + 4).tolist()
            raw = ids.tobytes()
            yield from ((w, raw[i:j]) for w, i, j in zip(words, [0, *last], last))

    return _by_word(learn) if cuts else lambda texts: encoded([" " + t for t in texts]), entries


def piece_tokenizer(content: bytes) -> tuple[Encoder, list[bytes]]:
    """Encoder of text by a sentencepiece model that adds a space, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    pieces = model.id_to_piece(list(range(model.get_piece_size())))
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encoded(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in model.encode(texts, num_threads=1)]

    def learn(new: list[str]) -> Iterator[tuple[str, bytes]]:
        space = np.array([model.piece_to_id("▁")], np.int32).tobytes()
        yield from ((c, ids.tobytes() if c != " " else space) for c, ids in zip(new, encoded([c[1:] for c in new])))

    # words are encoded alone if no piece reaches from a word over the space after it, and the model adds one space
    cuts = not any("▁" in p.lstrip("▁") for p in pieces) and [b"".join(entries[i] for i in ids) for ids in encoded(["a", " a"])] == [b" a", b"  a"]
    return _by_word(learn) if cuts and model.piece_to_id("▁") != model.unk_id() else encoded, entries


def _by_word(learn: Callable[[list[str]], Iterator[tuple[str, bytes]]]) -> Encoder:
    """An encoder that asks ``learn`` for each new word and remembers its ids, as bytes."""
    known: dict[str, bytes] = {}

    def encode(texts: list[str]) -> list[np.ndarray]:
        words = [_CHUNK.findall(" " + t) for t in texts]
        new = {w for w in chain.from_iterable(words) if w not in known}
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = set(chain.from_iterable(words))
        known.update(learn(list(new)))
        return [np.frombuffer(b"".join(map(known.__getitem__, w)), np.int32) for w in words]

    return encode


def align(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Stretches (i, i2, j, j2) that cover both token lists, in order.

    Both lists of ends are ascending and have the same last end.  A stretch whose first ends are equal is a run of
    one-to-one groups, found by exponential probing at the current index shift; every other stretch is one group.
    """
    stretches = []
    ends_a, ends_b = [*ends_a, -1], [*ends_b, -2]  # ends that differ, so that probes stop there
    i, shift, n = 0, 0, len(ends_a) - 1
    while i < n:
        j = i + shift
        a, b = ends_a[i], ends_b[j]
        if a == b:
            run = 1
            if ends_a[i + 1] == ends_b[j + 1]:
                run = 2
                while ends_a[i + run : i + 2 * run] == ends_b[j + run : j + 2 * run]:
                    run *= 2
                step = run
                while step > 1:
                    step //= 2
                    if ends_a[i + run : i + run + step] == ends_b[j + run : j + run + step]:
                        run += step
            stretches.append((i, i + run, j, j + run))
            i += run
            continue
        start_a, start_b = i, j
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        i, j = i + 1, j + 1
        stretches.append((start_a, i, start_b, j))
        shift = j - i
    return stretches


def groups_of(stretches: list[tuple[int, int, int, int]], ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the places after its last token of A and of B."""
    i, i2, j, j2 = np.array(stretches, np.int64).reshape(-1, 4).T
    size = np.where(ends_a[i] == ends_b[j], i2 - i, 1)  # groups of the stretch
    back = np.repeat(np.cumsum(size), size) - np.arange(1, size.sum() + 1)  # groups after this one in its stretch
    return np.repeat(i2, size) - back, np.repeat(j2, size) - back


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked tokens of A and B, in order: the bytes between two neighbouring ends, of either, belong
    to one token of each, and so every link owns one such stretch of bytes."""
    is_a, is_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
    is_a[ends_a] = is_b[ends_b] = True
    ends = np.flatnonzero(is_a | is_b)
    return (np.cumsum(is_a) - is_a)[ends], (np.cumsum(is_b) - is_b)[ends]


class _Aligner:
    """Encodes and aligns texts; lives in one Python worker."""

    def __init__(self, content_a: bytes, content_b: bytes):
        (self.encode_a, bytes_a), (self.encode_b, bytes_b) = byte_level_tokenizer(content_a), piece_tokenizer(content_b)
        self.bytes_a, self.bytes_b = np.array(bytes_a, object), np.array(bytes_b, object)
        self.sizes_a, self.sizes_b = np.array([len(x) for x in bytes_a]), np.array([len(x) for x in bytes_b])
        self.names_a = [np.array([f"{i}{mark}" for i in range(len(bytes_a))], object) for mark in ",|"]
        self.names_b = [np.array([f"{i}{mark}" for i in range(len(bytes_b))], object) for mark in ",;"]

    def rows(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """(n_a, n_b, n_groups, groups, linked pairs as a << 32 | b) for each text."""
        for text, a, b in zip(texts, self.encode_a(texts), self.encode_b(texts)):
            whole = b" " + text.encode()
            if not text or any(b"".join(table[ids].tolist()) != whole for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
                yield 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            ids_a, ids_b = a.astype(np.int64), b.astype(np.int64)
            ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
            last_a, last_b = groups_of(align(ends_a.tolist(), ends_b.tolist()), ends_a, ends_b)
            link_a, link_b = links_of(ends_a, ends_b)
            yield len(a), len(b), len(last_a), self._written(ids_a, ids_b, last_a, last_b), ids_a[link_a] << 32 | ids_b[link_b]

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """The groups as text: the tokens of A, then those of B, group by group."""
        out = np.empty(len(ids_a) + len(ids_b), object)
        group_a, group_b = (np.repeat(np.arange(len(last)), np.diff(last, prepend=0)) for last in (last_a, last_b))
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b])[group_a]
        place_b = np.arange(len(ids_b)) + last_a[group_b]
        out[place_a], out[place_b] = self.names_a[0][ids_a], self.names_b[0][ids_b]
        out[place_a[last_a - 1]], out[place_b[last_b - 1]] = self.names_a[1][ids_a[last_a - 1]], self.names_b[1][ids_b[last_b - 1]]
        return "".join(out.tolist())[:-1]


@lru_cache(maxsize=1)
def _aligner(content_a: bytes, content_b: bytes) -> _Aligner:
    """The aligner of this worker: what it remembers serves its later tasks too."""
    return _Aligner(content_a, content_b)


def _blocks(docs: DataFrame, id_column: str, text_column: str, path_a: str, path_b: str, keep_groups: bool) -> DataFrame:
    """One row per document with places in its block's list of pairs, and one row per block with that list."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField(id_column, docs.schema[id_column].dataType),
        *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
        T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()),
        *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("places", "times", "pair_a", "pair_b")),
        T.StructField("pair_n", T.ArrayType(T.LongType())),
    ])

    contents = [open(path, "rb").read() for path in (path_a, path_b)]  # the driver's files; executors need none
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def block_rows(block: int, ids: list[pa.Array], found: list[tuple]) -> pa.RecordBatch:
        n = len(found)
        links = [f[4] for f in found]
        sizes = np.array([len(x) for x in links], np.int64)
        pairs, place = np.unique(np.concatenate(links), return_inverse=True)
        keyed, times = np.unique(np.repeat(np.arange(n), sizes) * (len(pairs) or 1) + place, return_counts=True)
        owner = keyed // (len(pairs) or 1)
        offsets = pa.array([*np.searchsorted(owner, np.arange(n + 1)).tolist(), len(keyed)], pa.int32())
        inside = pa.array(np.bincount(place, minlength=len(pairs)).astype(np.int64))
        own = pa.concat_arrays([*ids, pa.nulls(1, ids[0].type)])
        mask = pa.array([False] * n + [True])

        def per_document(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)), mask=mask)

        def per_block(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(values)], pa.int32()), values, mask=pa.array([True] * n + [False]))

        columns = [
            pa.array([block] * (n + 1), pa.int64()), own, *(pa.array([*(f[k] for f in found), None], pa.int64()) for k in range(3)),
            pa.array([*sizes.tolist(), None], pa.int64()),
            pa.array([*(f[5] for f in found), None], pa.string()), pa.array([*(f[3] for f in found), None], pa.string()),
            per_document(keyed % (len(pairs) or 1)), per_document(times),
            per_block(pa.array((pairs >> 32).astype(np.int32))), per_block(pa.array((pairs & 0xFFFFFFFF).astype(np.int32))), per_block(inside),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        block = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        found: list[tuple] = []
        held = 0
        for batch in bounded(batches, 1, CALL_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for *sizes, groups, links in aligner.rows(texts):
                digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                found.append((*sizes, groups if keep_groups else None, links, digest))
            ids.append(batch.column(0))
            held += sum(map(len, texts))
            if held >= BLOCK_BYTES:
                yield block_rows(block, ids, found)
                ids, found, held, block = [], [], 0, block + 1
        if found:
            yield block_rows(block, ids, found)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair_a, pair_b, count, best) from (pair_a, pair_b, pair_n): corpus-wide links of a pair of ids, and whether
    no other pair with this B id has more."""
    counts = materialise(pairs.groupBy("pair_a", "pair_b").agg(F.sum("pair_n").alias("count")), "pair_counts")
    top = counts.groupBy("pair_b").agg(F.max("count").alias("top"))
    return counts.join(top, "pair_b").select("pair_a", "pair_b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", keep_groups: bool = True,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row.

    ``path_a`` is a byte-level file of the tokenizers library, applied to " " + text, ``path_b`` a sentencepiece
    model, applied to the text; no special tokens.  Byte offsets where tokens of both end cut them into
    ``groups``: ``a1,a2|b1;a3|b2,b3`` with decimal ids.  Links are the token occurrences with overlapping bytes.
    The count of a pair of ids is the number of its links in all rows; ``n_best`` counts the row's links whose
    count is the highest of their B id, ties included, and ``count_sum`` sums the counts over the row's links.

    Null and empty texts and those whose tokens do not give the bytes back have zeros and ''.  Rows may repeat and
    ids may be null or shared: each row counts.  Other columns are ignored.  ``keep_groups=False`` leaves
    ``groups`` out.
    """
    blocks = materialise(_blocks(docs, id_column, text_column, path_a, path_b, keep_groups), "token_blocks")
    zipped = F.arrays_zip("pair_a", "pair_b", "pair_n")
    pairs = blocks.where("pair_a IS NOT NULL").select(F.col("block").alias("of_block"), F.posexplode(zipped).alias("at", "pair")).select("of_block", "at", "pair.*")
    counts = materialise(pair_counts(pairs), "best_pairs")
    answers = pairs.join(counts, ["pair_a", "pair_b"]).select("of_block", "at", "count", "best")
    rows = blocks.where("pair_a IS NULL").drop("pair_a", "pair_b", "pair_n")
    if not keep_groups:
        rows = rows.drop("groups")
    kept = [c for c in rows.columns if c not in ("block", "places", "times")]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def score(documents: pa.Table, answered: pa.Table) -> pa.Table:
        at = answered.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at] = answered.column("count").to_numpy()
        best[at] = answered.column("best").to_numpy(zero_copy_only=False)
        lists, times = (documents.column(c).combine_chunks() for c in ("places", "times"))
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        places, weight = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def total(values: np.ndarray) -> pa.Array:
            sums = np.zeros(len(lists), np.int64)
            np.add.at(sums, owner, values[places] * weight)
            return pa.array(sums)

        return pa.table([*(documents.column(c) for c in kept), total(best), total(count)], names=schema.names)

    return rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(score, schema)
