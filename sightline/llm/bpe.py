"""Byte-level BPE through a sentencepiece model built from a rank file.

Every vocabulary entry becomes a sentencepiece piece: its bytes are mapped to one character each, its score is
its negated rank, so the merge order of sentencepiece is the order of the ranks.  The model has identity
normalisation and no dummy prefix.  A text is split by the pattern of the rank file and each distinct
pre-token of a batch is encoded once; piece ids are ranks.  Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters that stand for the 256 bytes; none is white space or changed by normalisation.
BYTE_BASE = 0x2800
#: Distinct pre-tokens whose ids a worker remembers; older ones are encoded again.
MEMORY = 400_000
#: Pre-tokens of the texts that are encoded together.
GROUP = 300_000


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file with lines of base64 token and rank; read by the driver, once."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | str) -> bytes:
    """A protocol buffer field: an integer, or length-delimited bytes."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_characters(token: bytes) -> str:
    return "".join(chr(BYTE_BASE + b) for b in token)


def build_model(tokens: list[bytes]) -> bytes:
    """Serialise a sentencepiece BPE model with the pieces in the order of their ranks, then the unknown piece."""
    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))

    pieces = [piece(as_characters(t) or f"<unused {rank}>", -float(rank), 1) for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, 2))
    off = (1 << 64) - 1  # -1: these special pieces do not exist
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, off) for n in (41, 42, 43))
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class _Ragged:
    """Rows of different lengths in one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.ends = flat, sizes, np.cumsum(sizes)

    def extended(self, flat: np.ndarray, sizes: np.ndarray) -> _Ragged:
        return _Ragged(np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes]))

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The chosen rows, one after the other."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.ends[rows] - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Tokenizer:
    """Encodes and decodes with a model of :func:`build_model`; lives in one Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None):
        self.whole = {t.decode(): rank for rank, t in enumerate(tokens) if _is_text(t)}
        self.split = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model or build_model(tokens))
        self.bytes_of = _Ragged(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens]))
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = _Ragged(np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.decimals = _Ragged(np.zeros(0, np.uint8), np.zeros(0, np.int64))

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.slots]
        if len(self.slots) + len(new) > MEMORY:
            self._forget()
            new = list(pieces)
        if not new:
            return
        raw = [p.encode() for p in new]
        mapped = (np.frombuffer(b"".join(raw), np.uint8) + np.uint16(BYTE_BASE)).astype("<u2").tobytes().decode("utf-16-le")
        ends = np.cumsum([len(r) for r in raw]).tolist()
        found = self.processor.encode([mapped[a:b] for a, b in zip([0, *ends], ends)], num_threads=1)
        found = [[self.whole[p]] if len(ids) > 1 and p in self.whole else ids for p, ids in zip(new, found)]
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
        self.ids = self.ids.extended(np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found]))
        decimal = [(" ".join(map(str, ids)) + " ").encode() for ids in found]
        self.decimals = self.decimals.extended(np.frombuffer(b"".join(decimal), np.uint8), np.array([len(x) for x in decimal]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """For each text its ids, and the same as decimal numbers joined by one space.

        Texts are taken in groups, since each call of the model has a fixed cost.
        """
        held: list[list[str]] = []
        count = 0
        for text in chain(texts, [None]):
            if text is not None:
                held.append(self.split(text))
                count += len(held[-1])
            if text is None or count >= GROUP:
                self._learn(set(chain.from_iterable(held)))
                for pieces in held:
                    slots = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
                    yield self.ids.take(slots), self.decimals.take(slots)[:-1].tobytes()
                held, count = [], 0

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.take(ids).tobytes()


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """Add ``ids`` (array of int), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` to every row of ``docs``.

    Whole texts, each match of ``pattern`` by itself, no special tokens.  ``ids_sha256`` is the digest of the
    decimal ids joined by one space, ``decoded_sha256`` that of the bytes decoded from the ids.  Null and
    empty texts have no ids.  Existing columns with these names are replaced.  ``keep_ids=False`` leaves the
    id lists out.  The vocabulary is broadcast; its size is that of the rank file.
    """
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if keep_ids:
        added.append(("ids", T.ArrayType(T.IntegerType())))
    docs = docs.drop(*(name for name, _ in added))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added)])
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern, build_model(tokens)))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(*shared.value)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for ids, decimal in tokenizer.encode_all(v.as_py() or "" for v in batch.column(at)):
                columns[0].append(len(ids))
                columns[1].append(hashlib.sha256(decimal).hexdigest())
                columns[2].append(hashlib.sha256(tokenizer.decode(ids)).hexdigest())
                if keep_ids:
                    columns[3].append(ids)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(columns[: len(added)], kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokens: list[bytes], ids_column: str = "ids") -> DataFrame:
    """Add ``decoded`` (bytes) to every row: its ids mapped back; null ids give no bytes.  An existing column is replaced."""
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    at = encoded.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            found = [b"".join(map(token, ids or [])) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)
