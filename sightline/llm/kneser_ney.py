"""N-gram models with modified Kneser-Ney smoothing over bytes or characters, one per label, in sorted hash arrays.

A text is a sequence of symbols of ``bits`` bits: its bytes, or numbers of its characters (see :func:`characters`).
Spark counts the n-grams of all texts: each task folds its texts to distinct n-grams, Spark adds the counts up.
Every distinct n-gram of a label is in its model, with some 12 bytes for each order: the driver and the workers
hold the models whole, so their memory follows the number of distinct n-grams, which grows far slower than the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.textarrays import bounded, mix

ORDER = 5
#: Bits of a symbol: bytes, and characters.
BYTE_BITS, CHARACTER_BITS = 8, 12
#: Bytes of text that are coded at a time.
CHUNK = 1 << 19


Symbols = bytes | np.ndarray


def characters(text: str) -> np.ndarray:
    """Symbols of ``CHARACTER_BITS`` for the characters of a text: code points below U+0F00 stand for themselves (the
    alphabets up to Tibetan); those of larger scripts share the last 256 numbers by a hash."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() >= 0xF00:
        points = np.where(points < 0xF00, points, 0xF00 + (points * np.uint32(2654435761) >> np.uint32(24)))
    return points.astype(np.uint16)


def codes_of(data: np.ndarray, order: int, bits: int = BYTE_BITS) -> np.ndarray:
    """The n-gram that ends at each symbol from the ``order``-th on, as a number; its last symbol is the lowest."""
    n = len(data) - order + 1
    code = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        code <<= np.uint64(bits)
        code |= data[k : k + len(code)].astype(np.uint64)
    return code


def _joined(texts: list[Symbols], pad: int) -> np.ndarray:
    """The texts one after the other, each preceded by ``pad`` spaces."""
    if isinstance(texts[0], bytes):
        return np.frombuffer(b"".join(b" " * pad + t for t in texts), np.uint8)
    space = np.full(pad, 32, np.uint16)
    return np.concatenate([part for t in texts for part in (space, t)])


def text_codes(texts: list[Symbols], order: int, bits: int = BYTE_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, index of the text of each code): one code for each symbol; a text is preceded by spaces."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        group = texts[at:stop]
        sizes = np.array([len(t) for t in group])
        if len(group) == 1 and size > CHUNK:  # one long text, in pieces that overlap by the context
            whole = _joined(group, order - 1)
            for a in range(0, size, CHUNK):
                code = codes_of(whole[a : a + CHUNK + order - 1], order, bits)
                yield code, np.full(len(code), at)
        elif size:
            code = codes_of(_joined(group, order - 1), order, bits)
            ends = np.cumsum(sizes + order - 1)
            inside = np.ones(ends[-1], bool)  # n-grams that run into the spaces of the next text do not count
            for k in range(1, order):
                inside[ends - k] = False
            yield code[inside[: len(code)]], np.repeat(np.arange(at, stop), sizes)
        at = stop


def count_ngrams(
    rows: DataFrame, label: str | Column, text: str | Column, prepare: Callable[[str], Symbols], order: int = ORDER, bits: int = BYTE_BITS,
) -> DataFrame:
    """(label, code, n) over all rows; rows with a null label or text do not count."""
    texts = rows.select(F.col(label) if isinstance(label, str) else label, F.col(text) if isinstance(text, str) else text)
    texts = texts.toDF("label", "text").where("label IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        pending = 0
        for batch in bounded(batches, 1):
            by_label: dict[str, list[Symbols]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_label.setdefault(name, []).append(prepare(value))
            for name, values in by_label.items():
                for code, _ in text_codes(values, order, bits):
                    found = np.unique(code, return_counts=True)
                    held.setdefault(name, []).append(found)
                    pending += len(found[0])
            if pending > 2_000_000:
                held = {k: [_folded(v)] for k, v in held.items()}
                pending = sum(len(v[0][0]) for v in held.values())
                if pending > 1_000_000:
                    yield from _rows(held)
                    held, pending = {}, 0
        yield from _rows({k: [_folded(v)] for k, v in held.items()})

    parts = texts.mapInArrow(run, "label string, code long, n long")
    return parts.groupBy("label", "code").agg(F.sum("n").alias("n"))


def _folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def _rows(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for name, [(code, n)] in held.items():
        for a in range(0, len(code), 50_000):
            part = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(code[part]), pa.string()), pa.array(code[part].view(np.int64)), pa.array(n[part])], names=["label", "code", "n"],
            )


@dataclass
class Model:
    """Natural log-probabilities of n-grams of all orders, and backoff weights of contexts, by ascending hash."""

    order: int
    bits: int
    grams: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    backoffs: np.ndarray

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """log P(last symbol | symbols before it) of each n-gram."""
        result = np.full(len(codes), np.nan)
        open_, back = np.arange(len(codes)), np.zeros(len(codes))
        for n in range(self.order, 0, -1):
            code = codes[open_] & _mask(n, self.bits)
            hit, value = _find(self.grams, self.logs, _key(code, n))
            result[open_[hit]] = back[hit] + value[hit]
            context_hit, weight = _find(self.contexts, self.backoffs, _key(code >> np.uint64(self.bits), n - 1))
            back = (back + np.where(context_hit, weight, 0.0))[~hit]
            open_ = open_[~hit]
        result[open_] = back - self.bits * np.log(2)
        return result


def _mask(n: int, bits: int) -> np.uint64:
    return np.uint64((1 << (bits * n)) - 1)


def _key(code: np.ndarray, n: int) -> np.ndarray:
    return mix(code + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted, values[at].astype(np.float64)


def build_model(codes: np.ndarray, counts: np.ndarray, order: int = ORDER, bits: int = BYTE_BITS) -> Model:
    """Interpolated modified Kneser-Ney from the counts of distinct n-grams of the highest order."""
    by_order = {order: (codes.astype(np.uint64), counts.astype(np.float64))}
    for n in range(order - 1, 0, -1):  # in how many longer n-grams does each n-gram continue
        by_order[n] = tuple(np.unique(by_order[n + 1][0] & _mask(n, bits), return_counts=True))
    grams, logs, contexts, backoffs = [], [], [], []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, order + 1):
        code, count = by_order[n]
        ordered = np.argsort(code)
        code, count = code[ordered], count[ordered].astype(np.float64)
        tally = [(count == k).sum() for k in (1, 2, 3, 4)]
        y = tally[0] / max(1, tally[0] + 2 * tally[1])
        discount = np.array([k - (k + 1) * y * tally[k] / max(1, tally[k - 1]) for k in (1, 2, 3)])
        # where counts of counts are degenerate, as on tiny corpora, fall back to plain absolute discounting
        discount = np.where((discount > 0) & (discount < [1, 2, 3]), discount, [0.5, 0.75, 1.0])
        cut = discount[np.minimum(count, 3).astype(int) - 1]
        head, group = np.unique(code >> np.uint64(bits), return_inverse=True)
        total = np.bincount(group, count, len(head))
        spare = np.bincount(group, cut, len(head)) / total
        lower = np.full(len(code), 2.0**-bits) if below is None else below[1][np.searchsorted(below[0], code & _mask(n - 1, bits))]
        p = (count - cut) / total[group] + spare[group] * lower
        grams.append(_key(code, n))
        logs.append(np.log(p))
        contexts.append(_key(head, n - 1))
        backoffs.append(np.log(spare))
        below = (code, p)
    return Model(order, bits, *_sorted(grams, logs), *_sorted(contexts, backoffs))


def _sorted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, value = np.concatenate(keys), np.concatenate(values).astype(np.float32)
    ordered = np.argsort(key)
    return key[ordered], value[ordered]


def fit(counts: DataFrame, order: int = ORDER, bits: int = BYTE_BITS) -> dict[str, Model]:
    """A model for each label of ``counts`` (label, code, n), of all its n-grams."""
    table = counts.select("label", "code", "n").toArrow()
    labels = table["label"].combine_chunks().dictionary_encode() if table.num_rows else None
    if labels is None:
        return {}
    if isinstance(labels, pa.ChunkedArray):
        labels = labels.combine_chunks()
    which, codes, n = labels.indices.to_numpy(), table["code"].to_numpy().view(np.uint64), table["n"].to_numpy()
    return {name: build_model(codes[which == k], n[which == k], order, bits) for k, name in sorted(enumerate(labels.dictionary.to_pylist()), key=lambda x: x[1])}


class Scorer:
    """Total log-probabilities of texts under several models; remembers the n-grams a worker meets often."""

    def __init__(self, models: list[Model], memory: int = 1 << 22):
        self.models, self.order, self.symbol_bits = models, models[0].order, models[0].bits
        self.bits = max(8, (memory // len(models)).bit_length() - 1)
        self.known = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.zeros((1 << self.bits, len(models)), np.float32)

    def _values(self, codes: np.ndarray) -> np.ndarray:
        slot = (mix(codes.copy()) >> np.uint64(64 - self.bits)).astype(np.int64)
        miss = self.known[slot] != codes
        if miss.any():
            new = np.unique(codes[miss])
            at = (mix(new.copy()) >> np.uint64(64 - self.bits)).astype(np.int64)
            value = np.stack([m.log_probability(new) for m in self.models], axis=1).astype(np.float32)
            self.known[at], self.values[at] = new, value
            out = self.values[slot]
            out[miss] = value[np.searchsorted(new, codes[miss])]
            clash = ~miss & (self.known[slot] != codes)  # overwritten just now
            if clash.any():
                out[clash] = np.stack([m.log_probability(codes[clash]) for m in self.models], axis=1)
            return out
        return self.values[slot]

    def score(self, texts: list[Symbols]) -> np.ndarray:
        """A row for each text, a column for each model."""
        total = np.zeros((len(texts), len(self.models)))
        for codes, owner in text_codes(texts, self.order, self.symbol_bits):
            if len(codes):
                values = self._values(codes)
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
                total[owner[heads]] += np.add.reduceat(values, heads, axis=0, dtype=np.float64)
        return total
