"""Fill-in-middle transformation by in-place block rotation.

A text becomes a bytearray.  A scan finds the byte offsets of the two cuts, the sentinels are inserted before
prefix, middle and suffix, and blocks of the array are exchanged by rotations, each made of three reversals.
The inverse finds the sentinels, rotates back and takes them out.  A reversal swaps pieces of a bounded size,
so a text needs one array and no second copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sightline.llm.textarrays import bounded

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that a reversal swaps at a time.
PIECE = 1 << 16


@dataclass(frozen=True)
class Sentinels:
    """The strings before prefix, suffix and middle.  Each begins and ends with characters that it holds only
    there, so no text joined to one can make another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(_overlap(a, b) for a in marks for b in marks):
            raise ValueError("sentinels must differ, and none may begin with the end of one or hold one")


def _overlap(a: str, b: str) -> bool:
    """Whether an occurrence of ``b`` can begin inside ``a`` and is not ``a`` itself, or ``b`` is empty."""
    return not b or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))) or (a != b and b in a)


@dataclass(frozen=True)
class Rates:
    """Percent of texts that stay plain, and percent of the others with the suffix first."""

    plain: int = 10
    spm: int = 20
    seed: str = "1"


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """Reverse ``buffer[start:end]`` in place."""
    while end - start > 1:
        step = min(PIECE, (end - start) // 2)
        left, right = buffer[start : start + step], buffer[end - step : end]
        left.reverse()
        right.reverse()
        buffer[start : start + step], buffer[end - step : end] = right, left
        start, end = start + step, end - step


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks ``start:cut`` and ``cut:end`` in place, by three reversals."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def byte_offsets(text: str, first: int, second: int) -> tuple[int, int]:
    """Where code points ``first`` and ``second`` of the text begin in its UTF-8 bytes."""
    if text.isascii():
        return first, second
    lead = len(text[:first].encode())
    return lead, lead + len(text[first:second].encode())


def transform(buffer: bytearray, first: int, second: int, form: str, marks: Sentinels) -> None:
    """Turn prefix, middle, suffix, cut at bytes ``first`` and ``second``, into the form, in place."""
    if form == PLAIN:
        return
    p, s, m = (x.encode() for x in (marks.prefix, marks.suffix, marks.middle))
    buffer[second:second] = s
    buffer[first:first] = m
    buffer[0:0] = p
    middle, suffix = len(p) + first, len(p) + len(m) + second
    rotate(buffer, middle if form == PSM else 0, suffix, len(buffer))


def restore(buffer: bytearray, form: str, marks: Sentinels) -> None:
    """Undo :func:`transform` in place, from the form and the sentinels that are found."""
    if form == PLAIN:
        return
    p, s, m = (x.encode() for x in (marks.prefix, marks.suffix, marks.middle))
    if form == PSM:
        start, middle = buffer.index(s), buffer.index(m)
    else:
        start, middle = 0, buffer.index(p)
    end = len(buffer)
    rotate(buffer, start, middle, end)  # the suffix block held ``middle - start`` bytes
    suffix = end - (middle - start)
    middle = start if form == PSM else buffer.index(m)
    del buffer[suffix : suffix + len(s)]
    del buffer[middle : middle + len(m)]
    del buffer[: len(p)]


def plan(doc_id: object, text: str, marks: Sentinels, rates: Rates) -> tuple[str, int, int]:
    """(form, first cut, second cut) in code points, from a digest of seed and id."""
    digest = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(x in text for x in (marks.prefix, marks.suffix, marks.middle)) or h3 % 100 >= 100 - rates.plain:
        return PLAIN, 0, 0
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return SPM if h4 % 100 < rates.spm else PSM, first, second


_ADDED = [
    ("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()),
    ("middle_chars", T.LongType(), pa.int64()), ("output_sha256", T.StringType(), pa.string()), ("restored_sha256", T.StringType(), pa.string()),
]


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", marks: Sentinels = Sentinels(), rates: Rates = Rates(),
    keep_output: bool = True,
) -> DataFrame:
    """Add ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars``, ``output_sha256``, ``restored_sha256`` and ``output``.

    ``output`` is the transformed text; ``restored_sha256`` is the digest of the text rebuilt from output and
    form.  Texts that are null or empty, hold a sentinel, or are chosen by the rate stay ``plain``: the output
    is the text, the two lengths are null.  The draw depends on the id alone, so repeated rows get equal
    results; a null id draws like the empty string.  Existing columns with these names are replaced, all other
    columns are kept.  ``keep_output=False`` leaves the output out.
    """
    docs = docs.drop("output", *(name for name, _, _ in _ADDED))
    extra = [("output", T.StringType(), pa.string())] if keep_output else []
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind, _ in (*_ADDED, *extra))])
    id_at, text_at = docs.columns.index(id_column), docs.columns.index(text_column)

    def row(doc_id: object, text: str | None) -> tuple:
        text = text or ""
        form, first, second = plan(doc_id, text, marks, rates)
        buffer = bytearray(text, "utf-8")
        transform(buffer, *byte_offsets(text, first, second), form, marks)
        digest = hashlib.sha256(buffer).hexdigest()
        output = buffer.decode() if keep_output else None
        restore(buffer, form, marks)
        lengths = (None, None) if form == PLAIN else (first, second - first)
        return (len(text), form, *lengths, digest, hashlib.sha256(buffer).hexdigest(), output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_at):
            rows = [row(i.as_py(), t.as_py()) for i, t in zip(batch.column(id_at), batch.column(text_at))]
            columns = list(zip(*rows)) if rows else [()] * 7
            added = [pa.array(values, kind) for values, (_, _, kind) in zip(columns, (*_ADDED, *extra))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return docs.mapInArrow(run, schema)
