"""Conversations rendered by a chat template, with the loss mask, and read back from the rendered text."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.chat_template import compile_template

#: Control strings of the format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

#: Every turn is closed by ``</s>``; a role other than user and assistant is written out.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}{{ bos + '[INST] ' }}{{ m.text | escape }}{{ ' [/INST]' + eos }}"
    "{% elif m.role == 'assistant' %}{{ bos }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ eos }}"
    "{% else %}{{ bos + '[ROLE]' }}{{ m.role | escape }}[/ROLE]{{ m.text | escape }}{{ eos }}{% endif %}"
    "{% endfor %}"
)
CONSTANTS = {"bos": "<s>", "eos": "</s>"}

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(\\|)")
_TURN = re.compile(
    r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)|(?P<assistant>.*?))</s>", re.S
)


def escape(text: str) -> str:
    """Double backslashes, and put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    return _ESCAPED.sub(r"\1", text)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    turns = []
    for m in _TURN.finditer(text):
        if m["user"] is not None:
            turns.append(("user", unescape(m["user"])))
        elif m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append(("assistant", unescape(m["assistant"])))
    return turns


@dataclass
class _Open:
    """The conversation whose turns are being read."""

    key: int | None
    messages: list[dict[str, str]] = field(default_factory=list)


def format_conversations(
    turns: DataFrame, template: str = TEMPLATE, constants: dict[str, object] | None = None,
) -> DataFrame:
    """One row per conversation: conv_id, formatted text, and loss_spans (start, end) in code points.

    ``turns`` has conv_id, turn, role, text; other columns are ignored.  Turns follow ``turn``, then role and
    text; repeated rows are repeated turns.  A null role or text is empty; null turn numbers come first; rows
    with a null conv_id form one conversation.  Rows are sorted by Spark and read as a stream, so a task holds
    one conversation, which is one result cell.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    schema = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()),
        T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    constants = CONSTANTS if constants is None else constants
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape}, constants)
        held: _Open | None = None
        for batch in itertools.chain(batches, [None]):
            done = []
            if batch is not None:
                for key, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if held is None or held.key != key:
                        done += [held] if held else []
                        held = _Open(key)
                    held.messages.append({"role": role, "text": text})
            elif held is not None:
                done = [held]
            found = [render({"messages": c.messages}) for c in done]
            yield pa.RecordBatch.from_arrays([
                pa.array([c.key for c in done], pa.int64()), pa.array([r.text for r in found], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in r.spans] for r in found], spans),
            ], names=schema.names)

    return ordered.mapInArrow(run, schema)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Read each formatted conversation back: conv_id, n_turns, digests of turns and of the text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
                rows.append((key, len(turns), digests[0], len(loss), digests[1], len(text)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
