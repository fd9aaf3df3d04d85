"""Quality rules: counts of words, symbols and repetition, and bands of n-gram perplexity per language.

The perplexity of a text is that of its bytes under the Kneser-Ney model of its language, which Spark counts over the
texts of that language with words enough.  They fall into two halves by a hash of the text, and a text is measured by
the model of the half that it is not in: junk cannot vouch for itself, and neither can copies.  The bands come from
the distinct texts that pass the base rules: a language's quartiles of log-perplexity, widened on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import kneser_ney as K
from sightline.llm.textarrays import _SPACE, bounded, hash_words, mix, per_text, split_words, text_bytes, window_hashes
from sightline.session import materialise

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Least and most log-perplexity, in interquartile distances below and above the quartiles.
REACH_LOW, REACH_HIGH = 6.0, 4.0
#: Least width of a band below and above the quartiles, in nats per byte.
MARGIN_LOW, MARGIN_HIGH = 1.0, 0.4
#: N-grams whose probability a worker remembers, for each language.
MEMORY = 1 << 17
#: Language of rows without one.
NO_LANGUAGE = "und"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SPELT = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_EDGE = " \t\n\x0b\x0c\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(_EDGE)]
    return len(lines) - len(set(lines))


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a batch; a null counts as empty."""
    words = split_words(column)
    data, offsets = text_bytes(column)
    texts = len(words.first) - 1
    hashes, starts = window_hashes(hash_words(words, 1), words.first, 3)
    owner = words.text_of_word[starts]
    keyed = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.argsort(keyed, kind="stable")
    same = keyed[ordered][1:] == keyed[ordered][:-1]
    again = np.zeros(len(keyed), bool)
    again[ordered[1:][same]] = True
    again[ordered[:-1][same]] = True
    covered = np.zeros(len(words.starts), bool)
    for k in range(3):
        covered[starts[again] + k] = True
    spelt = np.concatenate([[0], np.cumsum(_SPELT[data])])
    return {
        "spelt": per_text(spelt[words.ends] > spelt[words.starts], words.first),
        "n_words": np.diff(words.first),
        "word_chars": per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.fromiter((duplicate_lines(v.as_py() or "") for v in column), np.int64, texts),
        "n_repeat_words": per_text(covered, words.first),
    }


def prepare(text: str) -> bytes:
    return text.encode()


def learned(text: str) -> bytes:
    """What a text gives to the model: all of it, if it has words enough."""
    raw = text.encode()
    return raw if len(raw.split()) >= MIN_WORDS else b""


def judge(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", order: int = K.ORDER,
    reach: tuple[float, float] = (REACH_LOW, REACH_HIGH), margin: tuple[float, float] = (MARGIN_LOW, MARGIN_HIGH), carry_text: bool = False,
) -> DataFrame:
    """All columns of ``docs`` (the text only with ``carry_text``) with the counts, ``base_failed``,
    ``log_perplexity`` (nats per byte, null without a letter or digit), ``low``, ``high`` and ``kept``.

    A text fails the base rules with fewer than 50 words, or when more than half its words lie in three-word
    windows found twice or more.  A text that passes is kept if its log-perplexity lies in the band of its
    language; one without any letter or digit is not.  A half without texts is measured by itself.  Null texts are
    empty; a null language is a language of its own.  A language without texts that pass has no band.  Existing
    columns with the result's names are replaced; repeated rows count once for the bands.
    """
    added = [*_COUNTS, "log_perplexity", "base_failed", "low", "high", "kept"]
    docs = docs.drop(*added)
    language = F.coalesce(F.col(lang_column), F.lit(NO_LANGUAGE))
    digest = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    half = F.pmod(digest, F.lit(2)).cast("string")
    models = K.fit(K.count_ngrams(docs, F.concat(half, language), text_column, learned, order), order)
    carried = [c for c in docs.columns if carry_text or c != text_column]
    source = docs.select(*carried, digest.alias("__digest"), language.alias("__lang"), F.col(text_column).alias("__text"))
    schema = T.StructType([
        *source.drop("__text").schema.fields, *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("log_perplexity", T.DoubleType()),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {name: K.Scorer([model], MEMORY) for name, model in shared.value.items()}
        for batch in bounded(batches, len(carried) + 2):
            digests, languages, column = batch.columns[len(carried) :]
            counts = base_counts(column)
            nats: list[float | None] = [None] * len(column)
            by_model: dict[str, list[int]] = {}
            for i, (name, digest_) in enumerate(zip(languages.to_pylist(), digests.to_pylist())):
                own = digest_ % 2
                by_model.setdefault(f"{1 - own}{name}" if f"{1 - own}{name}" in scorers else f"{own}{name}", []).append(i)
            for name, rows in by_model.items():
                if name in scorers:
                    texts = [prepare(column[i].as_py() or "") for i in rows]
                    for i, text, total in zip(rows, texts, scorers[name].score(texts)[:, 0]):
                        nats[i] = -total / len(text) if counts["spelt"][i] else None
            arrays = [pa.array(counts[c], pa.int64()) for c in _COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried) + 2], *arrays, pa.array(nats, pa.float64())], names=schema.names)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = materialise(source.mapInArrow(run, schema).withColumn("base_failed", failed), "perplexities")
    distinct = scored.where(~F.col("base_failed")).groupBy("__lang", "__digest").agg(F.first("log_perplexity").alias("nats"))
    quartiles = distinct.groupBy("__lang").agg(F.percentile_approx("nats", [0.25, 0.75], 10_000).alias("q"))
    spread = F.col("q")[1] - F.col("q")[0]
    below, above = (F.greatest(spread * r, F.lit(m)) for r, m in zip(reach, margin))
    bands = quartiles.select(F.col("__lang").alias("__band"), (F.col("q")[0] - below).alias("low"), (F.col("q")[1] + above).alias("high"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return scored.join(F.broadcast(bands), F.col("__lang") == F.col("__band"), "left").select(
        *carried, *_COUNTS, "base_failed", "log_perplexity", "low", "high", (~F.col("base_failed") & inside).alias("kept")
    )
