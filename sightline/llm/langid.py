"""Language identification by character models per language, with calibrated rejection.

Each language with training text gets a Kneser-Ney model of the characters of its lower-cased words.  A text gets
the language under which its cross-entropy per character is lowest.  On all training texts the mean and spread of
that cross-entropy are measured per language, for long and short texts; a text far above them is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import kneser_ney as K
from sightline.llm.textarrays import bounded
from sightline.session import materialise

#: ASCII letters are kept, other ASCII becomes white space; other characters are kept.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
#: Standard deviations above the mean of a language's training texts at which a text is rejected.
REJECT_AT = 6.0
#: Characters from which on a text counts as long.
LONG = 400
UNDETERMINED = "und"
_NONE = np.zeros(0, np.uint16)


def prepare(text: str) -> np.ndarray:
    """Characters of the lower-cased words, separated by one space."""
    return K.characters(b" ".join(text.lower().encode().translate(_LETTERS).split()).decode())


def _scored(rows: DataFrame, text_column: str, shared, carry_text: bool) -> DataFrame:
    """``rows`` with ``__n``, the characters of a text's words, and ``__cost``, their cross-entropy under each model."""
    carried = [c for c in rows.columns if carry_text or c != text_column]
    source = rows.select(carried if carry_text else [*carried, text_column])
    at = source.columns.index(text_column)
    schema = T.StructType([
        *source.select(carried).schema.fields, T.StructField("__n", T.LongType()), T.StructField("__cost", T.ArrayType(T.DoubleType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = K.Scorer(shared.value) if shared.value else None
        for batch in bounded(batches, at):
            raw = batch.column(at).to_pylist()
            texts = [prepare(t) if t and any(map(str.isalpha, t)) else _NONE for t in raw]
            total = scorer.score(texts) if scorer else np.zeros((len(texts), 0))
            costs = [(-row / max(1, len(t))).tolist() if len(t) else None for row, t in zip(total, texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carried)], pa.array([len(t) for t in texts], pa.int64()), pa.array(costs, pa.list_(pa.float64()))], names=schema.names,
            )

    return source.mapInArrow(run, schema)


def identify(
    docs: DataFrame, is_training, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    order: int = K.ORDER, reject_at: float = REJECT_AT, carry_text: bool = False,
) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``; the text only with ``carry_text``.

    ``is_training`` is a boolean column: rows with it and a non-null language are learned from.  ``score`` is
    the posterior of the predicted language, from the cross-entropies over at most ``LONG`` characters' worth of
    evidence.  A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text if
    nothing was learned.  A text without spread in its language's training data is never rejected for it.
    Existing columns with the result's names are replaced; repeated rows are repeated results.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    marked = docs.withColumn("__train", F.coalesce(is_training, F.lit(False)))
    counts = K.count_ngrams(marked.where("__train"), lang_column, text_column, prepare, order, K.CHARACTER_BITS)
    models = K.fit(counts, order, K.CHARACTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(list(models.values()))
    scored = _scored(marked, text_column, shared, carry_text)
    carried = [c for c in marked.columns if carry_text or c != text_column]
    names = F.array(*[F.lit(n) for n in models]) if models else F.array().cast("array<string>")
    # texts are never written with their costs: with them, the training texts are scored once more for the spread
    costs = scored if carry_text else materialise(scored, "language_costs")
    trained = _scored(marked.where("__train").select(text_column, lang_column, "__train"), text_column, shared, False) if carry_text else costs
    least = F.array_min("__cost")
    costs = costs.withColumn("__best", F.array_position("__cost", least).cast("int")).withColumn(
        "__pred", F.when(F.col("__best") > 0, F.element_at(names, F.col("__best")))
    )
    # spread of the cross-entropy in training texts of a language, long and short, under its own model
    own = F.element_at(F.map_from_arrays(names, F.col("__cost")), F.col(lang_column))
    training = trained.where(F.col("__train") & F.col("__cost").isNotNull()).select(
        F.col(lang_column).alias("__pred"), own.alias("c"), F.col("__n").alias("n")
    ).where("c IS NOT NULL")
    moments = training.groupBy("__pred").agg(
        (F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("__mean"),
        *(F.avg(F.when(F.col("n") >= LONG, F.col("c") ** k)).alias(f"long{k}") for k in (1, 2)),
        *(F.avg(F.when(F.col("n") < LONG, F.col("c") ** k * F.col("n"))).alias(f"short{k}") for k in (0, 1, 2)),
    )
    m = F.col("__mean")
    spread = materialise(moments.select(  # one row for each learned language
        "__pred", "__mean", F.greatest(F.col("long2") - 2 * m * F.col("long1") + m * m, F.lit(0.0)).alias("__fixed"),
        F.greatest(F.col("short2") - 2 * m * F.col("short1") + m * m * F.col("short0"), F.lit(0.0)).alias("__byte"),
    ), "language_spread")
    # evidence grows with length, but characters of one text depend on each other
    weight = F.least(F.col("__n"), F.lit(LONG)) / 8.0
    posterior = 1.0 / F.aggregate("__cost", F.lit(0.0), lambda s, c: s + F.exp((least - c) * weight))
    limit = F.coalesce("__fixed", F.lit(0.0)) + F.coalesce("__byte", F.lit(0.0)) / F.col("__n")
    far = least > F.col("__mean") + reject_at * F.sqrt(limit)
    return costs.join(F.broadcast(spread), "__pred", "left").select(
        *[c for c in carried if c != "__train"],
        F.coalesce("__pred", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce(F.when(F.col("__pred").isNotNull(), posterior), F.lit(0.0)).alias("score"),
        F.coalesce(F.when(F.col("__pred").isNotNull() & (limit > 0), far), F.col("__pred").isNull()).alias("rejected"),
    )
