"""From raw documents to token ids: five of the operators, one after the other."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe
from sightline.llm.decontaminate import contaminated
from sightline.llm.langid import identify
from sightline.llm.queries import BYTE_BPE, fifth
from sightline.llm.simhash import drop_near_duplicates
from sightline.llm.substring_dedup import remove_repeated_passages
from sightline.session import delete_path, materialise, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: texts without letters, or unlike every learned language, go."""
    return identify(docs, is_training=fifth() != 0, carry_text=True).where("NOT rejected").select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that one with a smaller doc_id has too; ``n_chars`` follows the text."""
    cut = remove_repeated_passages(docs)
    shorter = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", shorter).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Whether one does depends on its text alone, so texts are known by 128 bits of hash and ids play no part.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("__t1", F.xxhash64("text")).withColumn("__t2", F.xxhash64(F.lit("second"), "text"))
    texts = keyed.select(F.struct("__t1", "__t2").alias("doc_id"), "text")
    leaks = contaminated(texts, benchmark, partial_copies=True).select("doc_id.__t1", "doc_id.__t2").distinct()
    found = materialise(leaks, "leaks")
    return keyed.join(found, ["__t1", "__t2"], "left_anti").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of the bytes they decode to."""
    tokens = bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokens, public_tokenizers.PATTERN, keep_ids=False)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Language models are not expressible in SQL; ``tests/llm/test_pipeline.py`` has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents.

    What a stage keeps is written and read again; once the next stage is written, nothing reads it any more and it
    is deleted, so at most two generations of the texts are on disk.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept, path = stage(spark, docs, sf_dir), scratch_path(spark, name)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
