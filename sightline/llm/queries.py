"""Registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe
from sightline.llm.chat_format import digest_conversations, format_conversations
from sightline.llm.decontaminate import contaminated
from sightline.llm.fill_middle import fill_in_middle
from sightline.llm.html_text import extract
from sightline.llm.langid import identify
from sightline.llm.lm_scoring import COUNT_SHARE, score_documents
from sightline.llm.quality import judge
from sightline.llm.simhash import near_duplicate_groups
from sightline.llm.substring_dedup import remove_repeated_passages
from sightline.llm.token_alignment import align_tokenizers
from sightline.llm.url_filter import judge_urls
from sightline.llm.vector_dedup import near_duplicate_vectors

BYTE_BPE = "byte_bpe_50k.tiktoken"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: A conversation whose texts hold the control strings of the format.
CONTROL_CONVERSATION = """SELECT * FROM VALUES
    (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digest_conversations(format_conversations(turns.union(spark.sql(CONTROL_CONVERSATION))))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), partial_copies=True)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")


def fifth(doc_id: str = "doc_id") -> Column:
    """The fifth of the documents that a row belongs to."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    scored = score_documents(docs, is_training=fifth() != 1, tokens=tokens, count_share=COUNT_SHARE)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, is_training=fifth() != 0)
    return found.select("doc_id", F.coalesce(fifth() == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    encoded = bpe.encode(docs, tokens, public_tokenizers.PATTERN, keep_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(docs, keep_output=False).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path_a, path_b = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)
    return align_tokenizers(docs, path_a, path_b, keep_groups=False).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_chat_format": op3_chat_format,
    "op4_decontamination": op4_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_middle": op11_fill_middle,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_token_alignment": op13_token_alignment,
}
