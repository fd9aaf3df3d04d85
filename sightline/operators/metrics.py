"""Counts per run: one pre-aggregated pass each."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.rules import LIKELIHOODS
from sightline.schemas import EXCLUDED, INCLUDED


def status_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id", "scanner_status").agg(F.count(F.lit(1)).alias("findings"))


def blank_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(
        F.count_if(F.col("blank_description") == "DATA_QUALITY").alias("description_blank"),
        F.count_if(F.col("blank_risk") == "DATA_QUALITY").alias("risk_blank"),
        F.count_if(F.col("blank_remediation") == "DATA_QUALITY").alias("remediation_blank"),
        F.count_if(F.col("blank_region") == "STRUCTURAL").alias("region_structural"),
    )


def warning_breakdown(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("run_id", "stage", "code").agg(F.count(F.lit(1)).alias("warnings"))


def run_counts(processed: DataFrame) -> DataFrame:
    """Included, excluded and duplicate findings; excluded leaves duplicates out.

    Groups are counted from their distinct keys: the first aggregation already
    reduces a run to one row per check and section.
    """
    keyed = processed.groupBy("run_id", "check_id", "output_section").agg(
        F.count(F.lit(1)).alias("t"),
        F.count_if((F.col("report_inclusion") == INCLUDED) & ~F.col("is_duplicate")).alias("i"),
        F.count_if((F.col("report_inclusion") == EXCLUDED) & ~F.col("is_duplicate")).alias("e"),
        F.count_if(F.col("is_duplicate")).alias("d"),
    )
    return keyed.groupBy("run_id").agg(
        F.sum("t").alias("total_findings"), F.sum("i").alias("included"), F.sum("e").alias("excluded"),
        F.sum("d").alias("duplicates"), F.count_if(F.col("i") > 0).alias("output_groups"),
    )


def likelihood_distribution(groups: DataFrame) -> DataFrame:
    return groups.groupBy("run_id").agg(
        *[F.count_if(F.col("likelihood_rating") == v).alias(v.lower()) for v in LIKELIHOODS]
    )


def risk_distribution(groups: DataFrame) -> DataFrame:
    """Groups per risk rating; the four standard ratings are listed even when zero."""
    found = groups.groupBy("run_id", F.coalesce("risk_rating", F.lit("Unknown")).alias("risk_rating")).agg(
        F.count(F.lit(1)).alias("groups")
    )
    standard = F.explode(F.array(*[F.lit(v) for v in ("High", "Medium", "Low", "Unknown")]))
    zeros = found.select("run_id").distinct().select("run_id", standard.alias("risk_rating"), F.lit(0).alias("groups"))
    return found.unionByName(zeros).groupBy("run_id", "risk_rating").agg(F.sum("groups").alias("groups"))


def section_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("run_id", "output_section").agg(F.count(F.lit(1)).alias("groups"))


def grouping_stats(check_groups: DataFrame, merged: DataFrame, chunks: DataFrame) -> DataFrame:
    """Original and merged group counts, merges, chunks and reduction per run."""
    before = check_groups.groupBy("run_id").agg(F.count(F.lit(1)).alias("original_count"))
    after = merged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("merged_count"), F.count_if("is_merged").alias("merges_applied")
    )
    used = chunks.groupBy("run_id").agg(F.max("chunk_no").alias("chunks_used"))
    zero = {"merged_count": 0, "merges_applied": 0, "chunks_used": 0}
    return (
        before.join(after, "run_id", "left").join(used, "run_id", "left").fillna(zero)
        .withColumn("reduction", F.col("original_count") - F.col("merged_count"))
    )


def enrich_stats(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("group_count"),
        F.count_if(~F.col("enrichment_failed")).alias("enriched"),
        F.count_if("enrichment_failed").alias("failed"),
    )


def first_k(df: DataFrame, k: int, seq: str = "row_seq") -> DataFrame:
    """First ``k`` rows of each run in row order, with the number of rows left out.

    Spark trims each task to ``k`` rows per run before the shuffle; the totals
    are one row per run.
    """
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(seq))
    totals = df.groupBy("run_id").agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("more"))
    return df.withColumn("pos", rank).filter(F.col("pos") <= k).join(totals, "run_id")
