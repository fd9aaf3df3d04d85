"""The audit table: one append-only row per field change of a finding."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.schemas import AUDIT, INCLUDED


def _event(when: Column, seq: int, stage_no: int, stage: str, field: str, old, new, reason: Column) -> Column:
    value = lambda v: F.lit(v).cast("string") if not isinstance(v, Column) else v.cast("string")
    return F.when(when, F.struct(
        F.lit(stage_no).alias("stage_no"), F.lit(seq).alias("seq"), F.lit(stage).alias("stage"),
        F.lit(field).alias("field"), value(old).alias("old_value"), value(new).alias("new_value"),
        reason.alias("reason"), F.lit("pipeline").alias("actor"),
    ))


def finding_audit(processed: DataFrame) -> DataFrame:
    """Events of ingest, status filter, duplicate marking and section, in one pass."""
    filtered_out = (F.col("report_inclusion") != INCLUDED) & ~F.col("is_duplicate")
    kept = (F.col("report_inclusion") == INCLUDED) & ~F.col("is_duplicate")
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    # the reasons are fixed values: readers of the audit look for them
    events = F.array_compact(F.array(
        _event(
            F.col("muted_reconciled"), 0, 1, "ingest", "scanner_status", F.col("raw_status"),
            F.col("scanner_status"), F.lit("MUTED=True overrode STATUS column value"),
        ),
        _event(
            F.col("human_review_required"), 1, 1, "ingest", "human_review_required", "false", "true",
            F.col("review_reason"),
        ),
        _event(
            filtered_out, 0, 2, "status_filter", "report_inclusion", "INCLUDED", "EXCLUDED",
            F.col("exclusion_reason"),
        ),
        _event(
            F.col("is_duplicate"), 1, 2, "dedup", "report_inclusion", "INCLUDED", "EXCLUDED",
            F.col("exclusion_reason"),
        ),
        _event(
            F.col("is_duplicate"), 2, 2, "dedup", "is_duplicate", "false", "true",
            F.concat(F.lit("dedup_key='"), "dedup_key", F.lit("' already seen; primary="), "duplicate_of"),
        ),
        _event(
            kept, 3, 2, "check_grouping", "output_section", "", F.col("output_section"),
            F.concat(
                F.lit("provider='"), shown("raw_provider"), F.lit("' service='"), shown("raw_service_name"),
                F.lit("' -> section='"), "output_section", F.lit("'"),
            ),
        ),
    ))
    return processed.select("run_id", "finding_instance_id", F.explode(events).alias("e")).select(
        "run_id", "finding_instance_id", "e.*"
    )


def group_audit(groups: DataFrame) -> DataFrame:
    """Events of check grouping and likelihood, on each representative."""
    count = F.col("instance_count").cast("string")
    events = F.array_compact(F.array(
        _event(
            F.lit(True), 4, 2, "check_grouping", "instance_count", "1", count,
            F.concat(
                F.lit("Grouped "), count, F.lit(" instance(s) of check_id='"), "check_id",
                F.lit("' into one output row"),
            ),
        ),
        _event(
            F.lit(True), 5, 2, "likelihood", "likelihood_rating", None, F.col("likelihood_rating"),
            F.col("likelihood_reason"),
        ),
    ))
    return groups.select("run_id", "finding_instance_id", F.explode(events).alias("e")).select(
        "run_id", "finding_instance_id", "e.*"
    )


def union_audit(*tables: DataFrame) -> DataFrame:
    names = [f.name for f in AUDIT.fields]
    return reduce(DataFrame.unionByName, [t.select(*names) for t in tables])


def union_warnings(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def latest_exclusion(audit: DataFrame) -> DataFrame:
    """Last inclusion reason of each finding; one row per finding after partial aggregation."""
    rank = F.col("stage_no") * 1000 + F.col("seq")
    return (
        audit.filter("field = 'report_inclusion'").groupBy("run_id", "finding_instance_id")
        .agg(F.max_by("reason", rank).alias("reason"))
    )
