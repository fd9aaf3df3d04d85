"""Raw finding rows to normalised findings: projections only, no shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import findings as fn
from sightline.functions.text import clean, compliance, pipe_list, quoted_array, tag_map, text_or
from sightline.schemas import RAW_FIELDS

_STAGE = "ingest"


def normalise_findings(raw: DataFrame) -> DataFrame:
    """Add every normalised column to rows shaped like ``schemas.RAW_FINDINGS``."""
    col = F.col
    present = [c for c in RAW_FIELDS if c in raw.columns]
    cells = raw.withColumns({c: clean(col(c)) for c in present}).withColumns(
        {c: F.lit(None).cast("string") for c in RAW_FIELDS if c not in raw.columns}
    )
    if "extra_fields" not in raw.columns:
        cells = cells.withColumn("extra_fields", F.create_map().cast("map<string,string>"))
    step = cells.withColumns({
        "finding_instance_id": fn.instance_id(col("run_id"), col("row_seq")),
        "source_row_id": fn.source_row_id(col("sheet_name"), col("row_no")),
        "_status": fn.reconcile_status(col("raw_status"), col("raw_muted")),
        "blank_description": fn.classify_blank("DESCRIPTION", col("raw_description"), col("raw_service_name")),
        "blank_risk": fn.classify_blank("RISK", col("raw_risk"), col("raw_service_name")),
        "blank_remediation": fn.classify_blank(
            "REMEDIATION_RECOMMENDATION_TEXT",
            col("raw_remediation_recommendation_text"),
            col("raw_service_name"),
        ),
        "blank_region": fn.classify_blank("REGION", col("raw_region"), col("raw_service_name")),
        "region_normalised": text_or(col("raw_region"), "global"),
        "resource_uid_normalised": fn.resource_id(col("raw_resource_uid"), col("raw_resource_name")),
        "arn_fallback_used": col("raw_resource_uid").isNull(),
        "categories_list": pipe_list(col("raw_categories")),
        "_compliance": compliance(col("raw_compliance")),
        "account_tags_parsed": tag_map(col("raw_account_tags")),
        "resource_tags_parsed": tag_map(col("raw_resource_tags")),
        "completeness_score": fn.completeness(
            col("raw_description"), col("raw_risk"), col("raw_remediation_recommendation_text"),
            col("raw_check_title"), col("raw_status_extended"),
        ),
    })
    step = step.withColumns({
        "scanner_status": col("_status.scanner_status"),
        "muted_reconciled": col("_status.muted_reconciled"),
        "unknown_status": col("_status.unknown_status"),
        "compliance_values": col("_compliance.values"),
        "compliance_parsed": col("_compliance.parsed"),
        "blank_fields": F.array_compact(F.array(
            F.when(col("blank_description") == "DATA_QUALITY", "DESCRIPTION"),
            F.when(col("blank_risk") == "DATA_QUALITY", "RISK"),
            F.when(col("blank_remediation") == "DATA_QUALITY", "REMEDIATION_RECOMMENDATION_TEXT"),
        )),
        "stable_finding_key": fn.stable_key(
            col("raw_provider"), col("raw_account_name"), col("raw_service_name"),
            col("raw_check_id"), col("resource_uid_normalised"),
        ),
        "dedup_key": fn.dedup_key(
            col("raw_account_uid"), col("raw_check_id"),
            col("resource_uid_normalised"), col("region_normalised"),
        ),
    }).drop("_status", "_compliance")
    reason = F.coalesce(
        F.when(
            F.size("blank_fields") > 0,
            F.concat(F.lit("Category 2 blank fields: "), F.array_join("blank_fields", ", ")),
        ),
        F.when(
            col("resource_uid_normalised") == "",
            "No resource identifier (both RESOURCE_UID and RESOURCE_NAME blank)",
        ),
    )
    return step.withColumn("review_reason", reason).withColumn(
        "human_review_required", col("review_reason").isNotNull()
    )


def warning_list() -> Column:
    """The warnings of a normalised finding, as structs of code and message."""
    row = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    number = F.col("row_no").cast("string")
    warn = lambda test, code, message: F.when(
        test, F.struct(F.lit(code).alias("code"), message.alias("message"))
    )
    return F.array_compact(F.array(
        warn(
            F.col("muted_reconciled"), "MUTED_STATUS_RECONCILED",
            row("MUTED=True overrides STATUS='", shown("raw_status"), "': now '", F.col("scanner_status"), "'"),
        ),
        warn(
            F.col("unknown_status"), "UNKNOWN_STATUS",
            row("Unrecognised STATUS value '", shown("raw_status"), "'. Set to UNKNOWN."),
        ),
        warn(
            F.size("blank_fields") > 0, "DATA_QUALITY_BLANK",
            row("Row ", number, ": blank data quality fields: ", quoted_array(F.col("blank_fields"))),
        ),
        warn(
            F.col("arn_fallback_used") & F.col("raw_resource_name").isNotNull(), "ARN_FALLBACK",
            row("Row ", number, ": no RESOURCE_UID, RESOURCE_NAME='", F.col("raw_resource_name"), "' used instead"),
        ),
        warn(
            F.col("raw_check_id").isNull(), "EMPTY_CHECK_ID",
            row("Row ", number, ": no CHECK_ID, grouped as 'unknown'"),
        ),
    ))


def ingest_warnings(findings: DataFrame) -> DataFrame:
    """One row per warning of a normalised finding; a single pass over the findings."""
    return findings.select(
        "run_id", F.lit(_STAGE).alias("stage"), "row_no", F.col("raw_check_id").alias("check_id"),
        F.col("finding_instance_id").alias("finding_id"), F.explode(warning_list()).alias("w"),
    ).select("run_id", "stage", "w.code", "w.message", "row_no", "check_id", "finding_id")


def unknown_columns(findings: DataFrame) -> DataFrame:
    """Columns outside the declared schema, once per run."""
    return findings.select("run_id", F.explode(F.map_keys("extra_fields")).alias("column_name")).distinct()


def unknown_column_warnings(findings: DataFrame) -> DataFrame:
    """One UNKNOWN_COLUMNS warning per run that has any."""
    names = F.array_sort(F.collect_set("column_name"))
    return unknown_columns(findings).groupBy("run_id").agg(names.alias("names")).select(
        "run_id", F.lit(_STAGE).alias("stage"), F.lit("UNKNOWN_COLUMNS").alias("code"),
        F.concat(
            F.lit("Found "), F.size("names").cast("string"),
            F.lit(" unknown column(s), kept in extra_fields: "), quoted_array(F.col("names")),
        ).alias("message"),
        F.lit(None).cast("long").alias("row_no"), F.lit(None).cast("string").alias("check_id"),
        F.lit(None).cast("string").alias("finding_id"),
    )


def scanner_version(findings: DataFrame) -> DataFrame:
    """First version seen in row order, per run."""
    return (
        findings.filter(F.col("raw_prowler_version").isNotNull())
        .groupBy("run_id")
        .agg(F.min_by("raw_prowler_version", "row_seq").alias("scanner_version"))
    )
