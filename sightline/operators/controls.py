"""Control findings: normalise, filter, mark duplicates, group, number."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import controls as fn
from sightline.functions.findings import completeness, instance_id
from sightline.functions.text import instance_count, quoted_list, strip_html, text_or
from sightline.operators.grouping import section_rank
from sightline.operators.numbering import rank_rows
from sightline.rules import CONTROL_SEVERITY_RANK, Rules, severity_rank
from sightline.schemas import CONTROL_FIELDS, EXCLUDED, INCLUDED
from sightline.session import materialise

UNKNOWN_TENANT = "UNKNOWN-TENANT"
_LAST = 1 << 60  # above every row_seq: puts excluded rows behind included ones


def resolve_tenant(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Tenant of each row: its own, else the configured one, else a placeholder."""
    given = fn.strip(F.col("tenant_id")) if "tenant_id" in raw.columns else F.lit("")
    return raw.withColumn("tenant_id", text_or(given, rules.tenant_id.strip() or UNKNOWN_TENANT))


def tenant_warnings(controls: DataFrame) -> DataFrame:
    """UNKNOWN_TENANT once per run that uses the placeholder."""
    return controls.filter(F.col("tenant_id") == UNKNOWN_TENANT).select("run_id").distinct().select(
        "run_id", F.lit("ingest").alias("stage"), F.lit("UNKNOWN_TENANT").alias("code"),
        F.lit(f"No tenant id given; keys use '{UNKNOWN_TENANT}'.").alias("message"),
        F.lit(None).cast("long").alias("row_no"), F.lit(None).cast("string").alias("check_id"),
        F.lit(None).cast("string").alias("finding_id"),
    )


def normalise_controls(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add every normalised column to rows shaped like ``schemas.RAW_CONTROLS``."""
    col = F.col
    cells = {
        c: fn.clean_control(col(c)) if c in raw.columns else F.lit(None).cast("string") for c in CONTROL_FIELDS
    }
    cells["raw_comments"] = F.lit(None).cast("string")
    step = resolve_tenant(raw, rules).withColumns(cells).withColumns({
        "finding_instance_id": instance_id(col("run_id"), col("row_seq")),
        "provider": F.lit("azure"),
        "region": F.lit("global"),
        "control_id": F.coalesce("raw_control_id", F.lit("")),
        "check_title": strip_html(col("raw_requirement")),
        "raw_details": F.nullif(strip_html(col("raw_details")), F.lit("")),
        "raw_original_details": F.when(col("raw_original_details").isNotNull(), strip_html(col("raw_original_details"))),
        "scanner_status": fn.control_status(col("raw_result")),
        "criticality_raw": F.coalesce("raw_criticality", F.lit("")),
        "severity": fn.control_severity(col("raw_criticality"), rules.criticality_severity),
    })
    step = step.withColumns({
        "_service": fn.resolve_service(col("control_id"), rules.control_services),
        "instance_count": instance_count(col("raw_details")),
        "likelihood_rating": fn.initial_likelihood(col("severity")),
        "stable_key": fn.control_stable_key(col("tenant_id"), col("control_id")),
        "dedup_key": fn.control_dedup_key(col("tenant_id"), col("control_id")),
        "completeness_score": completeness(
            col("raw_requirement"), col("raw_details"), col("check_title"), col("raw_criticality"), col("control_id")
        ),
        "review_reason": F.when(col("control_id") == "", F.concat(
            F.lit("Row "), col("row_no").cast("string"),
            F.lit(": Control ID is blank — cannot resolve service or build keys"),
        )),
    })
    return step.select("*", "_service.*").drop("_service").withColumns({
        "service_name": fn.service_short_name(col("output_section")),
        "human_review_required": col("review_reason").isNotNull(),
    })


def control_filter(controls: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Mark controls INCLUDED or EXCLUDED; a blank control id is excluded first."""
    crit = F.col("criticality_raw")
    # fixed values: readers of the canonical findings look for these reasons
    reason = (
        F.when(F.col("control_id") == "", "Control ID blank — excluded from report")
        .when(F.col("scanner_status") == "PASS", "Status=PASS — passing controls excluded from report")
        .when(F.col("scanner_status") == "UNKNOWN", F.concat(
            F.lit("Status=UNKNOWN — unrecognised result value '"), F.coalesce("raw_result", F.lit("None")), F.lit("'"),
        ))
        .when((crit != "") & ~crit.isin(*rules.include_criticality), F.concat(
            F.lit("Criticality='"), crit,
            F.lit(f"' not in include_criticality={quoted_list(rules.include_criticality)}"),
        ))
    )
    return controls.withColumn("exclusion_reason", reason).withColumn(
        "report_inclusion", F.when(F.col("exclusion_reason").isNull(), INCLUDED).otherwise(EXCLUDED)
    )


def control_duplicate_keys(filtered: DataFrame) -> DataFrame:
    """Keys held by several rows; the primary is the first included row, else the first row."""
    place = F.col("row_seq") + F.when(F.col("report_inclusion") == INCLUDED, F.lit(0)).otherwise(F.lit(_LAST))
    return (
        filtered.groupBy("run_id", "dedup_key")
        .agg(F.min(place).alias("_place"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .withColumn("primary_seq", F.col("_place").bitwiseAND(F.lit(_LAST - 1)))
        .drop("_place")
    )


def dedup_controls(filtered: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Flag every further row of a key, included or not, and link it to the primary."""
    keys = materialise(control_duplicate_keys(filtered), "control-duplicate-keys") if keys is None else keys
    joined = filtered.join(keys.drop("copies"), ["run_id", "dedup_key"], "left")
    duplicate = F.coalesce(F.col("row_seq") != F.col("primary_seq"), F.lit(False))
    return (
        joined.withColumn("was_included", F.col("report_inclusion") == INCLUDED)
        .withColumn("is_duplicate", duplicate)
        .withColumn("duplicate_of", F.when(F.col("is_duplicate"), instance_id(F.col("run_id"), F.col("primary_seq"))))
        .withColumns({
            "report_inclusion": F.when(F.col("is_duplicate"), EXCLUDED).otherwise(F.col("report_inclusion")),
            "exclusion_reason": F.when(F.col("is_duplicate"), F.concat(
                F.lit("Duplicate of "), F.col("duplicate_of"), F.lit(" (same dedup_key)"),
            )).otherwise(F.col("exclusion_reason")),
        })
        .drop("primary_seq")
    )


def processed_controls(normalised: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return dedup_controls(control_filter(normalised, rules))


def control_duplicate_warnings(processed: DataFrame) -> DataFrame:
    return processed.filter("is_duplicate").select(
        "run_id", F.lit("process").alias("stage"), F.lit("DUPLICATE_FINDING").alias("code"),
        F.concat(
            F.lit("Control "), "control_id", F.lit(" appears more than once. Keeping "), "duplicate_of",
            F.lit(", excluding "), "finding_instance_id", F.lit("."),
        ).alias("message"),
        "row_no", F.col("control_id").alias("check_id"), F.col("finding_instance_id").alias("finding_id"),
    )


def control_groups(processed: DataFrame) -> DataFrame:
    """One group per included control, in report order, numbered per section.

    After duplicate marking a run holds each control of a tenant once; over many tenants that may be very many
    rows.  Ranks are worked out on narrow rows dealt out by ranges, never in one window over a run.
    """
    active = processed.filter((F.col("report_inclusion") == INCLUDED) & ~F.col("is_duplicate"))
    narrow = active.select(
        "run_id", "row_seq", "control_id", "output_section", section_rank(F.col("output_section")).alias("_section"),
        severity_rank(F.col("severity"), CONTROL_SEVERITY_RANK, "low").alias("_severity"),
    )
    ranked = rank_rows(narrow, ["run_id"], ["_section", "_severity", "control_id", "row_seq"], "group_order")
    ranked = rank_rows(ranked, ["run_id", "output_section"], ["_severity", "control_id", "row_seq"], "ref_number")
    several = narrow.groupBy("run_id", "control_id").agg(F.count(F.lit(1)).alias("_tenants"))
    places = ranked.join(several, ["run_id", "control_id"]).select("run_id", "row_seq", "group_order", "ref_number", "_tenants")
    tenant_key = F.concat_ws(":", "control_id", "tenant_id")
    groups = active.join(places, ["run_id", "row_seq"]).withColumns({
        "check_id": F.col("control_id"),
        "output_group_key": tenant_key,
        # A run over several tenants holds a control once per tenant.
        "member_key": F.when(F.col("_tenants") == 1, F.col("control_id")).otherwise(tenant_key),
    }).drop("_tenants")
    return groups.withColumn("ref_label", fn.ref_label(F.col("ref_prefix"), F.col("ref_number")))


def control_run_counts(processed: DataFrame) -> DataFrame:
    return processed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_ingested"),
        F.count_if(F.col("was_included") & ~F.col("is_duplicate")).alias("included"),
        F.count_if(~F.col("was_included")).alias("excluded"),
        F.count_if(F.col("was_included") & F.col("is_duplicate")).alias("duplicates"),
    )


def control_audit(processed: DataFrame) -> DataFrame:
    """Audit rows of control ingest, filter and duplicate marking, in one pass."""
    null = F.lit(None).cast("string")
    event = lambda when, stage_no, seq, stage, field, old, new, reason: F.when(when, F.struct(
        F.lit(stage_no).alias("stage_no"), F.lit(seq).alias("seq"), F.lit(stage).alias("stage"),
        F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value"), reason.alias("reason"),
        F.lit("pipeline").alias("actor"),
    ))
    excluded = (F.col("report_inclusion") == EXCLUDED) & ~F.col("is_duplicate")
    events = F.array_compact(F.array(
        event(F.col("human_review_required"), 1, 0, "ingest", "human_review_required", F.lit("false"),
              F.lit("true"), F.col("review_reason")),
        event(F.lit(True), 1, 1, "ingest", "ingested", null, F.col("control_id"),
              F.concat(F.lit("Parsed from row "), F.col("row_no").cast("string"))),
        event(excluded, 2, 0, "process", "report_inclusion", F.lit(INCLUDED), F.lit(EXCLUDED),
              F.col("exclusion_reason")),
        event(F.col("is_duplicate"), 2, 1, "process", "report_inclusion",
              F.when(F.col("was_included"), INCLUDED).otherwise(EXCLUDED), F.lit(EXCLUDED), F.col("exclusion_reason")),
    ))
    return processed.select("run_id", "finding_instance_id", F.explode(events).alias("e")).select(
        "run_id", "finding_instance_id", "e.*"
    )
