"""Report tables, summaries and nested exports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.controls import ref_label
from sightline.functions.text import client_slug, sanitise_cell, strip, text_or
from sightline.operators.grouping import attach_members, merged_instances, section_rank
from sightline.operators.numbering import number_rows
from sightline.rules import CONTROL_SECTIONS, CONTROL_SEVERITY_RANK, Rules, lookup, severity_rank
from sightline.schemas import RAW_FIELDS
from sightline.session import materialise

REPORT_COLUMNS = [
    "ref", "finding", "risk_rating", "root_cause", "likelihood", "consequence_rating",
    "access_required", "situation", "consequence", "recommendations",
]
#: Fixed values of report cells: the heading of the resource list, and what stands for a missing remediation.
RESOURCE_HEADING, NO_REMEDIATION = "Affected resources:", "[See vendor documentation]"
#: Lines of a row of the resource text table, which bounds a cell.
LINES_PER_PART = 1000


# --- affected resources ---------------------------------------------------------------


def resource_lines(members: DataFrame, groups: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct ``resource (account)`` lines of each merged group, numbered in instance order.

    ``findings`` are working-set rows.  They are reduced to one row per group
    and line before anything is ordered, and numbered in buckets, so a check
    that failed on a third of all rows stays spread over many tasks.
    """
    resource = text_or(F.col("resource_uid_normalised"), F.coalesce("raw_resource_name", "raw_resource_uid"))
    account = text_or(F.col("raw_account_name"), F.coalesce("raw_account_uid", F.lit("")))
    line = F.when(account != "", F.concat(resource, F.lit(" ("), account, F.lit(")"))).otherwise(resource)
    rows = findings.select("run_id", "check_id", "output_section", "row_seq", resource.alias("_r"), line.alias("line"))
    per_check = (
        rows.filter((F.col("_r") != "") & (F.col("_r") != "no_resource"))
        .groupBy("run_id", "check_id", "output_section", "line")
        .agg(F.min("row_seq").alias("row_seq"))
    )
    per_group = merged_instances(members, groups, per_check)
    first = Window.partitionBy("run_id", "group_no", "line").orderBy("member_pos", "row_seq")
    once = per_group.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(
        "run_id", "group_no", "line", "member_pos", "row_seq"
    )
    once = materialise(once, "resource-lines")  # numbering reads its rows twice
    return number_rows(once, ["run_id", "group_no"], ["member_pos", "row_seq"]).select(
        "run_id", "group_no", "pos", "line"
    )


def resource_text(lines: DataFrame, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """Bullet text of each group's resources, in parts of a bounded number of lines.

    A text of any length is kept whole: its parts, in order, are the text.
    """
    bullet = F.concat(F.lit("  • "), "line")
    part = F.floor((F.col("pos") - 1) / lines_per_part).cast("int")
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "bullet"))), lambda s: s["bullet"]), "\n"
    )
    return (
        lines.select("run_id", "group_no", "pos", bullet.alias("bullet"), part.alias("part_no"))
        .groupBy("run_id", "group_no", "part_no").agg(body.alias("body"))
        .select("run_id", "group_no", "part_no", F.when(
            F.col("part_no") == 0, F.concat(F.lit(f"{RESOURCE_HEADING}\n"), "body")
        ).otherwise(F.col("body")).alias("resource_text"))
    )


def resource_detail(members: DataFrame, groups: DataFrame, findings: DataFrame) -> DataFrame:
    """Attributes of every finding of every merged group, one row each."""
    wanted = findings.select(
        "run_id", "check_id", "output_section", "row_seq", "finding_instance_id",
        F.col("resource_uid_normalised").alias("resource_uid"),
        *[
            F.coalesce(f"raw_{c}", F.lit("")).alias(c)
            for c in ("resource_name", "account_uid", "account_name", "resource_type", "status_extended")
        ],
        F.col("region_normalised").alias("region"),
    )
    return merged_instances(members, groups, wanted)


# --- recommendations ---------------------------------------------------------------------


def recommendation_text(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Remediation of each merged group: per member, or the short form for a single check."""
    cell = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    title = text_or(F.col("raw_check_title"), F.col("check_id"))
    fix = cell("raw_remediation_recommendation_text")
    cli, tf = cell("raw_remediation_code_cli"), cell("raw_remediation_code_terraform")
    tail = lambda label, c: F.when(c != "", F.concat(F.lit(f"\n  {label}: "), c)).otherwise("")
    in_list = F.concat(
        title, F.lit(":\n"), F.when(fix != "", fix).otherwise(NO_REMEDIATION),
        tail("CLI", cli), tail("Terraform", tf),
    )
    alone = F.array_join(F.filter(F.array(
        fix,
        F.when(cli != "", F.concat(F.lit("CLI: "), cli)),
        F.when(tf != "", F.concat(F.lit("Terraform: "), tf)),
    ), lambda x: x.isNotNull() & (x != "")), "\n")
    rows = attach_members(members, groups).select(
        "run_id", "group_no", "member_pos", in_list.alias("in_list"), alone.alias("alone")
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("member_pos", "in_list"))), lambda s: s["in_list"])
    return rows.groupBy("run_id", "group_no").agg(
        F.when(F.count(F.lit(1)) > 1, F.array_join(texts, "\n\n")).otherwise(F.max("alone")).alias("recommendations")
    )


# --- report rows -----------------------------------------------------------------------------


def assign_refs(groups: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Reference of each resource group: section prefix and place in approval order."""
    place = F.row_number().over(Window.partitionBy("run_id", "output_section").orderBy("group_no"))
    prefix = lookup(F.col("output_section"), rules.ref_prefix, F.upper(F.left("output_section", F.lit(3))))
    return groups.withColumn("ref_number", place).withColumn("ref", ref_label(prefix, F.col("ref_number")))


def section_order(section: Column) -> Column:
    """Sheet order of resource reports: AWS, Azure, then the others by name."""
    return lookup(section, {"AWS": 0, "Azure": 1}, 2)


def report_rows(enriched: DataFrame, lines: DataFrame, recommendations: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The ten report columns of resource groups, one row for each group, and the number of its affected resources.

    ``lines`` are the groups' ``resource_lines``.  They stay a table of their own, joined by run and group: a
    group may have any number of them.
    """
    counts = lines.groupBy("run_id", "group_no").agg(F.count(F.lit(1)).alias("affected_resources"))
    rows = (
        assign_refs(enriched, rules)
        .join(recommendations, ["run_id", "group_no"], "left")
        .join(counts, ["run_id", "group_no"], "left")
    )
    situation = F.rtrim(F.coalesce("situation_narrative", F.lit("")))
    cell = sanitise_cell
    return rows.select(
        "run_id", F.col("output_section").alias("sheet"), section_order(F.col("output_section")).alias("sheet_order"),
        "group_no", "ref_number", F.coalesce("affected_resources", F.lit(0)).alias("affected_resources"), sanitise_cell(F.col("ref")).alias("ref"),
        cell(text_or(F.col("finding_title"), F.col("group_name"))).alias("finding"),
        cell(text_or(F.col("risk_rating"), "Medium")).alias("risk_rating"),
        cell(F.col("root_cause_narrative")).alias("root_cause"),
        cell(F.col("likelihood_rating")).alias("likelihood"),
        cell(F.col("consequence_rating")).alias("consequence_rating"),
        cell(F.col("access_required")).alias("access_required"),
        sanitise_cell(situation).alias("situation"),
        cell(F.col("consequence_narrative")).alias("consequence"),
        cell(F.col("recommendations")).alias("recommendations"),
    )


def assign_control_refs(merged: DataFrame) -> DataFrame:
    """Reference of each enriched control group in report order; the prefix is the first member's."""
    severity = severity_rank(F.col("group_severity"), CONTROL_SEVERITY_RANK, "low")
    place = Window.partitionBy("run_id", "output_section").orderBy(severity, "group_name", "group_no")
    return merged.withColumn("ref_number", F.row_number().over(place)).withColumn(
        "ref", ref_label(F.col("first_ref_prefix"), F.col("ref_number"))
    )


def first_prefix(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Ref prefix of the first member of each merged control group."""
    return attach_members(members, groups).groupBy("run_id", "group_no").agg(
        F.min_by("ref_prefix", "member_pos").alias("first_ref_prefix")
    )


def control_report_rows(enriched: DataFrame) -> DataFrame:
    """Heading and finding rows of control reports.

    Every standard section of every run has a heading, even without findings;
    findings of other sections go under a last heading 'Other'.
    """
    known = F.col("output_section").isin(*CONTROL_SECTIONS)
    base = assign_control_refs(enriched).withColumns({
        "section": F.when(known, F.col("output_section")).otherwise("Other"),
        "section_order": section_rank(F.col("output_section")),
    })
    cell = lambda c, fallback="": text_or(F.col(c), fallback)
    root = cell("root_cause_narrative")
    findings = base.select(
        "run_id", "section", "section_order", F.lit("finding").alias("kind"), "ref_number",
        F.col("ref"), text_or(F.col("finding_title"), text_or(F.col("check_title"), F.col("group_name"))).alias("finding"),
        cell("risk_rating", "Medium").alias("risk_rating"), root.alias("root_cause"),
        cell("likelihood_rating", "Medium").alias("likelihood"),
        cell("consequence_rating", "Moderate").alias("consequence_rating"),
        cell("access_required").alias("access_required"), cell("situation_narrative").alias("situation"),
        cell("consequence_narrative").alias("consequence"),
        text_or(F.col("recommendations"), root).alias("recommendations"),
    )
    sections = F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(i).alias("section_order")) for i, s in enumerate(CONTROL_SECTIONS)
    ]))
    runs = enriched.select("run_id").distinct().select("run_id", sections.alias("s")).select("run_id", "s.*")
    other = base.filter("section = 'Other'").select("run_id", "section", "section_order").distinct()
    blank = {c: F.lit("") for c in REPORT_COLUMNS}
    headings = runs.unionByName(other).select(
        "run_id", "section", "section_order", F.lit("heading").alias("kind"), F.lit(0).alias("ref_number"),
        *[(F.col("section") if c == "finding" else v).alias(c) for c, v in blank.items()],
    )
    return headings.unionByName(findings)


def report_meta(enriched: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per run: client, period and group counts."""
    return enriched.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(~F.col("enrichment_failed")).alias("enriched"),
        F.count_if("enrichment_failed").alias("failed"),
    ).select(
        "run_id", F.lit(rules.client_name or "Client").alias("client"), F.lit(rules.assessment_period).alias("period"),
        "groups", "enriched", "failed",
    )


def narrative_report(enriched: DataFrame) -> DataFrame:
    """One text block per enriched group."""
    block = lambda label, c: F.concat(F.lit(f"{label}:\n  "), text_or(F.col(c), "[not set]"))
    shown = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    return enriched.select("run_id", "group_no", F.concat_ws(
        "\n",
        F.concat(F.lit("== "), "group_name", F.lit(" ==")),
        shown("Section", "output_section"), shown("Severity", "severity"), shown("Likelihood", "likelihood_rating"),
        shown("Consequence", "consequence_rating"), shown("Risk rating", "risk_rating"),
        shown("Instances", "instance_count"),
        block("Finding title", "finding_title"), block("Root cause", "root_cause_narrative"),
        block("Situation", "situation_narrative"), block("Consequence", "consequence_narrative"),
        block("Access required", "access_required"),
        F.when(F.col("enrichment_failed"), F.concat(F.lit("Failed: "), "failure_reason")),
    ).alias("text"))


# --- nested exports and summaries ---------------------------------------------------------------


def finding_export(processed: DataFrame) -> DataFrame:
    """Nested record of every finding, excluded and duplicate ones included.

    Audit events stay in their own table, keyed by run and finding.
    """
    raw = F.struct(*[F.col(f).alias(f.removeprefix("raw_")) for f in RAW_FIELDS])
    return processed.select(
        "run_id", "finding_instance_id", "stable_finding_key", "dedup_key", "source_row_id", "source_file_hash",
        F.struct(
            "scanner_status", "report_inclusion", "is_duplicate", "duplicate_of", "human_review_required",
            "review_reason", "muted_reconciled",
        ).alias("state"),
        F.struct(
            "blank_description", "blank_risk", "blank_remediation", "blank_region", "region_normalised",
            "resource_uid_normalised", "arn_fallback_used", "categories_list", "compliance_values",
            "compliance_parsed", "account_tags_parsed", "resource_tags_parsed",
        ).alias("normalised"),
        raw.alias("raw"), "extra_fields",
    )


def group_export(groups: DataFrame) -> DataFrame:
    """Nested record of every check group with a summary of its representative."""
    return groups.select(
        "run_id", "group_order", "output_group_key", "check_id", "output_section", "instance_count",
        "likelihood_rating",
        F.struct(
            "finding_instance_id", "source_row_id", F.col("raw_check_title").alias("check_title"),
            F.col("raw_severity").alias("severity"), F.col("raw_service_name").alias("service_name"),
            F.col("raw_resource_type").alias("resource_type"), F.col("region_normalised").alias("region"),
            "completeness_score", F.col("raw_description").isNotNull().alias("has_description"),
            F.col("raw_risk").isNotNull().alias("has_risk"),
            F.col("raw_remediation_recommendation_text").isNotNull().alias("has_remediation"),
            "human_review_required",
        ).alias("representative"),
    )


def run_manifest(counts: DataFrame, warnings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per run: counts, configuration, and the number of warnings per code.

    The warnings themselves are a table of their own; a run may have millions.
    """
    per_code = warnings.groupBy("run_id", "stage", "code").agg(F.count(F.lit(1)).alias("n"))
    listed = per_code.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("stage", "code", "n"))).alias("warnings")
    )
    config = F.struct(
        F.array(*[F.lit(s) for s in rules.include_statuses]).alias("include_statuses"),
        F.lit(str(rules.severity_rules)).alias("severity_rules"),
        F.lit(str(rules.risk_matrix)).alias("risk_matrix"),
    )
    return counts.join(listed, "run_id", "left").withColumns({
        "schema_version": F.lit("1.0.0"), "config": config,
        "client_slug": client_slug(F.lit(rules.client_name)),
    })


def tidy(df: DataFrame, section: str, key: str, value: str) -> DataFrame:
    """Counts as summary rows ``(run_id, section, key, value)``."""
    return df.select(
        "run_id", F.lit(section).alias("section"), F.col(key).cast("string").alias("key"),
        F.col(value).cast("long").alias("value"),
    )


def unpivot_counts(df: DataFrame, section: str) -> DataFrame:
    """One-row-per-run counts as summary rows."""
    names = [c for c in df.columns if c != "run_id"]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("key"), F.col(n).cast("long").alias("value")) for n in names
    ]))
    return df.select("run_id", F.lit(section).alias("section"), pairs.alias("p")).select("run_id", "section", "p.*")
