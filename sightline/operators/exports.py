"""Nested exports: enriched groups with their resources in pages, proposals, review boards."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import text_or
from sightline.operators.grouping import affected_resources, attach_members, order_merged
from sightline.operators.numbering import number_rows
from sightline.session import materialise_bucketed

#: Resources and accounts that a page of a group holds at most.
PAGE = 1000
#: Buckets of the written pages: this many, and more where a bucket would hold more findings than this.
BUCKETS, BUCKET_ROWS = 32, 500_000
PAGE_KEYS = ["run_id", "group_no", "page_no"]
_DETAIL = ("resource_uid", "resource_name", "account_uid", "account_name", "region", "resource_type", "status_extended")


def _pages(rows: DataFrame, fields: tuple[str, ...], out: str, size: int) -> DataFrame:
    """Numbered rows (``pos`` from 1) gathered into arrays of at most ``size`` structs, in order."""
    page = F.floor((F.col("pos") - 1) / size).cast("int")
    held = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("item")))), lambda x: x["item"]
    )
    return rows.withColumn("page_no", page).groupBy(*PAGE_KEYS).agg(held.alias(out))


def group_pages(detail: DataFrame, accounts: DataFrame, size: int = PAGE) -> DataFrame:
    """(run_id, group_no, page_no, affected_resources, affected_accounts): pages of bounded size.

    ``detail`` are the rows of ``report.resource_detail``, ``accounts`` those of ``grouping.merged_accounts``.
    A group of any size has as many pages as it needs, so no cell and no task grows with it.
    """
    numbered = number_rows(detail, ["run_id", "group_no"], ["member_pos", "row_seq"])
    resources = _pages(numbered, _DETAIL, "affected_resources", size)
    names = _pages(accounts, ("account",), "affected_accounts", size).withColumn(
        "affected_accounts", F.transform("affected_accounts", lambda x: x["account"])
    )
    return resources.join(names, PAGE_KEYS, "full").withColumns({
        c: F.coalesce(c, F.array().cast(kind)) for c, kind in (
            ("affected_resources", resources.schema["affected_resources"].dataType), ("affected_accounts", "array<string>"),
        )
    })


def enriched_groups(
    enriched: DataFrame, recommendations: DataFrame, pages: DataFrame, buckets: int | None = None,
) -> DataFrame:
    """Enriched groups with narratives, risk and remediation, one row for each page of resources and accounts.

    Groups and pages are both written in buckets of run, group and page, so they are joined without a shuffle
    and the pages of a large group lie in many buckets.  A group without resources has one empty page.
    Without ``buckets`` their number follows the findings of ``enriched``, so that a bucket does not grow with them.
    """
    if buckets is None:
        findings = enriched.agg(F.sum("instance_count")).first()[0] or 0
        buckets = max(BUCKETS, math.ceil(findings / BUCKET_ROWS))
    held = materialise_bucketed(pages, "group-pages", PAGE_KEYS, buckets)
    counts = held.groupBy("run_id", "group_no").agg(F.max("page_no").alias("last_page"))
    header = enriched.join(recommendations, ["run_id", "group_no"], "left").join(counts, ["run_id", "group_no"], "left").select(
        "run_id", "group_no", "group_name", "check_ids", "output_section", "instance_count", "likelihood_rating", "risk_rating",
        "consequence_rating", "finding_title", "root_cause_narrative", "situation_narrative", "consequence_narrative",
        "access_required", "recommendations", (~F.col("enrichment_failed")).alias("ai_enriched"),
        F.col("enrichment_failed").alias("llm_failed"), F.col("enrichment_review").isNotNull().alias("human_review_required"),
        (F.coalesce("last_page", F.lit(0)) + 1).alias("pages"),
        F.explode(F.sequence(F.lit(0), F.coalesce("last_page", F.lit(0)))).alias("page_no"),
    )
    groups = materialise_bucketed(header, "enriched-groups", PAGE_KEYS, buckets)
    return groups.join(held, PAGE_KEYS, "left")


def grouping_proposal(members: DataFrame, groups: DataFrame, merged: DataFrame, accounts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per proposed group: its checks, rationale and resources, with the counts of its run.

    The affected resources are those of the member representatives, so their number is bounded by the checks.
    Accounts are counted; their names are the rows of ``grouping.merged_accounts``.  Write the rows with
    ``sinks.append_version``: a new proposal of a run then supersedes the one before it.
    """
    found = affected_resources(members, groups).groupBy("run_id", "group_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "resource"))), lambda x: x["resource"]).alias("affected_resources")
    )
    named = accounts.groupBy("run_id", "group_no").agg(F.count(F.lit(1)).alias("affected_accounts"))
    rows = (
        merged.select("run_id", "group_no", "group_name", "check_ids", "rationale", "is_merged", "instance_count")
        .join(found, ["run_id", "group_no"], "left").join(named, ["run_id", "group_no"], "left")
        .withColumns({
            "affected_resources": F.coalesce("affected_resources", F.array().cast("array<string>")),
            "affected_accounts": F.coalesce("affected_accounts", F.lit(0)),
        })
    )
    before = groups.groupBy("run_id").agg(F.count(F.lit(1)).alias("original_count"))
    after = merged.groupBy("run_id").agg(F.count(F.lit(1)).alias("merged_count"), F.count_if("is_merged").alias("merges_applied"))
    used = chunks.groupBy("run_id").agg(F.max("chunk_no").alias("chunks_used"))
    return rows.join(before.join(after, "run_id").join(used, "run_id", "left"), "run_id")


def check_lookup(groups: DataFrame) -> DataFrame:
    """(run_id, checks): what a board shows of each check, as one map per run; its size is the check catalogue's."""
    shown = F.struct(
        F.coalesce(text_or(F.col("raw_check_title"), F.col("check_id")), F.lit("")).alias("check_title"),
        text_or(F.col("raw_severity"), "unknown").alias("severity"), "instance_count",
        text_or(F.col("likelihood_rating"), "Unknown").alias("likelihood"), F.coalesce("raw_service_name", F.lit("")).alias("service"),
        F.coalesce("categories_list", F.array().cast("array<string>")).alias("categories"),
    )
    return groups.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("member_key", shown.alias("shown")))).alias("checks"))


def review_board(members: DataFrame, groups: DataFrame, merged: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per card of a review board, in board order: its checks by key, severity, likelihood, resources.

    Titles and severities of the checks are in :func:`check_lookup`, once for a run.  ``accounts`` is the number
    of distinct accounts; their names are a table of their own.
    """
    place = F.concat(F.lit("grp_"), (F.col("group_order") - 1).cast("string"))
    cards = order_merged(merged).select(
        "run_id", place.alias("id"), "group_no", "group_order", "group_name", "rationale", "is_merged", "instance_count",
        text_or(F.col("severity"), "unknown").alias("severity"), text_or(F.col("likelihood_rating"), "Unknown").alias("likelihood"),
    )
    held = attach_members(members, groups).groupBy("run_id", "group_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("member_pos", "output_group_key", "member_key"))), lambda x: x["member_key"]).alias("checks")
    )
    resource = F.struct("pos", F.struct("resource", "resource_name", "resource_type", "account_name", "account_uid", "region", "check_id").alias("item"))
    resources = affected_resources(members, groups).groupBy("run_id", "group_no").agg(
        F.transform(F.array_sort(F.collect_list(resource)), lambda x: x["item"]).alias("affected_resources")
    )
    named = accounts.groupBy("run_id", "group_no").agg(F.count(F.lit(1)).alias("accounts"))
    return cards.join(held, ["run_id", "group_no"]).join(resources, ["run_id", "group_no"], "left").join(named, ["run_id", "group_no"], "left").fillna({"accounts": 0})


def member_facts(members: DataFrame, lookup: DataFrame) -> DataFrame:
    """Members with the facts of their check, taken from the map of their run."""
    facts = members.join(lookup, "run_id").withColumn("shown", F.try_element_at("checks", F.col("member_key")))
    place = Window.partitionBy("run_id", "group_no").orderBy("pos", "member_key")
    return facts.filter("shown IS NOT NULL").select("run_id", "group_no", "member_key", F.row_number().over(place).alias("place"), "shown.*")
