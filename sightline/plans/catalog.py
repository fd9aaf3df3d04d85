"""Registered queries: every operator over the whole warehouse tables."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import controls as cf
from sightline.functions import nested, prompts, responses, text
from sightline.operators import (
    approvals,
    audit,
    completion,
    controls,
    enrich,
    exports,
    grouping,
    metrics,
    normalise,
    process,
    propose,
    report,
    rule_sets,
    summaries,
)
from sightline import rules, schemas, sinks
from sightline.plans import fixtures, offline
from sightline.rules import Rules, risk_rating
from sightline.schemas import NESTED_FINDING, RESOURCE_COLUMNS, raw_name
from sightline.session import materialise, shared_root
from sightline.sources import delimited, files, json_files, tables

QUERIES: dict = {}
RULES = Rules(client_name="Acme / North", assessment_period="2026")
MODEL = "offline"
GROUP = ["run_id", "check_id", "output_section"]


def query(fn):
    """Register a query; integers leave it as 64-bit, as the oracle has them."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(Tables(spark, sf_dir))
        return df.select(*[
            F.col(f.name).cast("long") if isinstance(f.dataType, T.IntegerType) else F.col(f.name)
            for f in df.schema.fields
        ])

    QUERIES[fn.__name__] = run
    return fn


def _once(method):
    """Build a stage at most once per query: its plan is shared by every use."""

    @wraps(method)
    def get(self):
        if method.__name__ not in self._kept:
            self._kept[method.__name__] = method(self)
        return self._kept[method.__name__]

    return get


class Tables:
    """The stages of a run, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    @_once
    def raw(self) -> DataFrame:
        return tables.findings_view(self.spark, self.sf_dir)

    @_once
    def findings(self) -> DataFrame:
        return normalise.normalise_findings(self.raw())

    @_once
    def base(self) -> DataFrame:
        """What findings are made of and their key for duplicates, narrow rows written once: no later reading makes a key."""
        joined = tables.findings_base(self.spark, self.sf_dir)
        more = [c for c in joined.columns if c != "row_no"]
        found = normalise.normalise_findings(tables.findings_of(self.spark, self.sf_dir, joined, *more))
        keyed = process.with_key(process.status_filter(found, RULES))
        return materialise(keyed.select(*joined.columns, "key"), "findings-base")

    @_once
    def stored(self) -> DataFrame:
        """The raw findings for queries that read them more than once: their joins are written."""
        return tables.findings_of(self.spark, self.sf_dir, self.base())

    @_once
    def filtered(self) -> DataFrame:
        return process.status_filter(normalise.normalise_findings(self.stored()), RULES)

    @_once
    def duplicate_keys(self) -> DataFrame:
        rows = self.base().select("key", F.col("row_no").alias("row_seq"))
        return materialise(process.duplicate_keys(rows), "duplicate-keys")

    @_once
    def marked(self) -> DataFrame:
        """The narrow rows with the first row of their key, written once: no later reading looks for duplicates."""
        located = process.locate_first_rows(self.base().withColumnRenamed("row_no", "row_seq"))
        return materialise(located.withColumnRenamed("row_seq", "row_no"), "findings-base-marked")

    @_once
    def processed(self) -> DataFrame:
        rows = tables.findings_of(self.spark, self.sf_dir, self.marked(), "primary_seq")
        return process.flag_duplicates(process.status_filter(normalise.normalise_findings(rows), RULES))

    @_once
    def working(self) -> DataFrame:
        return process.working_set(self.processed())

    @_once
    def groups(self) -> DataFrame:
        """Check groups, written once: everything after them reads groups only."""
        counts = materialise(process.group_counts(self.working()), "group-counts")
        rows = process.likelihood(process.representatives(self.stored(), counts), RULES)
        return materialise(process.order_groups(rows), "check-groups")

    @_once
    def chunked(self) -> DataFrame:
        return grouping.assign_chunks(self.groups())

    @_once
    def members(self) -> DataFrame:
        return fixtures.run_members(self.groups())

    @_once
    def merged(self) -> DataFrame:
        return grouping.merge_groups(self.members(), self.groups())

    @_once
    def approved(self) -> DataFrame:
        return fixtures.approvals(self.members())

    @_once
    def approved_groups(self) -> DataFrame:
        members = self.approved()
        merged = grouping.merge_groups(members, self.groups())
        return approvals.apply_override(merged, members)

    @_once
    def accounts(self) -> DataFrame:
        names = process.group_accounts(self.working())
        return grouping.merged_accounts(self.approved(), self.groups(), names)

    @_once
    def context(self) -> DataFrame:
        return enrich.resource_context(self.approved_groups(), self.groups(), self.accounts())

    @_once
    def enriched(self) -> DataFrame:
        return materialise(enrich.enrich_groups(self.context(), offline.describe, MODEL, RULES), "enriched")

    @_once
    def edits(self) -> DataFrame:
        return fixtures.board_edits(self.members(), self.groups())

    @_once
    def board(self) -> DataFrame:
        titles = self.groups().select("run_id", "member_key", F.col("raw_check_title").alias("title"))
        return fixtures.board(self.members()).join(titles, ["run_id", "member_key"])

    @_once
    def replayed(self) -> DataFrame:
        return materialise(approvals.replay_boards(self.board(), self.edits()), "boards")

    def assignment(self) -> DataFrame:
        return approvals.board_assignment(self.replayed())

    def board_groups(self) -> DataFrame:
        return approvals.board_groups(self.replayed())

    @_once
    def warnings(self) -> DataFrame:
        found = normalise.ingest_warnings(self.filtered())
        late = process.process_warnings(self.filtered(), self.groups(), self.filtered())
        return audit.union_warnings(found, late, approvals.approval_warnings(self.approved(), self.groups()))

    @_once
    def raw_controls(self) -> DataFrame:
        return tables.controls_view(self.spark, self.sf_dir)

    @_once
    def controls(self) -> DataFrame:
        return controls.normalise_controls(self.raw_controls(), RULES)

    @_once
    def processed_controls(self) -> DataFrame:
        return controls.processed_controls(self.controls(), RULES)

    @_once
    def control_groups(self) -> DataFrame:
        return materialise(controls.control_groups(self.processed_controls()), "control-groups")

    @_once
    def control_members(self) -> DataFrame:
        """Controls of one service and severity form a group."""
        from pyspark.sql import Window

        name = F.concat("service_name", F.lit(" / "), "severity")
        by_name = Window.partitionBy("run_id").orderBy("group_name")
        inside = Window.partitionBy("run_id", "group_name").orderBy("member_key")
        return self.control_groups().select("run_id", name.alias("group_name"), "member_key").select(
            "run_id", F.dense_rank().over(by_name).alias("group_no"), "group_name", F.lit("").alias("rationale"),
            F.row_number().over(inside).alias("pos"), "member_key",
        )

    @_once
    def merged_controls(self) -> DataFrame:
        merged = grouping.merge_groups(
            self.control_members(), self.control_groups(), "severity", controls.CONTROL_SEVERITY_RANK, "low"
        )
        prefix = report.first_prefix(self.control_members(), self.control_groups())
        return merged.join(prefix, ["run_id", "group_no"])

    def scratch(self, label: str) -> str:
        import uuid

        return f"{shared_root(self.spark).rstrip('/')}/sightline/{label}-{uuid.uuid4().hex}"


# --- row-level normalisation --------------------------------------------------------------


@query
def status_reconcile(t):
    return t.findings().select(
        "run_id", "row_no", "raw_status", "raw_muted", "scanner_status", "muted_reconciled", "unknown_status"
    )


@query
def status_breakdown(t):
    return metrics.status_breakdown(t.findings())


@query
def muted_overrides(t):
    return t.findings().filter("muted_reconciled").select(
        "run_id", "row_no", "source_row_id", "raw_check_id", "raw_status", "scanner_status"
    )


@query
def blank_classes(t):
    return t.findings().select("run_id", "row_no", "blank_description", "blank_risk", "blank_remediation", "blank_region")


@query
def blank_breakdown(t):
    return metrics.blank_breakdown(t.findings())


@query
def review_flags(t):
    return t.findings().select("run_id", "row_no", "human_review_required", "review_reason")


@query
def resource_normalise(t):
    return t.findings().select("run_id", "row_no", "resource_uid_normalised", "arn_fallback_used", "region_normalised")


@query
def stable_keys(t):
    return t.findings().select("run_id", "row_no", "stable_finding_key")


@query
def dedup_keys(t):
    return t.findings().select("run_id", "row_no", "dedup_key")


@query
def finding_ids(t):
    return t.findings().select("run_id", "row_no", "finding_instance_id", "source_row_id")


@query
def pipe_lists(t):
    return t.findings().select("run_id", "row_no", F.posexplode("categories_list").alias("pos", "category"))


@query
def tag_maps(t):
    tags = t.findings().select("run_id", "row_no", F.explode("resource_tags_parsed").alias("tag_key", "tag_value"))
    account = t.findings().select("run_id", "row_no", F.explode("account_tags_parsed").alias("tag_key", "tag_value"))
    return tags.unionByName(account)


@query
def compliance_values(t):
    return t.findings().select("run_id", "row_no", "compliance_parsed", F.posexplode("compliance_values").alias("pos", "item"))


@query
def completeness_scores(t):
    return t.findings().select("run_id", "row_no", "completeness_score")


@query
def ingest_warnings(t):
    return normalise.ingest_warnings(t.findings())


@query
def scanner_versions(t):
    return normalise.scanner_version(t.findings())


@query
def column_aliases(t):
    """Old column names of an export header, mapped by name."""
    from sightline.schemas import COLUMN_ALIASES
    from sightline.sources.files import canonical_name

    old = F.element_at(F.array(*[F.lit(c.lower()) for c in sorted(COLUMN_ALIASES)]), (F.col("p_size") % 12 + 1).cast("int"))
    return t.table("part").select("p_partkey", old.alias("header")).withColumn("column_name", canonical_name(F.col("header")))


@query
def unknown_columns(t):
    extra = F.create_map(F.concat(F.lit("future_"), F.lower("raw_check_type")), F.col("raw_check_id"))
    return normalise.unknown_column_warnings(t.raw().withColumn("extra_fields", extra))


@query
def client_slugs(t):
    name = F.concat(F.lit(" "), "s_name", F.lit(" / Ltd. & Söhne "))
    return t.table("supplier").select(
        "s_suppkey", text.client_slug(name).alias("slug"), text.client_folder(name).alias("folder")
    )


@query
def sanitise_cells(t):
    return t.findings().select("run_id", "row_no", text.sanitise_cell(F.col("raw_remediation_code_terraform")).alias("cell"))


# --- filter, duplicates, groups -----------------------------------------------------------------


@query
def status_filter(t):
    return process.status_filter(t.findings(), RULES).select("run_id", "row_no", "report_inclusion", "exclusion_reason")


@query
def dedup_findings(t):
    return t.processed().select("run_id", "row_no", "is_duplicate", "duplicate_of", "report_inclusion", "exclusion_reason")


@query
def duplicate_links(t):
    return t.processed().filter("is_duplicate").select("run_id", "finding_instance_id", "duplicate_of", "raw_check_id")


@query
def excluded_listing(t):
    return t.processed().filter("report_inclusion = 'EXCLUDED' AND NOT is_duplicate").select(
        "run_id", "row_no", "raw_check_id", "raw_account_name", "scanner_status", "exclusion_reason"
    )


@query
def run_counts(t):
    return metrics.run_counts(process.assign_section(t.processed()))


@query
def section_assign(t):
    return process.assign_section(t.findings()).select("run_id", "row_no", "check_id", "output_section")


@query
def check_groups(t):
    return process.group_counts(t.working())


@query
def representatives(t):
    return t.groups().select(
        *GROUP, "row_no", "finding_instance_id", "completeness_score", "instance_count", "raw_severity",
        "raw_check_title", "raw_account_name", "resource_uid_normalised",
    )


@query
def ordered_groups(t):
    return t.groups().select("run_id", "group_order", "output_group_key", "member_key", "check_id", "output_section", "instance_count")


@query
def group_export(t):
    g = report.group_export(t.groups())
    return g.select("run_id", "group_order", "output_group_key", "instance_count", "likelihood_rating", "representative.*")


@query
def finding_export(t):
    e = report.finding_export(t.processed())
    return e.select(
        "run_id", "finding_instance_id", "stable_finding_key", "dedup_key", "source_row_id", "state.report_inclusion",
        "state.duplicate_of", "normalised.region_normalised", "raw.check_id", "raw.status",
    )


@query
def group_accounts(t):
    return process.group_accounts(t.working())


@query
def group_account_uids(t):
    return process.group_accounts(t.working(), "raw_account_uid")


@query
def group_instances(t):
    return process.group_instances(t.working())


@query
def likelihood(t):
    return t.groups().select(*GROUP, "likelihood_rating", "likelihood_reason")


@query
def likelihood_distribution(t):
    return metrics.likelihood_distribution(t.groups())


@query
def section_counts(t):
    return metrics.section_counts(t.groups())


@query
def top_k_review(t):
    rows = t.findings().filter("human_review_required").select("run_id", "row_seq", "row_no", "raw_check_id", "review_reason")
    return metrics.first_k(rows, 10).drop("row_seq")


@query
def top_k_fallbacks(t):
    rows = t.findings().filter("arn_fallback_used AND resource_uid_normalised <> ''").select(
        "run_id", "row_seq", "row_no", "raw_check_id", "resource_uid_normalised"
    )
    return metrics.first_k(rows, 5).drop("row_seq")


# --- chunks, proposals, merging --------------------------------------------------------------------


@query
def chunk_assign(t):
    return t.chunked().select("run_id", "member_key", "chunk_no", "chunk_pos", "chunk_count")


@query
def running_names(t):
    names = grouping.earlier_names(fixtures.chunk_members(t.chunked()))
    return names.select("run_id", "chunk_no", F.array_join("existing_names", ";").alias("existing_names"))


SCOPE = ["run_id", "chunk_no"]


@query
def proposal_missing(t):
    return grouping.missing_members(t.chunked(), fixtures.chunk_members(t.chunked()), SCOPE)


@query
def proposal_unexpected(t):
    return grouping.unexpected_members(t.chunked(), fixtures.chunk_members(t.chunked()), SCOPE)


@query
def proposal_duplicates(t):
    return grouping.duplicate_members(fixtures.chunk_members(t.chunked()), SCOPE)


@query
def partition_check(t):
    return grouping.partition_check(t.chunked(), fixtures.chunk_members(t.chunked()), SCOPE)


@query
def merged_groups(t):
    return grouping.order_merged(t.merged()).select(
        "run_id", "group_no", "group_order", "group_name", "output_section", "severity", "likelihood_rating",
        "instance_count", "member_count", "is_merged", F.array_join("check_ids", ", ").alias("check_ids"),
    )


@query
def best_representative(t):
    return t.merged().select("run_id", "group_no", "representative.finding_instance_id", "representative.check_id")


@query
def affected_resources(t):
    return grouping.affected_resources(t.members(), t.groups())


@query
def merged_accounts(t):
    return grouping.merged_accounts(t.members(), t.groups(), process.group_accounts(t.working()))


@query
def merged_instances(t):
    return grouping.merged_instances(t.members(), t.groups(), process.group_instances(t.working())).select(
        "run_id", "group_no", "member_pos", "row_seq", "finding_instance_id"
    )


@query
def trivial_groups(t):
    return grouping.trivial_members(t.groups()).select("run_id", "group_no", "group_name", "member_key")


@query
def grouping_stats(t):
    return metrics.grouping_stats(t.groups(), t.merged(), t.chunked())


@query
def propose_groups(t):
    """Chunk rounds and consolidation with the offline completion function."""
    found = propose.propose_groups(t.chunked(), offline.group_by_first_word, MODEL)
    return found.members.select("run_id", "group_name", "rationale", "member_key")


@query
def grouping_warnings(t):
    """Chunks that failed twice and fell back to standalone groups."""
    _, warnings = propose.propose_chunks(t.chunked(), offline.group_by_first_word, MODEL)
    return warnings.select("run_id", "code", "message")


@query
def regroup_boards(t):
    """A board-wide instruction for every run, answered offline."""
    asks = t.groups().select("run_id").distinct().select(
        "run_id", F.lit(1).alias("seq"), F.lit("merge by word").alias("instruction"), F.lit(None).cast("string").alias("target_group")
    )
    pool = t.groups().select("run_id", "member_key").limit(0)
    found = propose.regroup(asks, t.members(), pool, _regroup_answer, MODEL)
    return found.select("run_id", "seq", "ok", "error", F.size("groups").alias("groups"))


def _regroup_answer(prompt: str, max_tokens: int, timeout_seconds: int) -> str:
    import json
    import re

    groups = re.findall(r'^"(.*?)": (.*)$', prompt, re.M)
    return json.dumps([{"group_name": n.split(" / ")[0] + "!", "check_ids": ids.split(", ")} for n, ids in groups])


# --- review --------------------------------------------------------------------------------------------


@query
def approval_apply(t):
    return t.approved_groups().select(
        "run_id", "group_no", "group_name", "output_section", "severity", "likelihood_rating", "instance_count",
        "member_count", "is_merged", "risk_override",
    )


@query
def approval_unknown(t):
    return approvals.approval_warnings(t.approved(), t.groups()).select("run_id", "code", "message", "check_id")


@query
def board_edits(t):
    return t.assignment().select("run_id", "member_key", "group_id")


@query
def board_group_state(t):
    return t.board_groups()


@query
def board_stats(t):
    return approvals.board_stats(t.assignment())


@query
def board_cards(t):
    return approvals.board_cards(t.assignment(), t.groups(), process.group_accounts(t.working()))


@query
def approval_gate(t):
    return approvals.approval_gate(t.assignment(), t.board_groups())


@query
def unassigned_pool(t):
    return approvals.unassigned(t.assignment())


@query
def approvals_from_board(t):
    return approvals.approvals_from_board(t.assignment(), t.board_groups()).select(
        "run_id", "group_no", "group_name", "pos", "member_key", "risk_rating_override"
    )


@query
def carry_forward(t):
    """Boards regrouped by first word of the check id: what the new groups inherit."""
    from pyspark.sql import Window

    state = t.approved().filter("pos > 0").join(
        t.groups().select("run_id", "member_key", "output_section"), ["run_id", "member_key"]
    ).select("run_id", "member_key", "output_section", "risk_rating_override")
    name = F.substring_index("member_key", "_", 1)
    by_name = Window.partitionBy("run_id").orderBy("group_name")
    inside = Window.partitionBy("run_id", "group_name").orderBy("member_key")
    new = t.groups().select("run_id", name.alias("group_name"), "member_key").select(
        "run_id", F.dense_rank().over(by_name).alias("group_no"), "group_name",
        F.row_number().over(inside).alias("pos"), "member_key",
    )
    resources = t.groups().filter("resource_uid_normalised <> ''").select(
        "run_id", "member_key", F.col("resource_uid_normalised").alias("resource")
    )
    return approvals.carry_forward(state, new, resources)


@query
def review_board(t):
    return approvals.review_board(t.members(), t.groups())


# --- rating and enrichment ------------------------------------------------------------------------------


@query
def risk_matrix(t):
    rating = F.element_at(F.array(*[F.lit(c) for c in ("Minor", "Moderate", "Major", "Unheard")]), (F.col("instance_count") % 4 + 1).cast("int"))
    rated = t.groups().select(*GROUP, "likelihood_rating", rating.alias("consequence_rating"))
    return rated.withColumn("risk_rating", risk_rating(F.col("likelihood_rating"), F.col("consequence_rating"), RULES.risk_matrix))


@query
def llm_context(t):
    return t.context().select(
        "run_id", "group_no", "group_name", "check_id", "check_title", "severity", "instance_count", "likelihood_rating",
        F.array_join("affected_account_names", ";").alias("affected_account_names"),
        F.array_join("categories", ";").alias("categories"),
    )


@query
def enrich_results(t):
    return t.enriched().select(
        "run_id", "group_no", "finding_title", "root_cause_narrative", "consequence_rating", "risk_rating",
        "enrichment_failed", "attempt", "enrichment_review",
    )


@query
def risk_distribution(t):
    return metrics.risk_distribution(t.enriched())


@query
def enrich_stats(t):
    return metrics.enrich_stats(t.enriched())


@query
def enrich_warnings(t):
    return enrich.enrich_warnings(t.enriched()).select("run_id", "code", "check_id", "finding_id", "message")


@query
def enrich_audit(t):
    return enrich.enrich_audit(t.enriched(), MODEL)


def _answers(t) -> DataFrame:
    """Answer texts of every shape and fault, one per check group."""
    n = F.col("group_order") % 8
    title = F.when(n == 1, F.repeat(F.lit("x"), F.lit(121))).otherwise(F.col("check_id"))
    flag = F.when(n == 2, '"true"').otherwise("true")
    rating = F.when(n == 3, "Critical").otherwise("Major")
    cause = F.when(n == 4, "").otherwise('"root_cause_narrative": "c", ')
    access = F.when(n == 5, "null").otherwise('"a"')
    body = F.concat(
        F.lit('{"finding_title": "'), title, F.lit('", '), cause, F.lit('"situation_narrative": "s", "consequence_narrative": "q", '),
        F.lit('"consequence_rating": "'), rating, F.lit('", "access_required": '), access, F.lit(', "needs_human_review": '), flag, F.lit("}"),
    )
    answer = (
        F.when(n == 6, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n == 7, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(body)
    )
    return t.groups().select(*GROUP, "group_order", answer.alias("answer"))


@query
def response_json(t):
    return _answers(t).select(*GROUP, responses.json_object(F.col("answer")).alias("body"))


@query
def enrich_validate(t):
    body = F.try_parse_json(responses.json_object(F.col("answer")))
    errors = responses.enrichment_errors(body)
    return _answers(t).select(*GROUP, F.array_join(errors, "; ").alias("errors"))


@query
def request_budget(t):
    sizes = t.chunked().groupBy("run_id", "chunk_no").agg(F.count(F.lit(1)).alias("items"))
    n = F.col("items")
    return sizes.select(
        "run_id", "chunk_no", "items", responses.chunk_tokens(n, 1000).alias("chunk_tokens"),
        responses.chunk_seconds(n, 60).alias("chunk_seconds"), responses.regroup_tokens(n * 7, 1000).alias("regroup_tokens"),
        responses.regroup_seconds(n * 7, 60).alias("regroup_seconds"),
    )


@query
def prompt_keys(t):
    asked = propose.chunk_requests(t.chunked()).withColumn("existing_names", F.array().cast("array<string>"))
    keyed = completion.with_keys(asked.withColumn("prompt", prompts.chunk_prompt()), MODEL)
    return keyed.select("run_id", "chunk_no", "items", "max_tokens", "timeout_seconds", "request_key")


@query
def cache_misses(t):
    asked = completion.with_keys(t.groups().select("run_id", "group_order", F.col("check_id").alias("prompt")), MODEL)
    stored = asked.filter(F.left(F.sha2("prompt", 256), F.lit(1)) < "6").select("request_key").distinct()
    return completion.cache_misses(asked.select("prompt", "request_key"), stored)


# --- report ------------------------------------------------------------------------------------------------


def _resource_lines(t) -> DataFrame:
    return report.resource_lines(t.approved(), t.groups(), t.working())


@query
def resource_lines(t):
    return _resource_lines(t)


@query
def resource_text(t):
    return report.resource_text(_resource_lines(t), 20)


@query
def resource_detail(t):
    return report.resource_detail(t.approved(), t.groups(), t.working())


@query
def recommendation_text(t):
    return report.recommendation_text(t.approved(), t.groups())


@query
def report_rows(t):
    return report.report_rows(t.enriched(), _resource_lines(t), report.recommendation_text(t.approved(), t.groups()), RULES)


@query
def report_meta(t):
    return report.report_meta(t.enriched(), RULES)


@query
def narrative_report(t):
    return report.narrative_report(t.enriched())


# --- audit, warnings, summaries --------------------------------------------------------------------------------


@query
def audit_events(t):
    rows = process.assign_section(t.processed())
    return audit.union_audit(audit.finding_audit(rows), audit.group_audit(t.groups()))


@query
def merge_audit(t):
    return grouping.merge_audit(t.merged(), t.groups(), t.members())


@query
def exclusion_reasons(t):
    return audit.latest_exclusion(audit.finding_audit(process.assign_section(t.processed())))


@query
def warnings_by_code(t):
    return metrics.warning_breakdown(t.warnings())


@query
def run_manifest(t):
    counts = metrics.run_counts(process.assign_section(t.processed()))
    m = report.run_manifest(counts, t.warnings(), RULES)
    listed = F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["stage"], w["code"], w["n"].cast("string"))), ";")
    return m.select(
        "run_id", "total_findings", "included", "excluded", "duplicates", "output_groups", "schema_version",
        "client_slug", F.array_join("config.include_statuses", ",").alias("include_statuses"), listed.alias("warnings"),
    )


@query
def ingest_summary(t):
    f = t.findings()
    return (
        report.tidy(metrics.status_breakdown(f), "status", "scanner_status", "findings")
        .unionByName(report.unpivot_counts(metrics.blank_breakdown(f), "blanks"))
        .unionByName(report.tidy(
            metrics.warning_breakdown(normalise.ingest_warnings(f)), "warnings", "code", "warnings"
        ))
    )


@query
def process_summary(t):
    counts = report.unpivot_counts(metrics.run_counts(process.assign_section(t.processed())), "counts")
    return counts.unionByName(report.unpivot_counts(metrics.likelihood_distribution(t.groups()), "likelihood"))


# --- sources ---------------------------------------------------------------------------------------------------------


def _export(t, rows: DataFrame | None = None, *more: str) -> DataFrame:
    """The raw findings as export columns, with the run and row to find them again in NOTES, and the columns ``more`` of the rows."""
    raw = (t.raw() if rows is None else rows).withColumn("raw_notes", F.concat_ws("#", "run_id", F.col("row_no").cast("string")))
    return raw.select(*[
        F.col(raw_name(c)).alias(c) for c in RESOURCE_COLUMNS if raw_name(c) in raw.columns
    ], *more)


def _by_part(t, base: DataFrame) -> DataFrame:
    """Raw findings with ``part``, 2,000 line items each, dealt out by it while they are narrow: grouped by it, no text is shuffled."""
    parts = base.withColumn("part", F.floor(F.col("row_no") / 2000)).repartition("part")
    return tables.findings_of(t.spark, t.sf_dir, parts, "part")


def _scanned(rows: DataFrame, *more: str) -> DataFrame:
    fields = [f for f in (*more, "raw_notes", "raw_provider", "raw_account_name", "raw_check_id", "raw_status", "raw_severity",
                          "raw_resource_uid", "raw_region", "raw_compliance", "raw_categories", "raw_resource_tags")]
    return rows.select(*[text.clean(F.col(f)).alias(f) for f in fields])


@query
def csv_scan(t):
    """Findings written as semicolon CSV with line breaks in quoted cells, read back by name."""
    path = t.scratch("csv")
    out = _export(t).withColumn("RISK", F.concat("RISK", F.lit('; "two"\nlines')))
    out.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    scan = delimited.read_findings_csv(t.spark, path, glob="*.csv")
    return _scanned(scan.rows, "raw_risk")


@query
def json_scan(t):
    """Findings written as JSON files of at most 2,000, in containers of every kind, read back by name."""
    path = t.scratch("json")
    rows = _export(t, _by_part(t, tables.findings_base(t.spark, t.sf_dir)), "part")
    item = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "part"]))
    listed = F.concat(F.lit("["), F.array_join(F.collect_list("item"), ",\n"), F.lit("]"))
    packed = rows.select("part", item.alias("item")).groupBy("part").agg(listed.alias("list"))
    held = (
        F.when(F.col("part") % 3 == 0, F.col("list")).when(F.col("part") % 3 == 1, F.concat(F.lit(' {"findings": '), "list", F.lit("}")))
        .otherwise(F.concat(F.lit('{"count": 1, "data": '), "list", F.lit("} \n")))
    )
    packed.select("part", held.alias("value")).write.partitionBy("part").text(path)  # one file for each part
    return _scanned(json_files.read_findings_json(t.spark, path, glob="*.txt").rows)


@query
def nested_flatten(t):
    """Findings nested as OCSF JSON text, flattened to export columns."""
    c = F.col
    uid = F.concat(F.lit("prowler-aws-"), c("raw_check_id"), F.lit("-"), F.lpad(c("raw_account_uid"), 12, "0"), F.lit("-eu-"), c("row_no").cast("string"))
    doc = F.to_json(F.struct(
        F.when(c("raw_muted") == "True", "Suppressed").otherwise("New").alias("status"),
        c("raw_status").alias("status_code"), F.upper("raw_severity").alias("severity"), c("raw_risk").alias("risk_details"),
        F.struct(uid.alias("uid"), c("raw_check_title").alias("title"), c("raw_description").alias("desc")).alias("finding_info"),
        F.struct(c("raw_provider").alias("provider"), F.lit("cloud-1").alias("region"),
                 F.struct(c("raw_account_uid").alias("uid"), c("raw_account_name").alias("name"),
                          F.array(F.lit("a:1"), F.lit(""), F.lit("b:2")).alias("labels")).alias("account")).alias("cloud"),
        F.array(F.struct(c("raw_resource_uid").alias("uid"), c("raw_resource_name").alias("name"), c("raw_region").alias("region"),
                         F.struct(c("raw_service_name").alias("name")).alias("group"))).alias("resources"),
        F.struct(F.array(F.lit(""), F.concat(F.lit("u/"), c("raw_check_id"))).alias("references")).alias("remediation"),
        F.struct(F.split("raw_categories", " [|] ").alias("categories"),
                 F.create_map(F.lit("CIS"), F.array(F.lit("1.1"), c("raw_check_type")), F.lit("ENS"), F.array(F.lit("op"))).alias("compliance")).alias("unmapped"),
    ))
    n = t.raw().select("run_id", "row_no", F.from_json(doc, NESTED_FINDING).alias("n"))
    flat = nested.flatten(F.col("n"))
    wanted = ["ACCOUNT_UID", "ACCOUNT_NAME", "ACCOUNT_TAGS", "PROVIDER", "CHECK_ID", "CHECK_TITLE", "STATUS", "MUTED", "SEVERITY",
              "SERVICE_NAME", "RESOURCE_UID", "REGION", "DESCRIPTION", "REMEDIATION_RECOMMENDATION_URL", "COMPLIANCE", "CATEGORIES"]
    return n.select("run_id", "row_no", *[flat[w].alias(w.lower()) for w in wanted])


@query
def file_fingerprints(t):
    """SHA-256 of page bytes, as for export files."""
    return t.table("pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("fingerprint"))


# --- control findings ---------------------------------------------------------------------------------------------------


@query
def html_strip(t):
    return t.table("pages").select("page_id", text.strip_html(F.col("html")).alias("content"))


@query
def instance_count_extract(t):
    return t.raw_controls().select("run_id", "row_no", text.instance_count(cf.clean_control(F.col("raw_details"))).alias("instance_count"))


@query
def control_rows(t):
    return t.controls().select(
        "run_id", "row_no", "tenant_id", "control_id", "check_title", "scanner_status", "severity", "likelihood_rating",
        "service_prefix", "service_name", "output_section", "ref_prefix", "instance_count", "completeness_score",
        "stable_key", "dedup_key", "raw_details", "raw_original_result", "human_review_required",
    )


@query
def service_resolve(t):
    s = cf.resolve_service(cf.clean_control(F.col("raw_control_id")), RULES.control_services)
    return t.raw_controls().select("run_id", "row_no", s.alias("s")).select("run_id", "row_no", "s.*")


@query
def control_severity(t):
    return t.controls().groupBy("criticality_raw", "severity", "likelihood_rating").agg(F.count(F.lit(1)).alias("n"))


@query
def tenant_warnings(t):
    return controls.tenant_warnings(t.controls()).select("run_id", "code")


@query
def control_filter(t):
    return controls.control_filter(t.controls(), RULES).select("run_id", "row_no", "report_inclusion", "exclusion_reason")


@query
def control_dedup(t):
    return t.processed_controls().select("run_id", "row_no", "is_duplicate", "duplicate_of", "report_inclusion")


@query
def control_counts(t):
    return controls.control_run_counts(t.processed_controls())


@query
def control_refs(t):
    return t.control_groups().select(
        "run_id", "group_order", "member_key", "output_section", "severity", "ref_number", "ref_label", "instance_count"
    )


@query
def control_chunks(t):
    return grouping.assign_chunks(t.control_groups(), grouping.control_chunk_order() + [F.col("tenant_id")]).select(
        "run_id", "member_key", "chunk_no", "chunk_pos", "chunk_count"
    )


@query
def control_merged(t):
    return grouping.order_merged_controls(t.merged_controls()).select(
        "run_id", "group_no", "group_order", "group_name", "output_section", "severity", "likelihood_rating",
        "instance_count", "member_count", "is_merged", "first_ref_prefix",
    )


@query
def control_resources(t):
    return grouping.affected_controls(t.control_members(), t.control_groups())


@query
def control_audit(t):
    return controls.control_audit(t.processed_controls())


@query
def control_report(t):
    """Control report with narratives of the offline completion function."""
    context = enrich.control_context(t.merged_controls(), t.control_groups())
    done = materialise(enrich.enrich_groups(context, offline.describe, MODEL, RULES, control=True), "control-enriched")
    return report.control_report_rows(done)


# --- outputs of whole runs -----------------------------------------------------------------------------------------------


@query
def ingest_report(t):
    return summaries.ingest_report(t.findings())


@query
def process_report(t):
    return summaries.process_report(t.processed(), t.groups())


@query
def audit_trail(t):
    """Events of all steps in one table, in the order of each finding's history; two steps are written twice."""
    path = t.scratch("audit")
    rows = process.assign_section(t.processed())
    note = F.when(F.col("group_no") % 5 == 0, F.concat(F.lit("Ask the owner of "), "group_name")).otherwise("")
    noted = grouping.merge_groups(t.approved().withColumn("analyst_note", note), t.groups())
    runs = t.groups().select("run_id")
    sinks.write_events(audit.finding_audit(rows), path, "findings")
    sinks.write_events(audit.group_audit(t.groups()), path, "groups", runs)
    sinks.write_events(enrich.enrich_audit(t.enriched(), "an earlier model"), path, "enrichment", runs)
    for _ in range(2):
        sinks.write_events(grouping.merge_audit(noted, t.groups(), t.approved(), approved=True), path, "review", runs)
    sinks.write_events(grouping.merge_audit(t.merged(), t.groups(), t.members()), path, "grouping", runs)
    sinks.write_events(enrich.enrich_audit(t.enriched(), MODEL), path, "enrichment", runs)
    return sinks.read_events(t.spark, path)


@query
def control_run_summary(t):
    """Counters of every stage of control runs, and their observed totals as rows without run."""
    log = summaries.StageLog()
    one = F.count(F.lit(1))
    processed = log.write(
        t.processed_controls(), "process", findings=one, included=F.count_if(F.expr("was_included AND NOT is_duplicate")),
        excluded=F.count_if(F.expr("NOT was_included")), duplicates=F.count_if(F.expr("was_included AND is_duplicate")),
    )
    groups = log.write(controls.control_groups(processed), "groups", groups=one)
    t._kept["control_groups"] = groups
    merged = log.write(t.merged_controls(), "grouping", groups_proposed=one, merges_applied=F.count_if(F.expr("is_merged")))
    chunks = grouping.assign_chunks(groups, grouping.control_chunk_order() + [F.col("tenant_id")])
    done = log.write(
        enrich.enrich_groups(enrich.control_context(merged, groups), offline.describe, MODEL, RULES, control=True), "enrich",
        enriched=F.count_if(F.expr("NOT enrichment_failed")), failed=F.count_if(F.expr("enrichment_failed")),
    )
    rows = log.write(report.control_report_rows(done), "render", groups_written=F.count_if(F.expr("kind = 'finding'")))
    members = t.control_members()
    faults = grouping.partition_check(groups, members, ["run_id"])
    per_run = summaries.control_run_summary(processed, groups, chunks, merged, faults, members, done, rows)
    return per_run.unionByName(log.rows(per_run))


@query
def enriched_groups(t):
    """Enriched groups with pages of 50 resources and accounts."""
    detail = report.resource_detail(t.approved(), t.groups(), t.working())
    pages = exports.group_pages(detail, t.accounts(), 50)
    found = exports.enriched_groups(t.enriched(), report.recommendation_text(t.approved(), t.groups()), pages)
    shown = F.transform("affected_resources", lambda r: F.concat_ws("|", *[r[c] for c in exports._DETAIL]))
    return found.select(
        "run_id", "group_no", "page_no", "pages", "group_name", F.array_join("check_ids", ",").alias("check_ids"), "output_section",
        "instance_count", "likelihood_rating", "risk_rating", "consequence_rating", "finding_title", "root_cause_narrative",
        "situation_narrative", "consequence_narrative", "access_required", "recommendations", "ai_enriched", "llm_failed",
        "human_review_required", F.size("affected_resources").alias("resources"),
        F.md5(F.array_join(shown, "\n").cast("binary")).alias("resources_md5"), F.array_join("affected_accounts", ";").alias("accounts"),
    )


def _proposal(t, members: DataFrame) -> DataFrame:
    merged = grouping.merge_groups(members, t.groups())
    accounts = grouping.merged_accounts(members, t.groups(), process.group_accounts(t.working()))
    return exports.grouping_proposal(members, t.groups(), merged, accounts, t.chunked())


@query
def grouping_proposal(t):
    """Proposals of all runs, then new ones for two runs, by the first word of the check ids; the last one of each run."""
    from pyspark.sql import Window

    path = t.scratch("proposals")
    sinks.append_version(_proposal(t, t.members()), path)
    word = F.substring_index("member_key", "_", 1)
    by_name = Window.partitionBy("run_id").orderBy("group_name")
    inside = Window.partitionBy("run_id", "group_name").orderBy("member_key")
    again = t.groups().filter("run_id IN ('ASIA', 'EUROPE')").select("run_id", word.alias("group_name"), "member_key").select(
        "run_id", F.dense_rank().over(by_name).alias("group_no"), "group_name", F.lit("Same word").alias("rationale"),
        F.row_number().over(inside).alias("pos"), "member_key",
    )
    rows = _proposal(t, again)
    sinks.append_version(rows, path)
    last = sinks.latest_version(t.spark, path, rows.schema)
    return last.withColumns({
        "check_ids": F.array_join("check_ids", ","), "affected_resources": F.md5(F.array_join("affected_resources", "\n").cast("binary")),
    })


@query
def approval_versions(t):
    """Approvals of all runs, a second version for two of them by a second writer; the last one of each run, as members."""
    path = t.scratch("approvals")
    first = sinks.approvals_json(t.approved())
    sinks.append_version(first, path)
    second = t.approved().filter("run_id IN ('AMERICA', 'ASIA') AND group_no % 2 = 1").withColumn("rationale", F.lit("second thoughts"))
    sinks.append_version(sinks.approvals_json(second), path)
    last = sinks.latest_version(t.spark, path, first.schema)
    return json_files.approved_members(last).select(
        "run_id", "version", "group_no", "group_name", "rationale", "risk_rating_override", "pos", "member_key"
    )


@query
def review_cards(t):
    """Cards of the review board with their checks and resources."""
    accounts = grouping.merged_accounts(t.members(), t.groups(), process.group_accounts(t.working()))
    shown = F.transform("affected_resources", lambda r: F.concat_ws("|", *[r[c] for c in (
        "resource", "resource_name", "resource_type", "account_name", "account_uid", "region", "check_id")]))
    return exports.review_board(t.members(), t.groups(), t.merged(), accounts).select(
        "run_id", "id", "group_name", "rationale", "is_merged", "instance_count", "severity", "likelihood", "accounts",
        F.array_join("checks", ",").alias("checks"), F.md5(F.array_join(F.coalesce(shown, F.array().cast("array<string>")), "\n").cast("binary")).alias("resources_md5"),
    )


@query
def review_lookup(t):
    """Facts of the members of a board, taken from the map of checks of their run."""
    return exports.member_facts(t.members(), exports.check_lookup(t.groups())).withColumn("categories", F.array_join("categories", ";"))


@query
def rule_versions(t):
    """Likelihoods by the rules that hold for each run: two versions for all clients, one of a client's own; and faulty rule rows."""
    import datetime

    day = datetime.date
    base = rules.rule_table(t.spark, RULES)
    version = lambda client, since, df: df.select(F.lit(client).alias("client"), F.lit(since).alias("valid_from"), "*")
    strict = base.withColumn("rule_value", F.when((F.col("rule") == "severity") & (F.col("rule_key") == "low"), "High").otherwise(F.col("rule_value")))
    plain = base.filter("rule <> 'high_if_category'")
    versions = version("*", day(2020, 1, 1), base).unionByName(version("*", day(2025, 1, 1), strict)).unionByName(version("client-ASIA", day(2024, 1, 1), plain))
    runs = t.groups().select("run_id").distinct().select(
        "run_id", F.concat(F.lit("client-"), "run_id").alias("client"),
        F.when(F.col("run_id") < "B", F.lit(day(2024, 6, 1))).otherwise(F.lit(day(2026, 1, 1))).alias("run_date"),
    )
    rated = rule_sets.likelihood_by_rules(t.groups(), rule_sets.rules_of_runs(runs, versions))
    wrong = version("*", day(2025, 1, 1), base.withColumn("rule_key", F.when(F.col("rule") == "risk_matrix", F.lower("rule_key")).otherwise(F.col("rule_key"))))
    faulty = rule_sets.invalid_rules(versions.unionByName(wrong))
    return rated.select("run_id", F.col("output_group_key").alias("item"), F.col("likelihood_by_rules").alias("value")).unionByName(
        faulty.select(F.col("client").alias("run_id"), F.concat_ws("=", "rule", "rule_key").alias("item"), F.lit("invalid").alias("value"))
    )


def _faulty_answers(t) -> DataFrame:
    """Grouping answers with every kind of fault, one for each chunk, made of its own checks."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct("chunk_pos", "member_key"))), lambda s: s["member_key"])
    chunks = t.chunked().groupBy("run_id", "chunk_no").agg(keys.alias("ids"))
    n, ids = F.col("chunk_no") % 7, F.col("ids")
    group = lambda name, ids, why: F.struct(name.alias("group_name"), ids.alias("check_ids"), why.alias("rationale"))
    all_of, none = group(F.lit("all"), ids, F.lit("One fix.")), F.lit(None).cast("string")
    first = F.slice(ids, 1, 1)
    items = (
        F.when(n == 0, F.array(all_of))
        .when(n == 1, F.array(group(F.lit("rest"), F.slice(ids, 2, 100), F.lit("One fix."))))
        .when(n == 2, F.array(all_of, group(F.lit("again"), F.concat(first, first), F.lit("Twice."))))
        .when(n == 3, F.array(group(F.lit("all"), F.concat(ids, F.array(F.lit("ghost_b"), F.lit("ghost_a"))), F.lit(""))))
        .when(n == 4, F.array(group(F.lit(""), ids, none), group(F.lit("empty"), F.array().cast("array<string>"), F.lit("None."))))
        .when(n == 5, F.array().cast("array<struct<group_name:string,check_ids:array<string>,rationale:string>>"))
    )
    return chunks.select("run_id", "chunk_no", items.alias("items"))


@query
def answer_faults(t):
    """Errors of grouping answers of every kind, by joins."""
    found = grouping.answer_faults(t.chunked().select("run_id", "chunk_no", "member_key"), _faulty_answers(t), SCOPE)
    return grouping.fault_texts(found, SCOPE)


# --- files of every layout -----------------------------------------------------------------------------------------------


_SEPARATORS = {"AFRICA": ",", "AMERICA": "|", "ASIA": "\t", "EUROPE": ";"}


def _layouts(t) -> str:
    """Findings of each run written in a layout of its own: every delimiter, Latin-1, JSON without a suffix; and a file of other columns.

    A title holds quotes after all delimiters.
    """
    path = t.scratch("layouts")
    title = F.concat(F.lit('a|"b;"c,"d '), F.coalesce("CHECK_TITLE", F.lit("none")), F.lit(" é"))
    run_id = F.col("run_id")
    for run, sep in _SEPARATORS.items():
        encoding = "ISO-8859-1" if run == "AMERICA" else "UTF-8"
        rows = _export(t, t.stored().filter(run_id == run)).withColumn("CHECK_TITLE", title)
        rows.write.option("header", True).option("sep", sep).option("escape", '"').option("encoding", encoding).csv(f"{path}/{run}")
    others = _by_part(t, t.base().drop("key")).filter(~run_id.isin(*_SEPARATORS))
    rows = _export(t, others, "part").withColumn("CHECK_TITLE", title)
    item = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "part"]))
    lists = rows.select("part", item.alias("item")).groupBy("part").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("item"), ",\n"), F.lit("]")).alias("value")
    )
    lists.drop("part").write.option("maxRecordsPerFile", 1).text(f"{path}/json")
    t.table("region").write.option("header", True).csv(f"{path}/other")
    return path


@query
def mixed_scan(t):
    """Rows of files of every layout, CSV and JSON, read in one go; the format is found from name or text."""
    return _scanned(json_files.read_findings(t.spark, _layouts(t) + "/*").rows, "raw_check_title")


@query
def file_report(t):
    """Warnings and rejections of such files, once for each layout."""
    scan = json_files.read_findings(t.spark, _layouts(t) + "/*")
    rejected = scan.rejected.select(F.regexp_extract("source_file", "/layouts-[0-9a-f]+/([^/]+)/", 1).alias("layout"), F.col("reason").alias("code"))
    return scan.warnings.select(F.lit("").alias("layout"), "code").unionByName(rejected).distinct()


@query
def scan_fingerprints(t):
    """Rows of written files that carry the SHA-256 of their file's bytes, by run."""
    path = _layouts(t) + "/*"
    prints = files.fingerprints(t.spark, path)  # every byte passes once for them
    rows = json_files.read_findings(t.spark, path, prints=prints).rows
    return rows.join(prints.select("source_file_hash").distinct(), "source_file_hash", "left_semi").groupBy(F.substring_index("raw_notes", "#", 1).alias("run_id")).agg(F.count(F.lit(1)).alias("rows"))


@query
def control_scan(t):
    """Controls written as CSV with a comment column and blank rows, read back by name; and why other files are rejected."""
    path = t.scratch("controls")
    cells = ["raw_control_id", "raw_requirement", "raw_result", "raw_criticality", "raw_details", "raw_original_result"]
    names = dict(zip(cells, (*schemas.CONTROL_REQUIRED, "OriginalResult")))
    rows = t.raw_controls().select(
        *[F.col(c).alias(n) for c, n in names.items()], F.concat_ws("#", "run_id", F.col("row_no").cast("string")).alias("Row"), F.lit("N/A").alias("Comments"),
    )
    blank = rows.filter("Row LIKE '%7'").select(*[F.lit(None).cast("string").alias(c) for c in rows.columns])
    rows.unionByName(blank).write.option("header", True).option("escape", '"').csv(path)
    t.table("nation").write.option("header", True).mode("append").csv(path)
    scan = delimited.read_controls_csv(t.spark, path, glob="*.csv", tenant_id="t")
    out = scan.rows.select(F.col("extra_fields")["Row"].alias("row"), "tenant_id", *[cf.clean_control(F.col(c)).alias(c) for c in (*cells, "raw_comments")])
    reasons = scan.rejected.select("reason").distinct()
    return out.unionByName(reasons.select(F.col("reason").alias("row"), *[F.lit(None).cast("string").alias(c) for c in out.columns[1:]]))


@query
def approval_files(t):
    """Approvals written as one JSON file per run, read back; a run whose first group has no name is rejected."""
    path = t.scratch("approval-files")
    named = t.approved().withColumn("group_name", F.when((F.col("run_id") == "ASIA") & (F.col("group_no") == 1), "").otherwise(F.col("group_name")))
    sinks.approvals_json(named).withColumn("run", F.col("run_id")).select("run", "payload").write.partitionBy("run").text(path)
    scan = json_files.read_approvals(t.spark, path)
    rows = scan.rows.select("run_id", "group_no", "group_name", "rationale", "risk_rating_override", "pos", "member_key")
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("rationale", "risk_rating_override", "pos", "member_key")]
    return rows.unionByName(scan.rejected.select("run_id", F.lit(0).alias("group_no"), F.col("reason").alias("group_name"), *none))


# --- review of controls ----------------------------------------------------------------------------------------------------


def _approved_controls(t) -> DataFrame:
    """Approved control groups with rationales, notes, overrides of every kind, and an unknown id in every third group."""
    no = F.col("group_no")
    ghost = t.control_members().filter((F.col("pos") == 1) & (no % 3 == 0)).withColumns({
        "pos": F.lit(0), "member_key": F.concat(F.lit("ghost_"), no.cast("string")),
    })
    return t.control_members().unionByName(ghost).withColumns({
        "rationale": F.when(no % 2 == 0, "Fix together").otherwise(""),
        "analyst_note": F.when(no % 3 == 0, F.concat(F.lit("Note "), no.cast("string"))).otherwise(""),
        "risk_rating_override": F.element_at(F.array(*[F.lit(v) for v in ("", " Low", "Critical", "High")]), (no % 4 + 1).cast("int")),
    })


@query
def control_review(t):
    """Control groups after review: only High, Medium and Low override; a note stands in for a missing rationale."""
    return approvals.review_controls(_approved_controls(t), t.control_groups()).select(
        "run_id", "group_no", "group_name", "rationale", "output_section", "severity", "likelihood_rating", "instance_count",
        "member_count", "is_merged", "risk_override",
    )


@query
def control_review_audit(t):
    """What review changed on the representatives of control groups, and the warnings about unknown ids."""
    members = _approved_controls(t)
    reviewed = approvals.review_controls(members, t.control_groups())
    events = grouping.merge_audit(reviewed, t.control_groups(), members, approved=True).unionByName(approvals.override_audit(reviewed))
    unknown = approvals.approval_warnings(members, t.control_groups())
    names = [f.name for f in schemas.AUDIT.fields]
    as_event = {"finding_instance_id": F.lit(""), "stage_no": F.lit(3), "seq": F.lit(9), "field": F.col("code"), "old_value": F.col("check_id"),
                "new_value": F.lit(None).cast("string"), "reason": F.col("message"), "actor": F.lit("pipeline")}
    return events.select(*names).unionByName(unknown.select(*[as_event.get(n, F.col(n)).alias(n) for n in names]))


@query
def control_defaults(t):
    """What a control row always has: provider, region, no comment, and the service fields of its id."""
    return t.controls().select("run_id", "row_no", "provider", "region", "raw_comments", "criticality_raw", "service_prefix", "ref_prefix")


@query
def control_validate(t):
    """Errors of control answers, which have recommendations as an eighth field, one answer for each group."""
    n = F.col("group_order") % 6
    fixes = F.when(n == 1, "").when(n == 2, ', "recommendations": null').otherwise(', "recommendations": "f"')
    rating = F.when(n == 3, "major").otherwise("Major")
    flag = F.when(n == 4, "1").otherwise("true")
    body = F.concat(
        F.lit('{"finding_title": "'), F.col("check_id"), F.lit('", "root_cause_narrative": "c", "situation_narrative": "s", "consequence_narrative": "q", '
        '"access_required": "a", "consequence_rating": "'), rating, F.lit('", "needs_human_review": '), flag, fixes, F.lit("}"),
    )
    answer = F.when(n == 5, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.concat(F.lit("So: "), body))
    errors = responses.enrichment_errors(F.try_parse_json(responses.json_object(answer)), True)
    return t.control_groups().select("run_id", "group_order", F.array_join(errors, "; ").alias("errors"))


def _board_answer(prompt: str, max_tokens: int, timeout_seconds: int) -> str:
    """Offline answer to a board instruction: mark all groups, split one, or lose a check."""
    import json
    import re

    groups = [(name, ids.split(", ")) for name, ids in re.findall(r'^"(.*?)": (.*)$', prompt, re.M)]
    loose = re.findall(r"^Unassigned: (.*)$", prompt, re.M)
    target = re.search(r'^The instruction is about this group only: "(.*?)": ', prompt, re.M)
    if "\nInstruction: lose" in prompt:
        out = [("all", [i for _, ids in groups for i in ids][1:])]
    elif target:
        out = [g for g in groups if g[0] != target[1]] + [(i, [i]) for name, ids in groups if name == target[1] for i in ids]
    else:
        out = [(f"{name}!", ids) for name, ids in groups] + [("Loose", ids.split(", ")) for ids in loose]
    return json.dumps([{"group_name": n, "check_ids": ids} for n, ids in out])


@query
def regroup_members(t):
    """Members after a board-wide instruction with unassigned checks, one about a single group, and one that fails twice."""
    loose = (F.col("group_no") % 3 == 0) & (F.col("pos") > 1)
    held, pool = t.members().filter(~loose), t.members().filter(loose).select("run_id", "member_key")
    first = held.filter("group_no = 1 AND pos = 1").select("run_id", "group_name")
    ask = F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(text).alias("instruction")) for k, text in ((1, "mark"), (2, "split"), (3, "lose"))]))
    asks = first.select("run_id", "group_name", ask.alias("a")).select(
        "run_id", "a.seq", "a.instruction", F.when(F.col("a.seq") == 2, F.col("group_name")).alias("target_group")
    )
    found = propose.regroup(asks, held, pool, _board_answer, MODEL)
    groups = found.select("run_id", "seq", "ok", "error", F.explode_outer("groups").alias("g"))
    return groups.select("run_id", "seq", "ok", "error", F.col("g.group_name").alias("group_name"), F.explode_outer("g.check_ids").alias("member_key"))
