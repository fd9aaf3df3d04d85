"""Narratives for merged groups: request, check, one retry, placeholders, risk."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import prompts, responses
from sightline.functions.text import text_or
from sightline.operators.completion import Complete, complete_requests
from sightline.rules import Rules, risk_rating
from sightline.session import materialise

BASE_TOKENS, BASE_SECONDS = 1500, 60


def resource_context(merged: DataFrame, groups: DataFrame, accounts: DataFrame) -> DataFrame:
    """The facts a request carries for a resource group: its representative plus group totals."""
    rep = groups.select(
        "run_id", F.col("finding_instance_id").alias("_rep"),
        F.col("check_id"), F.col("raw_check_title").alias("check_title"), F.col("raw_check_type").alias("check_type"),
        F.col("raw_severity").alias("severity"), F.col("scanner_status").alias("status"),
        F.col("raw_status_extended").alias("status_extended"), F.col("raw_description").alias("description"),
        F.col("raw_risk").alias("risk"),
        *[
            F.col(f"raw_{c}").alias(c)
            for c in (
                "remediation_recommendation_text", "remediation_recommendation_url", "remediation_code_cli",
                "remediation_code_terraform", "remediation_code_nativeiac", "service_name", "subservice_name",
                "resource_type", "resource_uid", "resource_name", "account_name",
            )
        ],
        F.col("region_normalised").alias("region"), F.col("categories_list").alias("categories"),
        F.col("compliance_values").alias("compliance"), F.col("resource_tags_parsed").alias("resource_tags"),
    )
    names = accounts.groupBy("run_id", "group_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "account"))), lambda s: s["account"]).alias(
            "affected_account_names"
        )
    )
    return _with_rep(merged, rep).join(names, ["run_id", "group_no"], "left").withColumn(
        "affected_account_names", F.coalesce("affected_account_names", F.array().cast("array<string>"))
    )


def control_context(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """The facts a request carries for a control group."""
    rep = groups.select(
        "run_id", F.col("finding_instance_id").alias("_rep"), "check_id", "check_title", "severity",
        "criticality_raw", F.col("scanner_status").alias("status"), F.col("check_title").alias("description"),
        F.coalesce("raw_details", F.lit("")).alias("status_extended"), "service_name",
        F.col("region"), F.col("tenant_id").alias("account_name"), "ref_prefix",
        F.col("raw_omitted_result").alias("omitted_result"), F.col("raw_incorrect_result").alias("incorrect_result"),
        F.col("raw_original_result").alias("original_result"),
    )
    return _with_rep(merged, rep)


def _with_rep(merged: DataFrame, rep: DataFrame) -> DataFrame:
    group = merged.withColumnRenamed("severity", "group_severity").withColumn(
        "_rep", F.col("representative.finding_instance_id")
    )
    return group.join(rep, ["run_id", "_rep"]).drop("_rep")


def context_json(context: DataFrame) -> DataFrame:
    """The context of each group as one JSON text."""
    facts = [c for c in context.columns if c not in ("run_id", "group_no", "representative", "check_ids")]
    return context.select("run_id", "group_no", F.to_json(F.struct(*facts)).alias("context"))


def enrich_groups(
    context: DataFrame,
    complete: Complete,
    model: str,
    rules: Rules = Rules(),
    control: bool = False,
    cache_path: str | None = None,
) -> DataFrame:
    """Narratives and risk of every group; a group that fails twice gets placeholders.

    All groups of all runs are asked in one pass; only those with a faulty
    answer are asked again in a second.
    """
    fields = responses.enrichment_fields(control)
    text = prompts.control_prompt(fields) if control else prompts.finding_prompt(fields)
    budget = {"max_tokens": F.lit(BASE_TOKENS), "timeout_seconds": F.lit(BASE_SECONDS)}
    first = check_answers(
        complete_requests(context.withColumn("prompt", text).withColumns(budget), complete, model, cache_path), control
    )
    first = materialise(first.withColumn("attempt", F.lit(1)), "enrich-first")
    faulty = first.filter(F.size("errors") > 0)
    if faulty.isEmpty():
        return rate(results(first, control), rules, control)
    again = faulty.withColumn(
        "prompt", prompts.correction_prompt(F.col("prompt"), F.col("errors"), F.col("response"))
    ).drop("request_key", "response", "error", "errors", "body")
    second = check_answers(complete_requests(again, complete, model, cache_path), control).withColumn(
        "attempt", F.lit(2)
    )
    both = first.filter(F.size("errors") == 0).unionByName(second)
    return rate(results(both, control), rules, control)


def check_answers(answered: DataFrame, control: bool = False) -> DataFrame:
    """Add ``body`` (JSON text of the answer) and ``errors``."""
    body = responses.json_object(F.col("response"))
    checked = answered.withColumn("body", body).withColumn(
        "errors", responses.enrichment_errors(F.try_parse_json("body"), control)
    )
    return checked.withColumn(
        "errors", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.col("errors"))
    )


def placeholder(field: str) -> str:
    return f"[REQUIRES_HUMAN_INPUT: {field}]"


def results(checked: DataFrame, control: bool = False) -> DataFrame:
    """Narrative columns from valid answers, placeholders for the rest."""
    failed = F.size("errors") > 0
    subject = "control" if control else "check"
    value = lambda f: F.get_json_object("body", f"$.{f}")
    out = {
        "finding_title": F.when(
            failed, F.concat(F.lit("[REQUIRES_HUMAN_INPUT] "), text_or(F.col("check_title"), f"Unknown {subject}"))
        ).otherwise(F.left(value("finding_title"), F.lit(responses.TITLE_LIMIT))),
        "consequence_rating": F.when(failed, "Moderate").otherwise(value("consequence_rating")),
        "enrichment_failed": failed,
    }
    plain = [f for f in responses.NARRATIVES if f != "finding_title"] + ["recommendations"] * control
    for f in plain:
        out[f] = F.when(failed, placeholder(f)).otherwise(value(f))
    reason = F.concat(
        F.lit("Enrichment failed after "), F.col("attempt").cast("string"), F.lit(" attempt(s): "),
        F.array_join("errors", "; "),
    )
    out["failure_reason"] = F.when(failed, reason)
    out["enrichment_review"] = F.when(failed, F.concat(F.lit("Placeholders written. "), reason)).when(
        value("needs_human_review") == "true", "Uncertainty flagged on one or more fields"
    )
    return checked.withColumns(out).drop("prompt", "max_tokens", "timeout_seconds", "request_key", "response", "error", "errors", "body")


def rate(enriched: DataFrame, rules: Rules = Rules(), control: bool = False) -> DataFrame:
    """Risk of each group: the analyst's override, else the matrix; none after a failure."""
    likelihood = text_or(F.col("likelihood_rating"), "High" if control else "Medium")
    matrix = risk_rating(likelihood, F.col("consequence_rating"), rules.risk_matrix)
    override = F.col("risk_override") if "risk_override" in enriched.columns else F.lit(None).cast("string")
    return enriched.withColumns({
        "matrix_risk": matrix,
        "risk_rating": F.when(F.col("enrichment_failed"), override).otherwise(F.coalesce(override, matrix)),
    })


def enrich_audit(enriched: DataFrame, model: str) -> DataFrame:
    """Audit rows of enrichment, on each representative."""
    null = F.lit(None).cast("string")
    ok, risk = ~F.col("enrichment_failed"), F.col("risk_rating")
    overridden = F.col("risk_override").isNotNull() if "risk_override" in enriched.columns else F.lit(False)
    event = lambda when, seq, field, old, new, reason, actor: F.when(when, F.struct(
        F.lit(seq).alias("seq"), F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value"),
        reason.alias("reason"), F.lit(actor).alias("actor"),
    ))
    events = F.array_compact(F.array(
        event(~ok, 0, "llm_enrichment_failed", F.lit("false"), F.lit("true"), F.col("failure_reason"), "pipeline"),
        event(F.col("enrichment_review").isNotNull(), 1, "human_review_required", F.lit("false"), F.lit("true"),
              F.col("enrichment_review"), "pipeline"),
        event(ok, 2, "ai_enriched", F.lit("false"), F.lit("true"), F.concat(
            F.lit("Enrichment completed (attempt "), F.col("attempt").cast("string"), F.lit(f"). Model: {model}."),
        ), "llm"),
        event(ok, 3, "consequence_rating", null, F.col("consequence_rating"),
              F.concat(F.lit("Assessed: "), "consequence_rating"), "llm"),
        event(ok & overridden, 4, "risk_rating", F.lit("analyst_override"), risk, F.concat(
            F.lit("Analyst override kept; matrix gives '"), "matrix_risk", F.lit("'")), "pipeline"),
        event(ok & ~overridden, 4, "risk_rating", null, risk, F.concat(
            F.lit("risk_matrix['"), "likelihood_rating", F.lit("_"), "consequence_rating", F.lit("'] = '"), risk,
            F.lit("'")), "pipeline"),
    ))
    return enriched.select(
        "run_id", F.col("representative.finding_instance_id").alias("finding_instance_id"),
        F.lit(4).alias("stage_no"), F.lit("enrichment").alias("stage"), F.explode(events).alias("e"),
    ).select("run_id", "finding_instance_id", "stage_no", "e.seq", "stage", "e.field", "e.old_value", "e.new_value", "e.reason", "e.actor")


def enrich_warnings(enriched: DataFrame) -> DataFrame:
    return enriched.filter("enrichment_failed").select(
        "run_id", F.lit("enrichment").alias("stage"), F.lit("LLM_ENRICHMENT_FAILED").alias("code"),
        F.concat(F.lit("["), "group_name", F.lit("] "), "failure_reason").alias("message"),
        F.lit(None).cast("long").alias("row_no"), F.col("group_name").alias("check_id"),
        F.col("representative.finding_instance_id").alias("finding_id"),
    )
