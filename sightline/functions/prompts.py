"""Texts of completion requests, one column per kind.

The wording is a parameter of the system, not of its results: what matters is
which facts a request carries and that the text of a request depends only on
its own rows, because the text is the cache key.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import text_or

UNKNOWN = "(not given)"
CHUNK_HEAD = "Group security checks that one report entry can cover. This is chunk "
CHUNK_RULES = (
    "\n\nMerge checks only when service, root cause and fix are the same; when in doubt keep them apart. "
    "Every check id appears in exactly one group. Give each group a specific name and a rationale."
)
ARRAY_ONLY = (
    "\n\nAnswer with a JSON array only: "
    '[{"group_name": "...", "check_ids": ["..."], "rationale": "..."}]'
)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value, F.lit("\n"))


def _or_unknown(c) -> Column:
    return text_or(F.col(c) if isinstance(c, str) else c, UNKNOWN)


def scope_sentence(count: Column, accounts: Column, resource: Column, account: Column, region: Column) -> Column:
    """How far a finding reaches."""
    some = lambda c: c.isNotNull() & (c != "")
    single = F.concat(
        F.lit("One resource"),
        F.when(some(resource), F.concat(F.lit(" ("), resource, F.lit(")"))).otherwise(""),
        F.when(some(account), F.concat(F.lit(" in account '"), account, F.lit("'"))).otherwise(""),
        F.when(some(region) & (region != "global"), F.concat(F.lit(" in region "), region)).otherwise(""),
        F.lit("."),
    )
    many = F.concat(F.lit("Affects "), count.cast("string"), F.lit(" resources"))
    across = F.concat(
        many, F.lit(" across "), F.size(accounts).cast("string"), F.lit(" account(s): "),
        F.array_join(accounts, ", "), F.lit("."),
    )
    return (
        F.when((count > 1) & (F.size(accounts) > 0), across)
        .when(count > 1, F.concat(many, F.lit(".")))
        .otherwise(single)
    )


def _answer_format(fields: list[str]) -> Column:
    shape = ", ".join(f'"{f}": ' + ("false" if f == "needs_human_review" else '"..."') for f in fields)
    return F.lit(
        "\nWrite for engineers: what was found, why, what it can lead to, and who could exploit it. "
        "Rate consequence_rating as Minor, Moderate or Major; finding_title has at most 120 characters; "
        "set needs_human_review only when context is missing.\n"
        f"Answer with one JSON object only: {{{shape}}}"
    )


def finding_prompt(fields: list[str]) -> Column:
    """Request text for a resource group; expects the columns of ``enrich.resource_context``."""
    tags = F.array_join(
        F.transform(F.map_entries("resource_tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "
    )
    return F.concat(
        F.lit("Describe this cloud security finding for an assessment report.\n\n"),
        _line("Check", _or_unknown("check_title")),
        _line("Check id", _or_unknown("check_id")),
        _line("Service", _or_unknown("service_name")),
        _line("Resource type", _or_unknown("resource_type")),
        _line("Severity", text_or(F.col("severity"), "medium")),
        _line("Check type", _or_unknown("check_type")),
        _line("Categories", text_or(F.array_join("categories", ", "), "none")),
        _line("Scope", scope_sentence(
            F.col("instance_count"), F.col("affected_account_names"), F.col("resource_name"),
            F.col("account_name"), F.col("region"),
        )),
        _line("Likelihood (fixed)", F.col("likelihood_rating")),
        F.when(
            F.coalesce("resource_uid", "resource_name").isNotNull(),
            F.concat(_line("Resource id", _or_unknown("resource_uid")), _line("Resource name", _or_unknown("resource_name"))),
        ).otherwise(""),
        F.when(F.size(F.map_keys("resource_tags")) > 0, _line("Resource tags", tags)).otherwise(""),
        F.when(F.size("compliance") > 0, _line("Compliance", F.array_join(F.slice("compliance", 1, 5), ", "))).otherwise(""),
        _line("Description", _or_unknown("description")),
        _line("Risk", _or_unknown("risk")),
        _line("Status detail", _or_unknown("status_extended")),
        _line("Remediation", _or_unknown("remediation_recommendation_text")),
        _line("CLI fix", _or_unknown("remediation_code_cli")),
        _line("Terraform fix", _or_unknown("remediation_code_terraform")),
        _answer_format(fields),
    )


def control_prompt(fields: list[str]) -> Column:
    """Request text for a control group; expects the columns of ``enrich.control_context``."""
    given = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "N/A")
    crit = F.col("criticality_raw")
    return F.concat(
        F.lit("Describe this failed configuration baseline control for an assessment report.\n\n"),
        _line("Control", _or_unknown("check_id")),
        _line("Service", _or_unknown("service_name")),
        _line("Policy", _or_unknown("check_title")),
        _line("Criticality", text_or(crit, "Shall")),
        _line("Severity", text_or(F.col("severity"), "high")),
        _line("Scope", F.when(
            F.col("instance_count") > 1,
            F.concat(F.lit("Affects "), F.col("instance_count").cast("string"), F.lit(" resource(s) in the tenant.")),
        ).otherwise("Applies to the whole tenant.")),
        _line("Likelihood (fixed)", text_or(F.col("likelihood_rating"), "High")),
        F.when(F.contains(crit, F.lit("3rd Party")), "The fix may depend on a third party.\n")
        .when(F.contains(crit, F.lit("Not Implemented")), "The organisation states it is not implemented.\n")
        .otherwise(""),
        _line("Detail", _or_unknown("status_extended")),
        F.when(given("omitted_result"), _line("Omitted evaluation", F.col("omitted_result"))).otherwise(""),
        F.when(given("incorrect_result"), _line("Result override", F.col("incorrect_result"))).otherwise(""),
        F.when(given("original_result"), _line("Original result", F.col("original_result"))).otherwise(""),
        _answer_format(fields),
    )


def chunk_prompt() -> Column:
    """Request text of a chunk; expects ``chunk_no, chunk_count, check_lines, existing_names``."""
    earlier = F.when(
        F.size("existing_names") > 0,
        F.concat(
            F.lit("\nNames used in earlier chunks; reuse one when a check clearly belongs to it:\n"),
            F.array_join(F.transform("existing_names", lambda n: F.concat(F.lit("- "), n)), "\n"), F.lit("\n"),
        ),
    ).otherwise("")
    return F.concat(
        F.lit(CHUNK_HEAD),
        F.col("chunk_no").cast("string"), F.lit(" of "), F.col("chunk_count").cast("string"), F.lit(".\n"),
        earlier, F.lit("\nChecks:\n"), F.array_join("check_lines", "\n"),
        F.lit(CHUNK_RULES + ARRAY_ONLY),
    )


def consolidation_prompt() -> Column:
    """Request text of a consolidation; expects ``group_lines``."""
    return F.concat(
        F.lit("These groups were proposed in separate batches. Merge only clear duplicates.\n\nGroups:\n"),
        F.array_join("group_lines", "\n"),
        F.lit("\n\nEvery check id appears in exactly one group; leave all other groups as they are."),
        F.lit(ARRAY_ONLY),
    )


def regroup_prompt() -> Column:
    """Request text of an analyst instruction; expects ``instruction, target_line, group_lines, pool``."""
    return F.concat(
        F.lit("Change the grouping of security checks as the analyst asks.\n\nGroups:\n"),
        F.array_join("group_lines", "\n"),
        F.when(
            F.size("pool") > 0, F.concat(F.lit("\nUnassigned: "), F.array_join("pool", ", "))
        ).otherwise(""),
        F.when(
            F.col("target_line").isNotNull(),
            F.concat(F.lit("\nThe instruction is about this group only: "), F.col("target_line")),
        ).otherwise(""),
        F.lit("\nInstruction: "), F.col("instruction"),
        F.lit("\n\nReturn the whole board; every check id appears in exactly one group."),
        F.lit(ARRAY_ONLY),
    )


def correction_prompt(prompt: Column, errors: Column, response: Column, expected: Column | None = None) -> Column:
    """A request repeated with the faults of its first answer."""
    faults = F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")
    must = F.lit("") if expected is None else F.concat(
        F.lit("\nIds that must appear exactly once: "), F.array_join(expected, ", ")
    )
    return F.concat(
        prompt, F.lit("\n\nThe previous answer was not valid:\n"), faults, must,
        F.lit("\nIt began: "), F.left(F.coalesce(response, F.lit("")), F.lit(400)),
        F.lit("\nAnswer again, with valid JSON only."),
    )
