"""Reading and checking response texts, and the budget of a request."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import quoted_list, strip
from sightline.schemas import PROPOSAL_ITEMS

# --- fixed values: what an enrichment answer must hold ---------------------------
NARRATIVES = [
    "finding_title", "root_cause_narrative", "situation_narrative", "consequence_narrative", "access_required",
]
RATINGS = ("Major", "Minor", "Moderate")
TITLE_LIMIT = 120


def enrichment_fields(recommendations: bool = False) -> list[str]:
    """Required fields; control answers also hold recommendations."""
    return sorted([*NARRATIVES, "consequence_rating", "needs_human_review"] + ["recommendations"] * recommendations)


def unfence(text: Column) -> Column:
    """Stripped text without the lines of a ``` fence it starts with."""
    t = strip(text)
    body = strip(F.regexp_replace(t, r"(?m)^\s*```.*(?:\n|\z)", ""))
    return F.when(F.startswith(t, F.lit("```")), body).otherwise(t)


def _first_json(text: Column, opening: str, pattern: str) -> Column:
    """JSON text of a response: all of it, else its outermost brackets; null if neither parses."""
    t = unfence(text)
    whole = F.when(F.try_parse_json(t).isNotNull(), t)
    inner = F.regexp_extract(t, pattern, 0)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def json_object(text: Column) -> Column:
    return _first_json(text, "{", r"(?s)\{.*\}")


def json_array(text: Column) -> Column:
    return _first_json(text, "[", r"(?s)\[.*\]")


def enrichment_errors(body: Column, recommendations: bool = False) -> Column:
    """Error texts of an enrichment answer given as a variant; empty when it is valid."""
    kind = lambda f: F.schema_of_variant(F.try_variant_get(body, f"$.{f}", "variant"))
    text = lambda f: F.try_variant_get(body, f"$.{f}", "string")
    checks = []
    for f in enrichment_fields(recommendations):
        checks.append(F.when(kind(f).isNull(), F.lit(f"missing field '{f}'")))
        checks.append(F.when(kind(f) == "VOID", F.lit(f"field '{f}' is null")))
    rating = text("consequence_rating")
    checks.append(F.when(
        ~F.coalesce(rating.isin(*RATINGS) & (kind("consequence_rating") == "STRING"), F.lit(False)),
        F.concat(
            F.lit("consequence_rating='"), F.coalesce(rating, F.lit("")),
            F.lit(f"' must be one of: {quoted_list(RATINGS)}"),
        ),
    ))
    checks.append(F.when(
        ~F.coalesce(kind("needs_human_review") == "BOOLEAN", F.lit(False)),
        F.concat(
            F.lit("needs_human_review must be boolean true/false, got: "),
            F.coalesce(F.to_json(F.try_variant_get(body, "$.needs_human_review", "variant")), F.lit("None")),
        ),
    ))
    title = F.when(kind("finding_title") == "STRING", text("finding_title"))
    checks.append(F.when(
        F.length(title) > TITLE_LIMIT,
        F.concat(F.lit("finding_title is "), F.length(title).cast("string"), F.lit(f" chars, max {TITLE_LIMIT}")),
    ))
    errors = F.array_compact(F.array(*checks))
    not_object = ~F.startswith(F.coalesce(F.schema_of_variant(body), F.lit("")), F.lit("OBJECT"))
    return F.when(body.isNull() | not_object, F.array(F.lit("no valid JSON object in response"))).otherwise(errors)


def proposal_items(body: Column) -> Column:
    """Groups of a proposal answer given as JSON text."""
    return F.from_json(body, PROPOSAL_ITEMS)


def chunk_tokens(items: Column, base: int) -> Column:
    """Answer budget of a chunk or consolidation request."""
    return F.greatest(F.lit(base), F.least(F.lit(300) + items * 90, F.lit(4000)))


def chunk_seconds(items: Column, base: int) -> Column:
    return F.greatest(F.lit(base), F.lit(60) + items * 3)


def regroup_tokens(items: Column, base: int) -> Column:
    """Answer budget of a regroup request, which restates the whole board."""
    return F.greatest(F.lit(base), F.least(F.lit(800) + items * 80, F.lit(8000)))


def regroup_seconds(items: Column, base: int) -> Column:
    return F.greatest(F.lit(base), F.lit(90) + items * 3)


def request_key(model, prompt: Column) -> Column:
    """Cache key of a request."""
    model = model if isinstance(model, Column) else F.lit(model)
    return F.sha2(F.concat(model, F.lit("::"), prompt), 256)


def grouping_errors(items: Column, expected: Column, strict: bool = True) -> Column:
    """Error texts of a proposal given as parsed items; empty when it is valid.

    ``strict`` also asks for rationales and refuses ids that were not asked
    for; an analyst's regroup request does neither.
    """
    label = lambda i, what: F.concat(F.lit("Group "), i.cast("string"), F.lit(f": missing or empty '{what}'"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    per_item = F.transform(items, lambda g, i: F.array_compact(F.array(
        F.when(blank(g["group_name"]), label(i, "group_name")),
        F.when(F.coalesce(F.size(g["check_ids"]), F.lit(0)) <= 0, label(i, "check_ids")),
        F.when(F.lit(strict) & blank(g["rationale"]), label(i, "rationale")),
    )))
    ids = F.flatten(F.transform(items, lambda g: F.coalesce(g["check_ids"], F.array().cast("array<string>"))))
    repeated = F.array_distinct(F.filter(ids, lambda x, i: F.array_position(ids, x) <= i))
    missing = F.array_sort(F.array_except(expected, ids))
    extra = F.array_sort(F.array_except(ids, expected))
    listing = lambda text, c: F.when(F.size(c) > 0, F.array(F.concat(F.lit(text), F.array_join(c, ", ")))).otherwise(
        F.array().cast("array<string>")
    )
    errors = F.concat(
        F.flatten(per_item),
        F.transform(repeated, lambda x: F.concat(F.lit("check_id '"), x, F.lit("' appears in more than one group"))),
        listing("Missing check_ids: ", missing),
        listing("Unknown check_ids: ", extra) if strict else F.array().cast("array<string>"),
    )
    return F.when(
        F.coalesce(F.size(items), F.lit(0)) <= 0, F.array(F.lit("Expected a non-empty JSON array of groups"))
    ).otherwise(errors)
