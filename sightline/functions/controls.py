"""Row-level rules of control findings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import strip
from sightline.rules import OTHER_SECTION, SECTION_SHORT_NAMES, lookup
from sightline.schemas import CONTROL_EMPTY


def clean_control(c: Column) -> Column:
    """Stripped text; the values a control export uses for 'nothing' become null."""
    v = strip(c)
    return F.when(~v.isin(*CONTROL_EMPTY), v)


def control_status(c: Column) -> Column:
    v = F.lower(strip(c))
    return F.when(v == "fail", "FAIL").when(v == "pass", "PASS").otherwise("UNKNOWN")


def control_severity(criticality: Column, table: dict) -> Column:
    """Severity from the rule table, else from the first word of the criticality."""
    low = F.lower(criticality)
    guess = (
        F.when(F.startswith(low, F.lit("shall")), "high")
        .when(F.startswith(low, F.lit("should")), "medium")
        .otherwise("low")
    )
    empty = criticality.isNull() | (criticality == "")
    return F.when(empty, "medium").otherwise(lookup(criticality, table, guess))


def initial_likelihood(severity: Column) -> Column:
    return lookup(severity, {"high": "High", "medium": "Medium", "low": "Low"}, "Medium")


def resolve_service(control_id: Column, services: dict) -> Column:
    """``struct(service_prefix, output_section, ref_prefix)`` by the longest known prefix."""
    parts = F.upper(control_id)
    long, short = F.substring_index(parts, ".", 3), F.substring_index(parts, ".", 2)
    sections = {k: s for k, (s, _) in services.items()}
    prefixes = {k: p for k, (_, p) in services.items()}
    known = F.when(long.isin(*services), long).when(short.isin(*services), short)
    return F.struct(
        F.coalesce(known, F.lit("UNKNOWN")).alias("service_prefix"),
        lookup(known, sections, OTHER_SECTION).alias("output_section"),
        lookup(known, prefixes, "M365").alias("ref_prefix"),
    )


def service_short_name(section: Column) -> Column:
    return lookup(section, SECTION_SHORT_NAMES, section)


def control_stable_key(tenant: Column, control_id: Column) -> Column:
    return F.concat_ws(":", F.lit("azure"), tenant, control_id)


def control_dedup_key(tenant: Column, control_id: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", F.lit("azure"), tenant, control_id), 256), F.lit(16))


def ref_label(prefix: Column, number: Column) -> Column:
    """``ENT1``; empty until both parts are known."""
    ready = prefix.isNotNull() & (prefix != "") & number.isNotNull()
    return F.when(ready, F.concat(prefix, number.cast("string"))).otherwise("")
