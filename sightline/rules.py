"""Rule sets: defaults, validation, and their use as column expressions.

A rule set holds at most a few dozen entries (``validate`` checks the keys), so
lookups are constant maps: no join, no shuffle, inside codegen.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import literal_map
from sightline.schemas import STATUSES

# --- fixed values: default severity rules, risk matrix, sections -------------
SEVERITY_RULES = {
    "critical": "High", "high": "High", "medium": "Medium", "low": "Low", "informational": "Low",
}
HIGH_IF_CATEGORIES = ("internet-exposed",)
RISK_MATRIX = {
    "High_Major": "High", "High_Moderate": "High", "High_Minor": "High",
    "Medium_Major": "High", "Medium_Moderate": "Medium", "Medium_Minor": "Medium",
    "Low_Major": "Medium", "Low_Moderate": "Medium", "Low_Minor": "Low",
}
LIKELIHOODS = ("High", "Medium", "Low")
CONSEQUENCES = ("Major", "Moderate", "Minor")
INCLUDE_STATUSES = ("FAIL", "MUTED(FAIL)")
SECTION_BY_PROVIDER = {"aws": "AWS", "azure": "Azure", "gcp": "GCP"}
REF_PREFIX = {"AWS": "AWS", "Azure": "AZ", "GCP": "GCP"}

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "informational": 4}
CONTROL_SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
LIKELIHOOD_RANK = {"High": 0, "Medium": 1, "Low": 2}

# --- fixed values: control services -------------------------------------------
CONTROL_SERVICES = {
    "MS.AAD": ("Microsoft Entra ID (previously Azure Active Directory)", "ENT"),
    "MS.DEFENDER": ("Microsoft 365 Defender", "DEF"),
    "MS.EXCHANGE": ("Microsoft Exchange Online", "EXC"),
    "MS.SHAREPOINT": ("Microsoft SharePoint Online", "SPT"),
    "MS.TEAMS": ("Microsoft Teams", "TEA"),
    "MS.POWERPLATFORM": ("Microsoft Power Platform", "PPL"),
}
OTHER_SECTION = "Azure Resources"
CONTROL_SECTIONS = [s for s, _ in CONTROL_SERVICES.values()] + [OTHER_SECTION]
SECTION_SHORT_NAMES = {
    "Microsoft Entra ID (previously Azure Active Directory)": "Entra ID",
    "Microsoft 365 Defender": "Defender",
    "Microsoft Exchange Online": "Exchange Online",
    "Microsoft SharePoint Online": "SharePoint Online",
    "Microsoft Teams": "Teams",
    "Microsoft Power Platform": "Power Platform",
    "Azure Resources": "Azure Resources",
}
CRITICALITY_SEVERITY = {
    "Shall": "high", "Should": "medium", "May": "low",
    "Shall/3rd Party": "high", "Shall/Not Implemented": "high",
}
INCLUDE_CRITICALITY = ("Shall", "Shall/3rd Party", "Shall/Not Implemented")


@dataclass(frozen=True)
class Rules:
    """One set of rules; every part has the default of the sample configuration."""

    include_statuses: tuple = INCLUDE_STATUSES
    severity_rules: dict = field(default_factory=lambda: dict(SEVERITY_RULES))
    high_if_categories: tuple = HIGH_IF_CATEGORIES
    risk_matrix: dict = field(default_factory=lambda: dict(RISK_MATRIX))
    ref_prefix: dict = field(default_factory=lambda: dict(REF_PREFIX))
    include_criticality: tuple = INCLUDE_CRITICALITY
    criticality_severity: dict = field(default_factory=lambda: dict(CRITICALITY_SEVERITY))
    control_services: dict = field(default_factory=lambda: dict(CONTROL_SERVICES))
    client_name: str = ""
    assessment_period: str = ""
    tenant_id: str = ""


REQUIRED_SECTIONS = ("processing", "severity_rules", "risk_matrix", "output")


def load_rules(config: dict) -> Rules:
    """Build resource rules from a parsed configuration; reject an invalid one."""
    absent = [s for s in REQUIRED_SECTIONS if s not in config]
    if absent:
        raise ValueError(f"configuration lacks section(s) {absent}")
    severity = dict(config["severity_rules"])
    categories = tuple(severity.pop("likelihood_high_if_categories", ()))
    output, engagement = config["output"], config.get("engagement", {})
    rules = Rules(
        include_statuses=tuple(config["processing"].get("include_statuses", INCLUDE_STATUSES)),
        severity_rules={**SEVERITY_RULES, **severity},
        high_if_categories=categories,
        risk_matrix=dict(config["risk_matrix"]),
        ref_prefix={
            "AWS": output.get("ref_prefix", "AWS"),
            "Azure": output.get("ref_prefix_azure", "AZ"),
            "GCP": output.get("ref_prefix_gcp", "GCP"),
        },
        client_name=engagement.get("client_name", ""),
        assessment_period=engagement.get("assessment_period", ""),
    )
    validate(rules)
    return rules


def load_control_rules(config: dict) -> Rules:
    """Build control rules from a parsed configuration; absent parts take defaults."""
    services = {
        k.upper(): (v["section"], v["ref_prefix"]) for k, v in config.get("service_map", {}).items()
    }
    engagement = config.get("engagement", {})
    return Rules(
        include_criticality=tuple(
            config.get("processing", {}).get("include_criticality", INCLUDE_CRITICALITY)
        ),
        criticality_severity=dict(config.get("severity_map", {})),
        control_services={**CONTROL_SERVICES, **services},
        risk_matrix=dict(config.get("risk_matrix", {})),
        client_name=engagement.get("client_name", ""),
        assessment_period=engagement.get("assessment_period", ""),
        tenant_id=engagement.get("tenant_id", ""),
    )


def validate(rules: Rules) -> None:
    """Raise on a status or a risk-matrix key outside its domain."""
    bad = [s for s in rules.include_statuses if s not in STATUSES or s == "UNKNOWN"]
    if bad:
        raise ValueError(f"unknown status in include_statuses: {bad}")
    legal = {f"{l}_{c}" for l in LIKELIHOODS for c in CONSEQUENCES}
    bad = [k for k in rules.risk_matrix if k not in legal]
    if bad:
        raise ValueError(f"invalid risk_matrix key(s) {bad}; expected Likelihood_Consequence")


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The rules as rows ``(rule, rule_key, rule_value)`` for storage and inspection."""
    rows = [("include_status", s, "INCLUDED") for s in rules.include_statuses]
    rows += [("severity", k, v) for k, v in rules.severity_rules.items()]
    rows += [("high_if_category", c, "High") for c in rules.high_if_categories]
    rows += [("risk_matrix", k, v) for k, v in rules.risk_matrix.items()]
    rows += [("ref_prefix", k, v) for k, v in rules.ref_prefix.items()]
    rows += [("include_criticality", c, "INCLUDED") for c in rules.include_criticality]
    rows += [("criticality_severity", k, v) for k, v in rules.criticality_severity.items()]
    rows += [("control_service", k, f"{s}|{p}") for k, (s, p) in rules.control_services.items()]
    return spark.createDataFrame(rows, "rule STRING, rule_key STRING, rule_value STRING")


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a key in a small literal dict; unmatched and null keys give ``default``."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(literal_map(table), key), default) if table else default


def severity_rank(severity: Column, table: dict = SEVERITY_RANK, missing: str | None = None) -> Column:
    """Rank of a severity, most severe first; a value outside the table ranks 5."""
    value = F.lower(severity)
    if missing is not None:
        value = F.coalesce(F.nullif(value, F.lit("")), F.lit(missing))
    return lookup(value, table, 5)


def risk_rating(likelihood: Column, consequence: Column, matrix: dict) -> Column:
    """Risk of a likelihood and a consequence; a pair outside the matrix is Medium."""
    return lookup(F.concat(likelihood, F.lit("_"), consequence), matrix, "Medium")
