"""Column names, fixed value sets and declared schemas."""

from pyspark.sql import types as T

# --- fixed values: the 41 columns of a resource-findings export -------------
RESOURCE_COLUMNS = [
    "AUTH_METHOD", "TIMESTAMP", "ACCOUNT_UID", "ACCOUNT_NAME", "ACCOUNT_EMAIL", "ACCOUNT_ORGANIZATION_UID",
    "ACCOUNT_ORGANIZATION_NAME", "ACCOUNT_TAGS", "FINDING_UID", "PROVIDER", "CHECK_ID", "CHECK_TITLE", "CHECK_TYPE",
    "STATUS", "STATUS_EXTENDED", "MUTED", "SERVICE_NAME", "SUBSERVICE_NAME", "SEVERITY", "RESOURCE_TYPE",
    "RESOURCE_UID", "RESOURCE_NAME", "RESOURCE_DETAILS", "RESOURCE_TAGS", "PARTITION", "REGION", "DESCRIPTION",
    "RISK", "RELATED_URL", "REMEDIATION_RECOMMENDATION_TEXT", "REMEDIATION_RECOMMENDATION_URL",
    "REMEDIATION_CODE_NATIVEIAC", "REMEDIATION_CODE_TERRAFORM", "REMEDIATION_CODE_CLI", "REMEDIATION_CODE_OTHER",
    "COMPLIANCE", "CATEGORIES", "DEPENDS_ON", "RELATED_TO", "NOTES", "PROWLER_VERSION",
]

# --- fixed values: names used by older exports -> current names -------------
COLUMN_ALIASES = {
    "ASSESSMENT_START_TIME": "TIMESTAMP",
    "FINDING_UNIQUE_ID": "FINDING_UID",
    "ACCOUNT_ID": "ACCOUNT_UID",
    "ACCOUNT_ORG": "ACCOUNT_ORGANIZATION_UID",
    "RESOURCE_ARN": "RESOURCE_UID",
    "RESOURCE_ID": "RESOURCE_NAME",
    "PROFILE": "AUTH_METHOD",
    "ACCOUNT_ARN": "ACCOUNT_ORGANIZATION_UID",
    "REMEDIATION_RECOMMENDATION_CODE_NATIVEIAC": "REMEDIATION_CODE_NATIVEIAC",
    "REMEDIATION_RECOMMENDATION_CODE_TERRAFORM": "REMEDIATION_CODE_TERRAFORM",
    "REMEDIATION_RECOMMENDATION_CODE_CLI": "REMEDIATION_CODE_CLI",
    "REMEDIATION_RECOMMENDATION_CODE_OTHER": "REMEDIATION_CODE_OTHER",
}

# A file counts as a findings export when its header knows this many names.
MIN_KNOWN_COLUMNS = 10

# --- fixed values: legal statuses and inclusion states ----------------------
STATUSES = ("PASS", "FAIL", "MUTED(FAIL)", "MUTED(PASS)", "MUTED(MANUAL)", "MANUAL", "UNKNOWN")
INCLUDED, EXCLUDED = "INCLUDED", "EXCLUDED"

# --- fixed values: services without a region --------------------------------
GLOBAL_SERVICES = (
    "iam", "account", "organizations", "budgets", "cost-optimization",
    "cloudfront", "route53", "waf",
)
STRUCTURALLY_BLANK = (
    "ACCOUNT_ORGANIZATION_UID", "ACCOUNT_ORGANIZATION_NAME", "SUBSERVICE_NAME",
    "RESOURCE_DETAILS", "DEPENDS_ON", "RELATED_TO", "NOTES",
)
DATA_QUALITY = ("DESCRIPTION", "RISK", "REMEDIATION_RECOMMENDATION_TEXT")

# --- fixed values: control-findings export -----------------------------------
CONTROL_REQUIRED = ("Control ID", "Requirement", "Result", "Criticality", "Details")
CONTROL_OPTIONAL = {
    "Non-Compliance Reason": "raw_non_compliance_reason",
    "Remediation Completion Date": "raw_remediation_date",
    "Justification": "raw_justification",
    "OmittedEvaluationResult": "raw_omitted_result",
    "OmittedEvaluationDetails": "raw_omitted_details",
    "IncorrectResult": "raw_incorrect_result",
    "IncorrectResultDetails": "raw_incorrect_details",
    "OriginalResult": "raw_original_result",
    "OriginalDetails": "raw_original_details",
    "ResolutionDate": "raw_resolution_date",
    "Comments": "raw_comments",
}
CONTROL_EMPTY = ("", "N/A", "System.Object[]")


def raw_name(column: str) -> str:
    """Target name of a findings column: ``CHECK_ID`` -> ``raw_check_id``."""
    return "raw_" + column.lower()


RAW_FIELDS = [raw_name(c) for c in RESOURCE_COLUMNS]

# Identity columns every findings DataFrame carries.  ``row_no`` is the row's
# number in its file (first data row = 2); ``row_seq`` orders rows over all
# files of a run and is unique in it.
IDENTITY = [
    T.StructField("run_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_file_hash", T.StringType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("row_seq", T.LongType()),
]

RAW_FINDINGS = T.StructType(
    IDENTITY
    + [T.StructField(f, T.StringType()) for f in RAW_FIELDS]
    + [T.StructField("extra_fields", T.MapType(T.StringType(), T.StringType()))]
)

CONTROL_FIELDS = [
    "raw_control_id", "raw_requirement", "raw_result", "raw_criticality", "raw_details",
] + list(CONTROL_OPTIONAL.values())

RAW_CONTROLS = T.StructType(
    IDENTITY
    + [T.StructField("tenant_id", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in CONTROL_FIELDS]
    + [T.StructField("extra_fields", T.MapType(T.StringType(), T.StringType()))]
)

WARNINGS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("check_id", T.StringType()),
    T.StructField("finding_id", T.StringType()),
])

AUDIT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("finding_instance_id", T.StringType()),
    T.StructField("stage_no", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("stage", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("old_value", T.StringType()),
    T.StructField("new_value", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("actor", T.StringType()),
])

# Nested findings JSON, only the fields that are read.  Lists whose items may
# be of any type are declared as strings: Spark keeps their JSON text.
NESTED_FINDING = (
    "status STRING, status_code STRING, status_detail STRING, severity STRING, "
    "risk_details STRING, category_name STRING, time_dt STRING, "
    "metadata STRUCT<product: STRUCT<version: STRING>>, "
    "finding_info STRUCT<uid: STRING, title: STRING, `desc`: STRING, "
    "created_time_dt: STRING, types: ARRAY<STRING>>, "
    "cloud STRUCT<provider: STRING, region: STRING, "
    "account: STRUCT<uid: STRING, name: STRING, labels: ARRAY<STRING>>, org: STRUCT<uid: STRING>>, "
    "resources ARRAY<STRUCT<uid: STRING, name: STRING, type: STRING, region: STRING, "
    "`group`: STRUCT<name: STRING>, labels: ARRAY<STRING>, data: STRUCT<details: STRING>>>, "
    "remediation STRUCT<`desc`: STRING, references: ARRAY<STRING>>, "
    "unmapped STRUCT<provider: STRING, categories: ARRAY<STRING>, compliance: STRING, "
    "related_url: STRING, additional_urls: ARRAY<STRING>, depends_on: ARRAY<STRING>, "
    "related_to: ARRAY<STRING>, notes: STRING>"
)

PROPOSAL_ITEMS = "ARRAY<STRUCT<group_name: STRING, check_ids: ARRAY<STRING>, rationale: STRING>>"

APPROVAL_FILE = (
    "run_id STRING, approved_at STRING, groups ARRAY<STRUCT<group_name: STRING, "
    "check_ids: ARRAY<STRING>, rationale: STRING, analyst_note: STRING, "
    "risk_rating_override: STRING, risk_rating: STRING>>"
)
