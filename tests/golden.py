"""Thirty findings that touch every ingest rule, with their known results."""

PROD, DEV, OLD = ("111122223333", "acme-prod"), ("444455556666", "acme-dev"), ("777788889999", "acme-legacy")
AP, US = "ap-southeast-2", "us-east-1"
SG = "ec2_securitygroup_allow_ingress_from_internet_to_tcp_port_22"
LOGS = "cloudwatch_log_group_retention_policy_specific_days_enabled"
EC2 = f"arn:aws:ec2:{AP}:111122223333:"

# account, check, status, muted, service, severity, uid, name, region, (D, R, M), categories
_ROWS = [
    (PROD, "s3_bucket_public_access", "FAIL", "False", "s3", "high", "arn:aws:s3:::acme-prod-logs", None, AP, "111", "internet-exposed | data-protection"),
    (PROD, "s3_bucket_public_access", "FAIL", "False", "s3", "high", "arn:aws:s3:::acme-prod-backups", None, AP, "111", "internet-exposed | data-protection"),
    (DEV, "s3_bucket_public_access", "FAIL", "False", "s3", "high", "arn:aws:s3:::acme-dev-uploads", None, AP, "111", "internet-exposed"),
    (OLD, "s3_bucket_public_access", "FAIL", "False", "s3", "high", "arn:aws:s3:::legacy-data", None, US, "111", "internet-exposed"),
    (PROD, "s3_bucket_public_access", "FAIL", "False", "s3", "high", "arn:aws:s3:::acme-prod-logs", None, AP, "111", "internet-exposed | data-protection"),
    (PROD, "s3_bucket_default_encryption", "MUTED(FAIL)", "True", "s3", "medium", "arn:aws:s3:::acme-prod-archive", None, AP, "111", "encryption"),
    (PROD, "s3_bucket_versioning_enabled", "PASS", "False", "s3", "low", "arn:aws:s3:::acme-prod-logs", None, AP, "100", "resilience"),
    *[(PROD, "iam_user_mfa_enabled_console_access", "FAIL", "False", "iam", "critical", f"arn:aws:iam::111122223333:user/{u}", None, None, "001", "identity-management | mfa")
      for u in ("john.smith", "jane.doe", "svc-deploy")],
    (PROD, "iam_root_mfa_enabled", "FAIL", "False", "iam", "critical", None, None, None, "111", "identity-management | mfa"),
    (PROD, "iam_user_access_key_age_90_days", "FAIL", "True", "iam", "medium", "arn:aws:iam::111122223333:user/svc-deploy", None, None, "111", "identity-management | credential-hygiene"),
    (PROD, "iam_password_policy_lowercase", "FAIL", "False", "iam", "medium", "arn:aws:iam::111122223333:account", None, None, "100", "identity-management"),
    (PROD, SG, "FAIL", "False", "ec2", "critical", EC2 + "security-group/sg-0prod1234", None, AP, "111", "internet-exposed | network-security"),
    (PROD, "ec2_instance_imdsv2_enabled", "FAIL", "False", "ec2", "high", None, "i-0aabbccdd", AP, "111", "configuration | credential-protection"),
    *[(PROD, "ec2_ebs_volume_encryption_enabled", "FAIL", "False", "ec2", "high", EC2 + f"volume/vol-{v}", None, AP, "111", "encryption | data-protection")
      for v in ("0aaa1111", "0bbb2222", "0ccc3333")],
    (PROD, "rds_instance_storage_encrypted", "FAIL", "False", "rds", "high", f"arn:aws:rds:{AP}:111122223333:db:prod-postgres", None, AP, "001", "encryption"),
    (PROD, "rds_instance_no_public_access", "FAIL", "False", "rds", "critical", f"arn:aws:rds:{AP}:111122223333:db:prod-postgres", None, AP, "111", "internet-exposed | network-security"),
    (PROD, "rds_instance_no_public_access", "FAIL", "False", "rds", "critical", f"arn:aws:rds:{AP}:111122223333:db:prod-postgres", None, AP, "111", "internet-exposed"),
    (PROD, "vpc_flow_logs_enabled", "FAIL", "False", "vpc", "medium", EC2 + "vpc/vpc-0prod5678", None, AP, "111", "logging | internet-exposed"),
    (PROD, "cloudtrail_multi_region_enabled", "FAIL", "False", "cloudtrail", "high", f"arn:aws:cloudtrail:{AP}:111122223333:trail/management-trail", None, AP, "111", "logging | auditing"),
    (PROD, LOGS, "FAIL", "False", "cloudwatch", "informational", f"arn:aws:logs:{AP}:111122223333:log-group:/aws/lambda/prod-api", None, AP, "111", "logging | cost-optimisation"),
    (PROD, "guardduty_is_enabled", "MANUAL", "False", "guardduty", "high", None, "guardduty", AP, "011", "threat-detection"),
    (PROD, "config_recorder_all_regions_enabled", "FAIL", "False", "account", "medium", None, None, None, "111", "configuration | auditing"),
    (PROD, "securityhub_enabled", "FAIL", "False", "securityhub", "medium", None, "security-hub", AP, "111", "configuration | monitoring"),
    (OLD, "iam_user_mfa_enabled_console_access", "FAIL", "False", "iam", "critical", "arn:aws:iam::777788889999:user/admin.legacy", None, None, "001", "identity-management | mfa"),
    (OLD, SG, "FAIL", "False", "ec2", "critical", f"arn:aws:ec2:{US}:777788889999:security-group/sg-0legacy99", None, US, "111", "internet-exposed | network-security"),
    (OLD, "s3_bucket_default_encryption", "FAIL", "False", "s3", "medium", "arn:aws:s3:::legacy-archive", None, US, "000", None),
]

# Column names of an export.
COLUMNS = [
    "ACCOUNT_UID", "ACCOUNT_NAME", "CHECK_ID", "CHECK_TITLE", "STATUS", "MUTED", "SERVICE_NAME", "SEVERITY",
    "RESOURCE_UID", "RESOURCE_NAME", "REGION", "DESCRIPTION", "RISK", "REMEDIATION_RECOMMENDATION_TEXT",
    "CATEGORIES", "PROVIDER", "PROWLER_VERSION", "FUTURE_COLUMN",
]


def export_rows():
    """The rows as cells of an export, in COLUMNS order; None is a blank cell."""
    for i, (acct, check, status, muted, service, severity, uid, name, region, flags, cats) in enumerate(_ROWS):
        d, r, m = (word if f == "1" else None for f, word in zip(flags, ("What, exactly?", "Why\nit matters", "Do this")))
        yield [*acct, check, f"Title of {check}", status, muted, service, severity, uid, name, region, d, r, m, cats, "aws", "4.3.1",
               "new" if i == 26 else None]


STATUS = {"FAIL": 26, "MANUAL": 1, "MUTED(FAIL)": 2, "PASS": 1}
WARNINGS = {"ARN_FALLBACK": 3, "DATA_QUALITY_BLANK": 9, "MUTED_STATUS_RECONCILED": 1, "UNKNOWN_COLUMNS": 1}
GROUPS = [
    ("critical", "High", 2, SG),
    ("critical", "High", 1, "iam_root_mfa_enabled"),
    ("critical", "High", 4, "iam_user_mfa_enabled_console_access"),
    ("critical", "High", 1, "rds_instance_no_public_access"),
    ("high", "High", 1, "cloudtrail_multi_region_enabled"),
    ("high", "High", 3, "ec2_ebs_volume_encryption_enabled"),
    ("high", "High", 1, "ec2_instance_imdsv2_enabled"),
    ("high", "High", 1, "rds_instance_storage_encrypted"),
    ("high", "High", 4, "s3_bucket_public_access"),
    ("medium", "Medium", 1, "config_recorder_all_regions_enabled"),
    ("medium", "Medium", 1, "iam_password_policy_lowercase"),
    ("medium", "Medium", 1, "iam_user_access_key_age_90_days"),
    ("medium", "Medium", 2, "s3_bucket_default_encryption"),
    ("medium", "Medium", 1, "securityhub_enabled"),
    ("medium", "High", 1, "vpc_flow_logs_enabled"),
    ("informational", "Low", 1, LOGS),
]
