"""The registered queries in DuckDB SQL, written independently of the operators.

``CTES`` are named building blocks; a query states its final SELECT and gets
the blocks it needs.  Line items are numbered in file order.
"""

import re

from sightline.functions.prompts import ARRAY_ONLY, CHUNK_HEAD, CHUNK_RULES
from sightline.sources.tables import CONTROLS_SQL, FINDINGS_SQL

_TABLES = {t: t for t in ("orders", "customer", "nation", "region", "part", "supplier")}
_LEGAL_MUTED = "('MUTED(FAIL)', 'MUTED(PASS)', 'MUTED(MANUAL)')"
_RANK = "CASE {} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'informational' THEN 4 ELSE 5 END"
_CRANK = "CASE {} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 5 END"
_LRANK = "CASE {} WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END"
_SECRANK = (
    "CASE {} WHEN 'Microsoft Entra ID (previously Azure Active Directory)' THEN 0 WHEN 'Microsoft 365 Defender' THEN 1 "
    "WHEN 'Microsoft Exchange Online' THEN 2 WHEN 'Microsoft SharePoint Online' THEN 3 WHEN 'Microsoft Teams' THEN 4 "
    "WHEN 'Microsoft Power Platform' THEN 5 WHEN 'Azure Resources' THEN 6 ELSE 99 END"
)
_MATRIX = (
    "CASE {l} || '_' || {c} WHEN 'High_Major' THEN 'High' WHEN 'High_Moderate' THEN 'High' WHEN 'High_Minor' THEN 'High' "
    "WHEN 'Medium_Major' THEN 'High' WHEN 'Low_Minor' THEN 'Low' ELSE 'Medium' END"
)


def _html(expr: str) -> str:
    """Text of an HTML fragment."""
    t = f"regexp_replace({expr}, '<div[^>]*class=[''\"]policy-indicators[''\"][^>]*>.*?</div>', '', 'gis')"
    t = (
        f"regexp_replace({t}, '<script\\b[^>]*>(.*?)</script\\s*>|<style\\b[^>]*>(.*?)</style\\s*>|<!--.*?-->"
        "|<(?:script|style)\\b[^>]*>.*\\z|<!--.*\\z|<[a-z/!?](?:\"[^\"]*\"|''[^'']*''|[^>\"''])*>|<[a-z/!?][^>]*(?:>|\\z)'"
        ", '\\1\\2', 'gis')"
    )
    for name, char in {"lt": "<", "gt": ">", "quot": '"', "#39": "''", "apos": "''", "nbsp": "\xa0", "copy": "\xa9", "middot": "\xb7"}.items():
        t = f"replace({t}, '&{name};', '{char}')"
    t = f"regexp_replace({t}, '&amp;?', '&', 'g')"
    return f"coalesce(trim({t}, ' ' || chr(9) || chr(10) || chr(13)), '')"


def _clean_control(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN ('', 'N/A', 'System.Object[]') THEN trim({c}) END"


CTES = {
    "numbered": "SELECT *, row_number() OVER () + 1 AS row_no, row_number() OVER () + 1 AS row_seq FROM lineitem",
    "raw": FINDINGS_SQL.format(lineitem="numbered", **_TABLES),
    "controls_raw": CONTROLS_SQL.format(lineitem="numbered", **_TABLES),
    "cells": """SELECT *, upper(trim(raw_status)) AS st, lower(trim(raw_muted)) IN ('true', '1', 'yes') AS mu FROM raw""",
    "norm0": f"""SELECT *, sha256(run_id || ':' || row_seq) AS finding_instance_id,
      'Sheet:' || sheet_name || ' Row:' || row_no AS source_row_id,
      CASE WHEN mu THEN CASE WHEN st IN {_LEGAL_MUTED} THEN st WHEN st IN ('FAIL', 'PASS', 'MANUAL') THEN 'MUTED(' || st || ')'
          ELSE 'MUTED(FAIL)' END
        WHEN st IN {_LEGAL_MUTED} OR st IN ('FAIL', 'PASS', 'MANUAL') THEN st ELSE 'UNKNOWN' END AS scanner_status,
      mu AND st NOT LIKE 'MUTED(%' AS muted_reconciled,
      NOT mu AND st LIKE 'MUTED(%)' AND st NOT IN {_LEGAL_MUTED} AS unknown_status,
      CASE WHEN raw_description IS NULL THEN 'DATA_QUALITY' ELSE 'POPULATED' END AS blank_description,
      CASE WHEN raw_risk IS NULL THEN 'DATA_QUALITY' ELSE 'POPULATED' END AS blank_risk,
      CASE WHEN raw_remediation_recommendation_text IS NULL THEN 'DATA_QUALITY' ELSE 'POPULATED' END AS blank_remediation,
      CASE WHEN raw_region IS NOT NULL THEN 'POPULATED' WHEN lower(raw_service_name) IN ('iam', 'account', 'organizations',
        'budgets', 'cost-optimization', 'cloudfront', 'route53', 'waf') THEN 'STRUCTURAL' ELSE 'BY_DESIGN' END AS blank_region,
      [x FOR x IN [CASE WHEN raw_description IS NULL THEN 'DESCRIPTION' END, CASE WHEN raw_risk IS NULL THEN 'RISK' END,
        CASE WHEN raw_remediation_recommendation_text IS NULL THEN 'REMEDIATION_RECOMMENDATION_TEXT' END] IF x IS NOT NULL] AS blank_fields,
      coalesce(raw_region, 'global') AS region_normalised,
      CASE WHEN regexp_matches(raw_resource_uid, '(?i)^arn:[a-z0-9\\-]+:[a-z0-9\\-]+:[^:]*:[^:]*:.+$')
        THEN regexp_replace(raw_resource_uid, '/+$', '') ELSE coalesce(raw_resource_uid, raw_resource_name, '') END AS resource_uid_normalised,
      raw_resource_uid IS NULL AS arn_fallback_used,
      [trim(x) FOR x IN string_split(raw_categories, '|') IF trim(x) <> ''] AS categories_list,
      (raw_description IS NOT NULL)::BIGINT + (raw_risk IS NOT NULL)::BIGINT + (raw_remediation_recommendation_text IS NOT NULL)::BIGINT
        + (raw_check_title IS NOT NULL)::BIGINT + (raw_status_extended IS NOT NULL)::BIGINT AS completeness_score
      FROM cells""",
    "norm": """SELECT *,
      lower(coalesce(raw_provider, 'unknown')) || ':' || replace(lower(raw_account_name), ' ', '_') || ':' || lower(raw_service_name)
        || ':' || lower(raw_check_id) || ':' || lower(coalesce(nullif(resource_uid_normalised, ''), 'no_resource')) AS stable_finding_key,
      raw_account_uid || ':' || lower(raw_check_id) || CASE WHEN resource_uid_normalised = '' THEN ''
        ELSE ':' || lower(resource_uid_normalised) || ':' || lower(region_normalised) END AS dedup_key,
      CASE WHEN len(blank_fields) > 0 THEN 'Category 2 blank fields: ' || array_to_string(blank_fields, ', ')
        WHEN resource_uid_normalised = '' THEN 'No resource identifier (both RESOURCE_UID and RESOURCE_NAME blank)' END AS review_reason
      FROM norm0""",
    "filt": """SELECT *, scanner_status IN ('FAIL', 'MUTED(FAIL)') AS keep,
      CASE WHEN scanner_status IN ('FAIL', 'MUTED(FAIL)') THEN NULL ELSE 'scanner_status ''' || scanner_status
        || ''' not in include_statuses [''FAIL'', ''MUTED(FAIL)'']' END AS filter_reason FROM norm""",
    "proc0": """SELECT *, CASE WHEN keep THEN row_number() OVER (PARTITION BY run_id, dedup_key, keep ORDER BY row_seq) ELSE 1 END > 1 AS is_duplicate,
      first_value(finding_instance_id) OVER (PARTITION BY run_id, dedup_key, keep ORDER BY row_seq) AS primary_id FROM filt""",
    "proc": """SELECT *, CASE WHEN is_duplicate THEN primary_id END AS duplicate_of,
      CASE WHEN keep AND NOT is_duplicate THEN 'INCLUDED' ELSE 'EXCLUDED' END AS report_inclusion,
      CASE WHEN is_duplicate THEN 'Duplicate of finding_instance_id=' || primary_id || ' (same dedup_key)' ELSE filter_reason END AS exclusion_reason,
      coalesce(raw_check_id, 'unknown') AS check_id,
      CASE lower(raw_provider) WHEN 'aws' THEN 'AWS' WHEN 'azure' THEN 'Azure' WHEN 'gcp' THEN 'GCP' ELSE 'AWS' END AS output_section
      FROM proc0""",
    "work": "SELECT * FROM proc WHERE report_inclusion = 'INCLUDED'",
    "reps": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY run_id, check_id, output_section) AS instance_count,
      row_number() OVER (PARTITION BY run_id, check_id, output_section ORDER BY completeness_score DESC, row_seq) AS rn FROM work) WHERE rn = 1""",
    "grp": f"""SELECT *, CASE WHEN list_contains(categories_list, 'internet-exposed') THEN 'High' ELSE base END AS likelihood_rating,
      CASE WHEN list_contains(categories_list, 'internet-exposed') THEN 'Category ''internet-exposed'' forces High (base ' || base
        || ' from severity ''' || coalesce(lower(raw_severity), '') || ''')'
        ELSE 'Severity ''' || coalesce(lower(raw_severity), '') || ''' gives ' || base END AS likelihood_reason,
      check_id || ':' || output_section AS output_group_key,
      CASE WHEN count(*) OVER (PARTITION BY run_id, check_id) = 1 THEN check_id ELSE check_id || ':' || output_section END AS member_key,
      row_number() OVER (PARTITION BY run_id ORDER BY output_section, {_RANK.format("lower(raw_severity)")}, check_id) AS group_order
      FROM (SELECT *, CASE lower(raw_severity) WHEN 'critical' THEN 'High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium'
        WHEN 'low' THEN 'Low' WHEN 'informational' THEN 'Low' ELSE 'Medium' END AS base FROM reps)""",
    "accounts": """SELECT run_id, check_id, output_section, account, row_number() OVER (PARTITION BY run_id, check_id, output_section ORDER BY f) AS pos
      FROM (SELECT run_id, check_id, output_section, raw_account_name AS account, min(row_seq) AS f FROM work GROUP BY ALL)""",
    "chunks": """SELECT *, (rn - 1) // size + 1 AS chunk_no, (rn - 1) % size + 1 AS chunk_pos, (total + size - 1) // size AS chunk_count FROM (
      SELECT *, CASE WHEN total <= 20 THEN total ELSE 15 END AS size FROM (
        SELECT * EXCLUDE (rn), count(*) OVER (PARTITION BY run_id) AS total, row_number() OVER (PARTITION BY run_id ORDER BY
          coalesce(list_min(categories_list), 'zzz_none'), lower(coalesce(raw_service_name, 'zzz_none')), check_id, output_section) AS rn FROM grp))""",
    "cm": """SELECT *, dense_rank() OVER (PARTITION BY run_id, chunk_no ORDER BY group_name) AS group_pos FROM (
      SELECT run_id, chunk_no, coalesce(raw_service_name, 'none') AS group_name, member_key FROM chunks WHERE chunk_pos % 7 <> 0
      UNION ALL SELECT run_id, chunk_no, 'repeated', member_key FROM chunks WHERE chunk_pos % 5 = 0
      UNION ALL SELECT run_id, chunk_no, 'ghosts', 'ghost_' || chunk_no FROM chunks WHERE chunk_pos = 1)""",
    "missing": "SELECT run_id, chunk_no, member_key FROM chunks EXCEPT SELECT run_id, chunk_no, member_key FROM cm",
    "unexpected": "SELECT run_id, chunk_no, member_key FROM cm EXCEPT SELECT run_id, chunk_no, member_key FROM chunks",
    "doubled": "SELECT run_id, chunk_no, member_key, count(*) AS times FROM cm GROUP BY ALL HAVING count(*) > 1",
    "members": """SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY group_name) AS group_no, group_name,
      'Same fix: ' || group_name AS rationale, row_number() OVER (PARTITION BY run_id, group_name ORDER BY member_key) AS pos, member_key
      FROM (SELECT run_id, coalesce(raw_service_name, 'none') || ' / ' || coalesce(list_min(categories_list), 'none') AS group_name, member_key FROM grp)""",
    "approved": """SELECT *, CASE WHEN group_no % 4 = 0 THEN 'Low' WHEN group_no % 7 = 0 THEN 'Critical' ELSE '' END AS risk_rating_override FROM (
      SELECT * FROM members UNION ALL
      SELECT run_id, group_no, group_name, rationale, 0, 'ghost_' || group_no FROM members WHERE pos = 1 AND group_no % 3 = 0)""",
    "att": """SELECT m.group_no, m.group_name, m.rationale, m.member_key AS mk, g.*,
      row_number() OVER (PARTITION BY m.run_id, m.group_no ORDER BY m.pos, g.output_group_key) AS member_pos
      FROM members m JOIN grp g ON m.run_id = g.run_id AND m.member_key IN (g.check_id, g.output_group_key)""",
    "merged": f"""SELECT run_id, group_no, group_name, rationale, count(*) AS member_count, sum(instance_count)::BIGINT AS instance_count,
      arg_min(output_section, member_pos) AS output_section,
      arg_min(sev, {_RANK.format("sev")} * 100000 + member_pos) AS severity,
      arg_min(likelihood_rating, {_LRANK.format("likelihood_rating")} * 100000 + member_pos) AS likelihood_rating,
      arg_min({{'id': finding_instance_id, 'check_id': check_id, 'section': output_section, 'title': raw_check_title, 'sev': raw_severity}},
        (5 - completeness_score) * 10000000 + {_RANK.format("sev")} * 100000 + member_pos) AS rep,
      string_agg(mk, ', ' ORDER BY member_pos) AS check_ids, count(*) > 1 AS is_merged
      FROM (SELECT *, lower(coalesce(raw_severity, 'informational')) AS sev FROM att) GROUP BY run_id, group_no, group_name, rationale""",
    "maccounts": """SELECT run_id, group_no, account, row_number() OVER (PARTITION BY run_id, group_no ORDER BY f) AS pos FROM (
      SELECT t.run_id, t.group_no, a.account, min(t.member_pos * 100000 + a.pos) AS f FROM att t JOIN accounts a
      ON t.run_id = a.run_id AND t.check_id = a.check_id AND t.output_section = a.output_section GROUP BY ALL)""",
    "asked": """SELECT *, length(rep.check_id) AS n, rep.check_id AS rc, CASE WHEN group_no % 4 = 0 THEN 'Low' WHEN group_no % 7 = 0 THEN 'Critical' END AS risk_override
      FROM merged""",
    "enriched": f"""SELECT *, n % 7 = 0 AS failed, CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 2 ELSE 1 END AS attempt,
      CASE WHEN n % 7 = 0 THEN '[REQUIRES_HUMAN_INPUT] ' || coalesce(rep.title, 'Unknown check') ELSE 'Finding ' || rc END AS finding_title,
      CASE WHEN n % 7 = 0 THEN '[REQUIRES_HUMAN_INPUT: root_cause_narrative]' ELSE 'Cause of ' || rc || '.' END AS root_cause,
      CASE WHEN n % 7 = 0 THEN '[REQUIRES_HUMAN_INPUT: situation_narrative]' ELSE 'Situation of ' || rc || '.' END AS situation,
      CASE WHEN n % 7 = 0 THEN '[REQUIRES_HUMAN_INPUT: consequence_narrative]' ELSE 'Consequence of ' || rc || '.' END AS consequence,
      CASE WHEN n % 7 = 0 THEN '[REQUIRES_HUMAN_INPUT: access_required]' ELSE 'Any user.' END AS access_required,
      cr AS consequence_rating, {_MATRIX.format(l="likelihood_rating", c="cr")} AS matrix_risk,
      CASE WHEN n % 7 = 0 THEN risk_override ELSE coalesce(risk_override, {_MATRIX.format(l="likelihood_rating", c="cr")}) END AS risk_rating,
      CASE WHEN n % 7 = 0 THEN 'Enrichment failed after 2 attempt(s): TimeoutError: no answer for ' || rc END AS failure_reason,
      CASE WHEN n % 7 = 0 THEN 'Placeholders written. Enrichment failed after 2 attempt(s): TimeoutError: no answer for ' || rc
        WHEN n % 2 = 0 THEN 'Uncertainty flagged on one or more fields' END AS enrichment_review
      FROM (SELECT *, CASE WHEN n % 7 = 0 THEN 'Moderate' ELSE ['Minor', 'Moderate', 'Major'][(n % 3 + 1)::INT] END AS cr FROM asked)""",
    "lines": """SELECT run_id, group_no, row_number() OVER (PARTITION BY run_id, group_no ORDER BY mp, f) AS pos, line FROM (
      SELECT run_id, group_no, line, min(member_pos) AS mp, arg_min(f, member_pos) AS f FROM (
        SELECT w.run_id, t.group_no, t.member_pos, w.resource_uid_normalised || ' (' || w.raw_account_name || ')' AS line, min(w.row_seq) AS f
        FROM work w JOIN att t ON t.run_id = w.run_id AND t.check_id = w.check_id AND t.output_section = w.output_section
        WHERE w.resource_uid_normalised <> '' GROUP BY ALL) GROUP BY ALL)""",
    "recs": """SELECT run_id, group_no, CASE WHEN count(*) > 1 THEN string_agg(coalesce(nullif(raw_check_title, ''), check_id) || ':' || chr(10)
        || coalesce(raw_remediation_recommendation_text, '[See vendor documentation]')
        || coalesce(chr(10) || '  CLI: ' || raw_remediation_code_cli, '') || coalesce(chr(10) || '  Terraform: ' || raw_remediation_code_terraform, ''),
        chr(10) || chr(10) ORDER BY member_pos)
      ELSE max(concat_ws(chr(10), raw_remediation_recommendation_text, 'CLI: ' || raw_remediation_code_cli, 'Terraform: ' || raw_remediation_code_terraform)) END AS recommendations
      FROM att GROUP BY run_id, group_no""",
    "rdetail": """SELECT t.run_id, t.group_no, row_number() OVER (PARTITION BY t.run_id, t.group_no ORDER BY t.member_pos, w.row_seq) AS pos,
      concat_ws('|', w.resource_uid_normalised, coalesce(w.raw_resource_name, ''), w.raw_account_uid, w.raw_account_name, w.region_normalised, w.raw_resource_type, coalesce(w.raw_status_extended, '')) AS line
      FROM work w JOIN att t ON t.run_id = w.run_id AND t.check_id = w.check_id AND t.output_section = w.output_section""",
    "board": """SELECT m.*, 'g' || m.group_no AS group_id, g.group_order, g.raw_check_title FROM members m JOIN grp g ON m.run_id = g.run_id AND m.member_key = g.member_key""",
    "boxes": "SELECT DISTINCT run_id, group_no, group_id, group_name, rationale FROM board",
    "mv": """SELECT * FROM (SELECT run_id, member_key, group_order AS seq, 'g1' AS target FROM board WHERE group_order % 5 = 0
      UNION ALL SELECT run_id, member_key, group_order + 1000, '__unassigned__' FROM board WHERE group_order % 11 = 0
      UNION ALL SELECT run_id, member_key, group_order + 5000, 'gnew' FROM board WHERE group_order = 7)
      WHERE NOT (run_id = 'ASIA' AND seq <= 12)""",
    "moves": "SELECT run_id, member_key, arg_max(target, seq) AS moved_to, max(seq) AS moved_at FROM mv GROUP BY ALL",
    "splitting": """SELECT *, count(*) OVER (PARTITION BY run_id, group_no) > 1 AS parted FROM board b WHERE group_no % 6 = 4
      AND NOT EXISTS (SELECT 1 FROM mv WHERE mv.run_id = b.run_id AND mv.member_key = b.member_key AND mv.seq < b.group_no + 600)""",
    "split_boxes": "SELECT * FROM splitting WHERE parted AND group_order % 13 <> 2",
    "last_move": """SELECT b.run_id, b.member_key, s.group_id, b.group_order FROM board b
      JOIN (SELECT run_id, 'split:' || min(member_key) AS group_id FROM board WHERE group_no = 4 GROUP BY run_id) s ON b.run_id = s.run_id
      JOIN split_boxes x ON x.run_id = s.run_id AND 'split:' || x.member_key = s.group_id WHERE b.group_order = 2""",
    "assignment": """SELECT p.run_id, p.member_key, coalesce(CASE WHEN l.group_id IS NOT NULL THEN 50000 END, moved_at) AS moved_at, CASE
        WHEN l.group_id IS NOT NULL THEN l.group_id
        WHEN gid LIKE 'g%' AND no % 6 = 5 AND no + 500 > coalesce(moved_at, -1) THEN '__unassigned__'
        WHEN s.parted AND no + 600 > coalesce(moved_at, -1) THEN CASE WHEN s.group_order % 13 = 2 THEN '__unassigned__' ELSE 'split:' || p.member_key END
        ELSE gid END AS group_id
      FROM (SELECT b.run_id, b.member_key, m.moved_at, coalesce(m.moved_to, b.group_id) AS gid,
        try_cast(substr(coalesce(m.moved_to, b.group_id), 2) AS BIGINT) AS no
        FROM board b LEFT JOIN moves m ON b.run_id = m.run_id AND b.member_key = m.member_key) p
      LEFT JOIN splitting s ON s.run_id = p.run_id AND s.member_key = p.member_key LEFT JOIN last_move l ON l.run_id = p.run_id AND l.member_key = p.member_key""",
    "bgroups": """SELECT run_id, group_id, CASE WHEN group_no % 2 = 0 THEN 'Renamed ' || group_no ELSE group_name END AS group_name,
      CASE WHEN group_no % 3 = 1 THEN 'Edited ' || group_no ELSE rationale END AS rationale,
      CASE WHEN group_no % 3 = 0 THEN CASE WHEN group_no % 2 = 0 THEN 'Low' ELSE 'Critical' END END AS risk_rating_override FROM boxes
      WHERE group_no % 6 <> 5 AND (run_id, group_no) NOT IN (SELECT (run_id, group_no) FROM splitting WHERE parted)
      UNION ALL SELECT DISTINCT run_id, 'gnew', 'New Group — rename me', '', NULL FROM boxes
      UNION ALL SELECT run_id, 'split:' || member_key, CASE WHEN group_order % 3 = 0 THEN 'Own ' || group_order ELSE coalesce(nullif(trim(raw_check_title), ''), member_key) END,
        'Split from: ' || group_name, CASE WHEN group_order % 4 = 1 THEN 'High' END FROM split_boxes""",
    "warn": """SELECT run_id, 'ingest' AS stage, w.code AS code, w.message AS message, row_no, raw_check_id AS check_id, finding_instance_id AS finding_id FROM (
      SELECT *, unnest([x FOR x IN [
        CASE WHEN muted_reconciled THEN {'code': 'MUTED_STATUS_RECONCILED', 'message': 'MUTED=True overrides STATUS=''' || raw_status || ''': now ''' || scanner_status || ''''} END,
        CASE WHEN unknown_status THEN {'code': 'UNKNOWN_STATUS', 'message': 'Unrecognised STATUS value ''' || raw_status || '''. Set to UNKNOWN.'} END,
        CASE WHEN len(blank_fields) > 0 THEN {'code': 'DATA_QUALITY_BLANK', 'message': 'Row ' || row_no || ': blank data quality fields: ['
          || array_to_string(['''' || y || '''' FOR y IN blank_fields], ', ') || ']'} END,
        CASE WHEN arn_fallback_used AND raw_resource_name IS NOT NULL THEN {'code': 'ARN_FALLBACK', 'message': 'Row ' || row_no
          || ': no RESOURCE_UID, RESOURCE_NAME=''' || raw_resource_name || ''' used instead'} END,
        CASE WHEN raw_check_id IS NULL THEN {'code': 'EMPTY_CHECK_ID', 'message': 'Row ' || row_no || ': no CHECK_ID, grouped as ''unknown'''} END
      ] IF x IS NOT NULL]) AS w FROM norm)""",
    "codes": """SELECT run_id, stage, code, count(*) AS warnings FROM (SELECT run_id, stage, code FROM warn
      UNION ALL SELECT run_id, 'review', 'UNKNOWN_CHECK_ID' FROM approved WHERE pos = 0) GROUP BY ALL""",
    "counts": """SELECT run_id, count(*) AS total_findings, count(*) FILTER (report_inclusion = 'INCLUDED') AS included,
      count(*) FILTER (report_inclusion = 'EXCLUDED' AND NOT is_duplicate) AS excluded, count(*) FILTER (is_duplicate) AS duplicates,
      count(DISTINCT CASE WHEN report_inclusion = 'INCLUDED' THEN check_id || ':' || output_section END) AS output_groups FROM proc GROUP BY run_id""",
    "audit": """SELECT run_id, finding_instance_id, e.* FROM (SELECT *, unnest([x FOR x IN [
        CASE WHEN muted_reconciled THEN {'stage_no': 1, 'seq': 0, 'stage': 'ingest', 'field': 'scanner_status', 'old_value': raw_status,
          'new_value': scanner_status, 'reason': 'MUTED=True overrode STATUS column value'} END,
        CASE WHEN review_reason IS NOT NULL THEN {'stage_no': 1, 'seq': 1, 'stage': 'ingest', 'field': 'human_review_required', 'old_value': 'false',
          'new_value': 'true', 'reason': review_reason} END,
        CASE WHEN report_inclusion = 'EXCLUDED' AND NOT is_duplicate THEN {'stage_no': 2, 'seq': 0, 'stage': 'status_filter', 'field': 'report_inclusion',
          'old_value': 'INCLUDED', 'new_value': 'EXCLUDED', 'reason': exclusion_reason} END,
        CASE WHEN is_duplicate THEN {'stage_no': 2, 'seq': 1, 'stage': 'dedup', 'field': 'report_inclusion',
          'old_value': 'INCLUDED', 'new_value': 'EXCLUDED', 'reason': exclusion_reason} END,
        CASE WHEN is_duplicate THEN {'stage_no': 2, 'seq': 2, 'stage': 'dedup', 'field': 'is_duplicate', 'old_value': 'false', 'new_value': 'true',
          'reason': 'dedup_key=''' || dedup_key || ''' already seen; primary=' || duplicate_of} END,
        CASE WHEN report_inclusion = 'INCLUDED' THEN {'stage_no': 2, 'seq': 3, 'stage': 'check_grouping', 'field': 'output_section', 'old_value': '',
          'new_value': output_section, 'reason': 'provider=''' || coalesce(raw_provider, 'None') || ''' service=''' || raw_service_name || ''' -> section='''
          || output_section || ''''} END] IF x IS NOT NULL]) AS e FROM proc)""",
    "crow0": f"""SELECT * REPLACE (coalesce(nullif(trim(tenant_id), ''), 'UNKNOWN-TENANT') AS tenant_id),
      coalesce({_clean_control("raw_control_id")}, '') AS control_id,
      {_html(_clean_control("raw_requirement"))} AS check_title, {_clean_control("raw_requirement")} IS NOT NULL AS has_req,
      nullif({_html(_clean_control("raw_details"))}, '') AS details, {_clean_control("raw_original_result")} AS original_result,
      CASE lower(trim(raw_result)) WHEN 'fail' THEN 'FAIL' WHEN 'pass' THEN 'PASS' ELSE 'UNKNOWN' END AS scanner_status,
      {_clean_control("raw_result")} AS result, coalesce({_clean_control("raw_criticality")}, '') AS crit FROM controls_raw""",
    "crow1": """SELECT *, sha256(run_id || ':' || row_seq) AS finding_instance_id,
      CASE WHEN crit = '' THEN 'medium' WHEN crit IN ('Shall', 'Shall/3rd Party', 'Shall/Not Implemented') THEN 'high' WHEN crit = 'Should' THEN 'medium'
        WHEN crit = 'May' THEN 'low' WHEN lower(crit) LIKE 'shall%' THEN 'high' WHEN lower(crit) LIKE 'should%' THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN details IS NULL THEN 1 ELSE greatest(coalesce(try_cast(nullif(regexp_extract(details, '\\b(\\d+)\\s+\\w+\\(s\\)', 1), '') AS BIGINT), 1), 1) END AS instance_count,
      CASE WHEN split_part(upper(control_id), '.', 1) = 'MS' AND split_part(upper(control_id), '.', 2) IN ('AAD', 'DEFENDER', 'EXCHANGE', 'SHAREPOINT', 'TEAMS', 'POWERPLATFORM')
        THEN 'MS.' || split_part(upper(control_id), '.', 2) ELSE 'UNKNOWN' END AS service_prefix,
      'azure:' || tenant_id || ':' || control_id AS stable_key, left(sha256('azure|' || tenant_id || '|' || control_id), 16) AS dedup_key FROM crow0""",
    "crow": """SELECT *, CASE service_prefix WHEN 'MS.AAD' THEN 'Microsoft Entra ID (previously Azure Active Directory)' WHEN 'MS.DEFENDER' THEN 'Microsoft 365 Defender'
        WHEN 'MS.EXCHANGE' THEN 'Microsoft Exchange Online' WHEN 'MS.SHAREPOINT' THEN 'Microsoft SharePoint Online' WHEN 'MS.TEAMS' THEN 'Microsoft Teams'
        WHEN 'MS.POWERPLATFORM' THEN 'Microsoft Power Platform' ELSE 'Azure Resources' END AS output_section,
      CASE service_prefix WHEN 'MS.AAD' THEN 'Entra ID' WHEN 'MS.DEFENDER' THEN 'Defender' WHEN 'MS.EXCHANGE' THEN 'Exchange Online'
        WHEN 'MS.SHAREPOINT' THEN 'SharePoint Online' WHEN 'MS.TEAMS' THEN 'Teams' WHEN 'MS.POWERPLATFORM' THEN 'Power Platform' ELSE 'Azure Resources' END AS service_name,
      CASE service_prefix WHEN 'MS.AAD' THEN 'ENT' WHEN 'MS.DEFENDER' THEN 'DEF' WHEN 'MS.EXCHANGE' THEN 'EXC' WHEN 'MS.SHAREPOINT' THEN 'SPT'
        WHEN 'MS.TEAMS' THEN 'TEA' WHEN 'MS.POWERPLATFORM' THEN 'PPL' ELSE 'M365' END AS ref_prefix,
      CASE severity WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END AS likelihood_rating,
      has_req::BIGINT + (details IS NOT NULL)::BIGINT + (check_title <> '')::BIGINT + (crit <> '')::BIGINT + (control_id <> '')::BIGINT AS completeness_score,
      CASE WHEN control_id = '' THEN 'Control ID blank — excluded from report' WHEN scanner_status = 'PASS' THEN 'Status=PASS — passing controls excluded from report'
        WHEN scanner_status = 'UNKNOWN' THEN 'Status=UNKNOWN — unrecognised result value ''' || coalesce(result, 'None') || ''''
        WHEN crit <> '' AND crit NOT IN ('Shall', 'Shall/3rd Party', 'Shall/Not Implemented') THEN 'Criticality=''' || crit
          || ''' not in include_criticality=[''Shall'', ''Shall/3rd Party'', ''Shall/Not Implemented'']' END AS filter_reason FROM crow1""",
    "cproc": """SELECT *, rn > 1 AS is_duplicate, CASE WHEN rn > 1 THEN pid END AS duplicate_of,
      CASE WHEN rn > 1 OR filter_reason IS NOT NULL THEN 'EXCLUDED' ELSE 'INCLUDED' END AS report_inclusion FROM (
      SELECT *, row_number() OVER w AS rn, first_value(finding_instance_id) OVER w AS pid FROM crow
      WINDOW w AS (PARTITION BY run_id, dedup_key ORDER BY (filter_reason IS NOT NULL), row_seq))""",
    "cgrp": f"""SELECT *, control_id AS check_id, control_id || ':' || tenant_id AS output_group_key,
      CASE WHEN count(*) OVER (PARTITION BY run_id, control_id) = 1 THEN control_id ELSE control_id || ':' || tenant_id END AS member_key,
      row_number() OVER (PARTITION BY run_id ORDER BY {_SECRANK.format("output_section")}, {_CRANK.format("severity")}, control_id, row_seq) AS group_order,
      row_number() OVER (PARTITION BY run_id, output_section ORDER BY {_CRANK.format("severity")}, control_id, row_seq) AS ref_number
      FROM cproc WHERE report_inclusion = 'INCLUDED'""",
    "catt": """SELECT *, row_number() OVER (PARTITION BY run_id, group_no ORDER BY member_key) AS member_pos FROM (
      SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY group_name) AS group_no FROM (SELECT *, service_name || ' / ' || severity AS group_name FROM cgrp))""",
    "cmerged": f"""SELECT run_id, group_no, group_name, count(*) AS member_count, sum(instance_count)::BIGINT AS instance_count,
      arg_min(output_section, member_pos) AS output_section, arg_min(severity, {_CRANK.format("severity")} * 100000 + member_pos) AS severity,
      arg_min(likelihood_rating, {_LRANK.format("likelihood_rating")} * 100000 + member_pos) AS likelihood_rating, count(*) > 1 AS is_merged,
      arg_min(ref_prefix, member_pos) AS first_ref_prefix,
      string_agg(member_key, ', ' ORDER BY member_pos) AS ids,
      arg_min({{'check_id': check_id, 'title': check_title, 'id': finding_instance_id, 'lk': likelihood_rating}}, (5 - completeness_score) * 10000000 + {_CRANK.format("severity")} * 100000 + member_pos) AS rep
      FROM catt GROUP BY run_id, group_no, group_name""",
    "cenriched": f"""SELECT *, {_MATRIX.format(l="likelihood_rating", c="cr")} AS mr,
      row_number() OVER (PARTITION BY run_id, output_section ORDER BY {_CRANK.format("severity")}, group_name, group_no) AS ref_number FROM (
      SELECT *, n % 7 = 0 AS failed, CASE WHEN n % 7 = 0 THEN 'Moderate' ELSE ['Minor', 'Moderate', 'Major'][(n % 3 + 1)::INT] END AS cr FROM (
        SELECT *, rep.check_id AS rc, length(rep.check_id) AS n FROM cmerged))""",
    "placed": "SELECT section, row_number() OVER () - 1 AS place FROM csections",
    "csections": """SELECT unnest(['Microsoft Entra ID (previously Azure Active Directory)', 'Microsoft 365 Defender', 'Microsoft Exchange Online',
      'Microsoft SharePoint Online', 'Microsoft Teams', 'Microsoft Power Platform', 'Azure Resources']) AS section""",
}

_RISK_CELL = "coalesce(risk_rating, 'Medium')"


def _safe(expr: str) -> str:
    return f"CASE WHEN regexp_matches(trim(coalesce({expr}, '')), '^[=+\\-@]') THEN ' ' ELSE '' END || trim(coalesce({expr}, ''))"


def _needs(sql: str, seen: list[str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needs(CTES[name], seen)
            if name not in seen:
                seen.append(name)


def with_ctes(sql: str) -> str:
    """A statement with the building blocks it needs, in dependency order."""
    seen: list[str] = []
    _needs(sql, seen)
    if not seen:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in seen) + "\n" + sql


_CSV_FIELDS = (
    "run_id || '#' || row_no AS raw_notes, raw_provider, raw_account_name, raw_check_id, raw_status, raw_severity, raw_resource_uid, "
    "raw_region, trim(raw_compliance) AS raw_compliance, raw_categories, raw_resource_tags"
)

SELECTS = {
    "status_reconcile": "SELECT run_id, row_no, raw_status, raw_muted, scanner_status, muted_reconciled, unknown_status FROM norm",
    "status_breakdown": "SELECT run_id, scanner_status, count(*) AS findings FROM norm GROUP BY ALL",
    "muted_overrides": "SELECT run_id, row_no, source_row_id, raw_check_id, raw_status, scanner_status FROM norm WHERE muted_reconciled",
    "blank_classes": "SELECT run_id, row_no, blank_description, blank_risk, blank_remediation, blank_region FROM norm",
    "blank_breakdown": """SELECT run_id, count(*) FILTER (blank_description = 'DATA_QUALITY') AS description_blank, count(*) FILTER (blank_risk = 'DATA_QUALITY') AS risk_blank,
      count(*) FILTER (blank_remediation = 'DATA_QUALITY') AS remediation_blank, count(*) FILTER (blank_region = 'STRUCTURAL') AS region_structural FROM norm GROUP BY run_id""",
    "review_flags": "SELECT run_id, row_no, review_reason IS NOT NULL AS human_review_required, review_reason FROM norm",
    "resource_normalise": "SELECT run_id, row_no, resource_uid_normalised, arn_fallback_used, region_normalised FROM norm",
    "stable_keys": "SELECT run_id, row_no, stable_finding_key FROM norm",
    "dedup_keys": "SELECT run_id, row_no, dedup_key FROM norm",
    "finding_ids": "SELECT run_id, row_no, finding_instance_id, source_row_id FROM norm",
    "pipe_lists": "SELECT run_id, row_no, unnest(range(len(categories_list))) AS pos, unnest(categories_list) AS category FROM norm",
    "tag_maps": """SELECT run_id, row_no, tag_key, CASE WHEN contains(item, ':') THEN trim(substr(item, strpos(item, ':') + 1)) ELSE '' END AS tag_value FROM (
      SELECT *, trim(split_part(item, ':', 1)) AS tag_key, row_number() OVER (PARTITION BY kind, run_id, row_no, trim(split_part(item, ':', 1)) ORDER BY i DESC) AS rn FROM (
        SELECT 'r' AS kind, run_id, row_no, unnest(range(len(l))) AS i, unnest(l) AS item FROM (SELECT run_id, row_no, [trim(x) FOR x IN string_split(raw_resource_tags, '|') IF trim(x) <> ''] AS l FROM raw)
        UNION ALL SELECT 'a', run_id, row_no, 0, raw_account_tags FROM raw)) WHERE rn = 1""",
    "compliance_values": """SELECT run_id, row_no, len(l) > 0 AS compliance_parsed, unnest(range(greatest(len(l), 1))) AS pos,
      unnest(CASE WHEN len(l) > 0 THEN l ELSE [trim(raw_compliance)] END) AS item
      FROM (SELECT *, [trim(x) FOR x IN string_split(raw_compliance, '|') IF trim(x) <> ''] AS l FROM raw)""",
    "completeness_scores": "SELECT run_id, row_no, completeness_score FROM norm",
    "ingest_warnings": "SELECT * FROM warn",
    "scanner_versions": "SELECT run_id, arg_min(raw_prowler_version, row_seq) AS scanner_version FROM raw WHERE raw_prowler_version IS NOT NULL GROUP BY run_id",
    "column_aliases": """SELECT p_partkey, header, CASE header WHEN 'account_arn' THEN 'ACCOUNT_ORGANIZATION_UID' WHEN 'account_id' THEN 'ACCOUNT_UID'
      WHEN 'account_org' THEN 'ACCOUNT_ORGANIZATION_UID' WHEN 'assessment_start_time' THEN 'TIMESTAMP' WHEN 'finding_unique_id' THEN 'FINDING_UID'
      WHEN 'profile' THEN 'AUTH_METHOD' WHEN 'resource_arn' THEN 'RESOURCE_UID' WHEN 'resource_id' THEN 'RESOURCE_NAME'
      ELSE replace(upper(header), 'REMEDIATION_RECOMMENDATION_CODE', 'REMEDIATION_CODE') END AS column_name FROM (SELECT p_partkey, ['account_arn', 'account_id', 'account_org',
      'assessment_start_time', 'finding_unique_id', 'profile', 'remediation_recommendation_code_cli', 'remediation_recommendation_code_nativeiac',
      'remediation_recommendation_code_other', 'remediation_recommendation_code_terraform', 'resource_arn', 'resource_id'][p_size % 12 + 1] AS header FROM part)""",
    "unknown_columns": """SELECT run_id, 'ingest' AS stage, 'UNKNOWN_COLUMNS' AS code, 'Found ' || count(*) || ' unknown column(s), kept in extra_fields: ['
      || string_agg('''' || c || '''', ', ' ORDER BY c) || ']' AS message, NULL::BIGINT AS row_no, NULL::VARCHAR AS check_id, NULL::VARCHAR AS finding_id
      FROM (SELECT DISTINCT run_id, 'future_' || lower(raw_check_type) AS c FROM raw) GROUP BY run_id""",
    "client_slugs": """SELECT s_suppkey, left(translate(lower(s_name || ' / Ltd. & Söhne'), ' /', '__'), 40) AS slug,
      regexp_replace(regexp_replace(regexp_replace(s_name || ' / Ltd. & Söhne', '\\s+', '_', 'g'), '[^\\p{L}\\p{N}_\\-.]', '', 'g'), '_+', '_', 'g') AS folder FROM supplier""",
    "sanitise_cells": f"SELECT run_id, row_no, {_safe('raw_remediation_code_terraform')} AS cell FROM raw",
    "status_filter": "SELECT run_id, row_no, CASE WHEN keep THEN 'INCLUDED' ELSE 'EXCLUDED' END AS report_inclusion, filter_reason AS exclusion_reason FROM filt",
    "dedup_findings": "SELECT run_id, row_no, is_duplicate, duplicate_of, report_inclusion, exclusion_reason FROM proc",
    "duplicate_links": "SELECT run_id, finding_instance_id, duplicate_of, raw_check_id FROM proc WHERE is_duplicate",
    "excluded_listing": "SELECT run_id, row_no, raw_check_id, raw_account_name, scanner_status, exclusion_reason FROM proc WHERE report_inclusion = 'EXCLUDED' AND NOT is_duplicate",
    "run_counts": "SELECT * FROM counts",
    "section_assign": "SELECT run_id, row_no, check_id, output_section FROM proc",
    "check_groups": "SELECT run_id, check_id, output_section, instance_count, row_seq AS representative_seq FROM reps",
    "representatives": """SELECT run_id, check_id, output_section, row_no, finding_instance_id, completeness_score, instance_count, raw_severity, raw_check_title,
      raw_account_name, resource_uid_normalised FROM grp""",
    "ordered_groups": "SELECT run_id, group_order, output_group_key, member_key, check_id, output_section, instance_count FROM grp",
    "group_export": """SELECT run_id, group_order, output_group_key, instance_count, likelihood_rating, finding_instance_id, source_row_id, raw_check_title AS check_title,
      raw_severity AS severity, raw_service_name AS service_name, raw_resource_type AS resource_type, region_normalised AS region, completeness_score,
      raw_description IS NOT NULL AS has_description, raw_risk IS NOT NULL AS has_risk, raw_remediation_recommendation_text IS NOT NULL AS has_remediation,
      review_reason IS NOT NULL AS human_review_required FROM grp""",
    "finding_export": """SELECT run_id, finding_instance_id, stable_finding_key, dedup_key, source_row_id, report_inclusion, duplicate_of, region_normalised,
      raw_check_id AS check_id, raw_status AS status FROM proc""",
    "group_accounts": "SELECT * FROM accounts",
    "group_account_uids": """SELECT run_id, check_id, output_section, account, row_number() OVER (PARTITION BY run_id, check_id, output_section ORDER BY f) AS pos
      FROM (SELECT run_id, check_id, output_section, raw_account_uid AS account, min(row_seq) AS f FROM work GROUP BY ALL)""",
    "group_instances": "SELECT run_id, check_id, output_section, row_seq, finding_instance_id FROM work",
    "likelihood": "SELECT run_id, check_id, output_section, likelihood_rating, likelihood_reason FROM grp",
    "likelihood_distribution": """SELECT run_id, count(*) FILTER (likelihood_rating = 'High') AS high, count(*) FILTER (likelihood_rating = 'Medium') AS medium,
      count(*) FILTER (likelihood_rating = 'Low') AS low FROM grp GROUP BY run_id""",
    "section_counts": "SELECT run_id, output_section, count(*) AS groups FROM grp GROUP BY ALL",
    "top_k_review": """SELECT run_id, row_no, raw_check_id, review_reason, pos, greatest(n - 10, 0) AS more FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n,
      row_number() OVER (PARTITION BY run_id ORDER BY row_seq) AS pos FROM norm WHERE review_reason IS NOT NULL) WHERE pos <= 10""",
    "top_k_fallbacks": """SELECT run_id, row_no, raw_check_id, resource_uid_normalised, pos, greatest(n - 5, 0) AS more FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n,
      row_number() OVER (PARTITION BY run_id ORDER BY row_seq) AS pos FROM norm WHERE arn_fallback_used AND resource_uid_normalised <> '') WHERE pos <= 5""",
    "chunk_assign": "SELECT run_id, member_key, chunk_no, chunk_pos, chunk_count FROM chunks",
    "running_names": """SELECT c.run_id, c.chunk_no, coalesce(string_agg(f.group_name, ';' ORDER BY f.s), '') AS existing_names
      FROM (SELECT DISTINCT run_id, chunk_no FROM cm) c LEFT JOIN (SELECT run_id, group_name, min(chunk_no * 1000 + group_pos) AS s FROM cm GROUP BY ALL) f
      ON c.run_id = f.run_id AND f.s < c.chunk_no * 1000 GROUP BY ALL""",
    "proposal_missing": "SELECT * FROM missing",
    "proposal_unexpected": "SELECT * FROM unexpected",
    "proposal_duplicates": "SELECT * FROM doubled",
    "partition_check": """SELECT *, 'missing' AS fault FROM missing UNION ALL SELECT *, 'unknown' FROM unexpected
      UNION ALL SELECT run_id, chunk_no, member_key, 'duplicate' FROM doubled""",
    "merged_groups": f"""SELECT run_id, group_no, row_number() OVER (PARTITION BY run_id ORDER BY output_section, {_RANK.format("severity")}, group_name, group_no) AS group_order,
      group_name, output_section, severity, likelihood_rating, instance_count, member_count, is_merged, check_ids FROM merged""",
    "best_representative": "SELECT run_id, group_no, rep.id AS finding_instance_id, rep.check_id AS check_id FROM merged",
    "affected_resources": """SELECT run_id, group_no, resource, resource_name, resource_type, account_name, account_uid, region, check_id,
      row_number() OVER (PARTITION BY run_id, group_no ORDER BY member_pos) AS pos FROM (
      SELECT run_id, group_no, member_pos, resource_uid_normalised AS resource, coalesce(raw_resource_name, '') AS resource_name, raw_resource_type AS resource_type,
        raw_account_name AS account_name, raw_account_uid AS account_uid, region_normalised AS region, check_id,
        row_number() OVER (PARTITION BY run_id, group_no, resource_uid_normalised ORDER BY member_pos) AS n FROM att WHERE resource_uid_normalised <> '') WHERE n = 1""",
    "merged_accounts": "SELECT * FROM maccounts",
    "merged_instances": """SELECT w.run_id, t.group_no, t.member_pos, w.row_seq, w.finding_instance_id FROM work w JOIN att t
      ON t.run_id = w.run_id AND t.check_id = w.check_id AND t.output_section = w.output_section""",
    "trivial_groups": "SELECT run_id, group_order AS group_no, check_id AS group_name, member_key FROM grp",
    "grouping_stats": """SELECT g.run_id, original_count, merged_count, merges_applied, chunks_used, original_count - merged_count AS reduction
      FROM (SELECT run_id, count(*) AS original_count FROM grp GROUP BY run_id) g
      JOIN (SELECT run_id, count(*) AS merged_count, count(*) FILTER (is_merged) AS merges_applied FROM merged GROUP BY run_id) m ON g.run_id = m.run_id
      JOIN (SELECT run_id, max(chunk_no) AS chunks_used FROM chunks GROUP BY run_id) c ON g.run_id = c.run_id""",
    "propose_groups": """SELECT run_id, group_name, 'Shared word ' || group_name || '.' AS rationale, member_key FROM (SELECT run_id, member_key,
      CASE WHEN chunk_no = 2 THEN coalesce(raw_check_title, check_id) ELSE regexp_extract(member_key, '^[^_.]*') END AS group_name FROM chunks)""",
    "grouping_warnings": """SELECT DISTINCT run_id, 'CHUNK_GROUPING_FAILED' AS code, 'Chunk 2/' || chunk_count
      || ' failed after retry: Expected a non-empty JSON array of groups. Its checks fall back to standalone groups.' AS message FROM chunks WHERE chunk_no = 2""",
    "regroup_boards": "SELECT run_id, 1::BIGINT AS seq, true AS ok, NULL::VARCHAR AS error, count(DISTINCT group_no) AS groups FROM members GROUP BY run_id",
    "approval_apply": """SELECT run_id, group_no, group_name, output_section, severity, likelihood_rating, instance_count, member_count, is_merged, risk_override FROM asked""",
    "approval_unknown": """SELECT run_id, 'UNKNOWN_CHECK_ID' AS code, 'Approved group ''' || group_name || ''' references unknown check_id ''' || member_key || '''. Skipped.' AS message,
      member_key AS check_id FROM approved WHERE pos = 0""",
    "board_edits": "SELECT run_id, member_key, group_id FROM assignment",
    "board_group_state": "SELECT * FROM bgroups",
    "board_stats": """SELECT run_id, count(*) FILTER (group_id <> '__unassigned__') AS current_groups, count(*) FILTER (group_id <> '__unassigned__' AND n > 1) AS merged,
      count(*) FILTER (group_id <> '__unassigned__' AND n = 1) AS standalone, coalesce(sum(n) FILTER (group_id = '__unassigned__'), 0)::BIGINT AS unassigned
      FROM (SELECT run_id, group_id, count(*) AS n FROM assignment GROUP BY ALL) GROUP BY run_id""",
    "board_cards": f"""SELECT a.run_id, a.group_id, count(DISTINCT a.member_key) AS checks, sum(g.instance_count) FILTER (c.pos = 1)::BIGINT AS instances,
      arg_min(lower(coalesce(g.raw_severity, 'informational')), {_RANK.format("lower(coalesce(g.raw_severity, 'informational'))")}) AS severity, count(DISTINCT c.account) AS accounts
      FROM assignment a JOIN grp g ON a.run_id = g.run_id AND a.member_key = g.member_key
      JOIN accounts c ON c.run_id = g.run_id AND c.check_id = g.check_id AND c.output_section = g.output_section
      WHERE a.group_id <> '__unassigned__' GROUP BY a.run_id, a.group_id""",
    "approval_gate": """SELECT run_id, coalesce(sum(n) FILTER (group_id = '__unassigned__'), 0)::BIGINT AS unassigned, count(*) FILTER (group_id <> '__unassigned__') AS groups,
      0::BIGINT AS unnamed, coalesce(sum(n) FILTER (group_id = '__unassigned__'), 0) = 0 AS can_approve
      FROM (SELECT run_id, group_id, count(*) AS n FROM assignment GROUP BY ALL) GROUP BY run_id""",
    "unassigned_pool": "SELECT run_id, member_key FROM assignment WHERE group_id = '__unassigned__'",
    "approvals_from_board": """SELECT a.run_id, dense_rank() OVER (PARTITION BY a.run_id ORDER BY a.group_id) AS group_no, b.group_name,
      row_number() OVER (PARTITION BY a.run_id, a.group_id ORDER BY coalesce(moved_at, -1), a.member_key) AS pos, a.member_key, b.risk_rating_override
      FROM assignment a LEFT JOIN bgroups b ON a.run_id = b.run_id AND a.group_id = b.group_id WHERE a.group_id <> '__unassigned__'""",
    "carry_forward": """SELECT g.run_id, g.group_no, g.group_name, arg_min(g.output_section, g.pos) AS output_section,
      CASE WHEN count(DISTINCT nullif(a.risk_rating_override, '')) = 1 THEN max(a.risk_rating_override) END AS risk_rating_override,
      count(*) FILTER (g.resource_uid_normalised <> '') AS resources, count(*) > 1 AS is_merged
      FROM (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY group_name) AS group_no, row_number() OVER (PARTITION BY run_id, group_name ORDER BY member_key) AS pos
        FROM (SELECT *, split_part(member_key, '_', 1) AS group_name FROM grp)) g
      JOIN approved a ON a.run_id = g.run_id AND a.member_key = g.member_key WHERE a.pos > 0 GROUP BY ALL""",
    "review_board": """SELECT run_id, group_no, group_name, rationale, member_pos, mk AS member_key, check_id, coalesce(raw_check_title, check_id) AS check_title,
      coalesce(raw_severity, 'unknown') AS severity, instance_count, likelihood_rating AS likelihood, raw_service_name AS service,
      '[' || array_to_string(['''' || x || '''' FOR x IN categories_list], ', ') || ']' AS categories FROM att""",
    "risk_matrix": f"""SELECT *, {_MATRIX.format(l="likelihood_rating", c="consequence_rating")} AS risk_rating FROM (SELECT run_id, check_id, output_section, likelihood_rating,
      ['Minor', 'Moderate', 'Major', 'Unheard'][(instance_count % 4 + 1)::INT] AS consequence_rating FROM grp)""",
    "llm_context": """SELECT m.run_id, m.group_no, m.group_name, m.rep.check_id AS check_id, m.rep.title AS check_title, m.rep.sev AS severity, m.instance_count, m.likelihood_rating,
      (SELECT string_agg(a.account, ';' ORDER BY a.pos) FROM maccounts a WHERE a.run_id = m.run_id AND a.group_no = m.group_no) AS affected_account_names,
      array_to_string(g.categories_list, ';') AS categories FROM merged m JOIN grp g ON g.run_id = m.run_id AND g.finding_instance_id = m.rep.id""",
    "enrich_results": """SELECT run_id, group_no, finding_title, root_cause AS root_cause_narrative, consequence_rating, risk_rating, failed AS enrichment_failed,
      attempt::BIGINT AS attempt, enrichment_review FROM enriched""",
    "risk_distribution": """SELECT run_id, risk_rating, sum(n)::BIGINT AS groups FROM (SELECT run_id, coalesce(risk_rating, 'Unknown') AS risk_rating, count(*) AS n FROM enriched GROUP BY ALL
      UNION ALL SELECT DISTINCT run_id, unnest(['High', 'Medium', 'Low', 'Unknown']), 0 FROM enriched) GROUP BY ALL""",
    "enrich_stats": "SELECT run_id, count(*) AS group_count, count(*) FILTER (NOT failed) AS enriched, count(*) FILTER (failed) AS failed FROM enriched GROUP BY run_id",
    "enrich_warnings": """SELECT run_id, 'LLM_ENRICHMENT_FAILED' AS code, group_name AS check_id, rep.id AS finding_id, '[' || group_name || '] ' || failure_reason AS message
      FROM enriched WHERE failed""",
    "enrich_audit": """SELECT run_id, rep_id AS finding_instance_id, 4::BIGINT AS stage_no, e.seq::BIGINT AS seq, 'enrichment' AS stage, e.field, e.old_value, e.new_value, e.reason, e.actor
      FROM (SELECT run_id, rep.id AS rep_id, unnest([x FOR x IN [
        CASE WHEN failed THEN {'seq': 0, 'field': 'llm_enrichment_failed', 'old_value': 'false', 'new_value': 'true', 'reason': failure_reason, 'actor': 'pipeline'} END,
        CASE WHEN enrichment_review IS NOT NULL THEN {'seq': 1, 'field': 'human_review_required', 'old_value': 'false', 'new_value': 'true', 'reason': enrichment_review, 'actor': 'pipeline'} END,
        CASE WHEN NOT failed THEN {'seq': 2, 'field': 'ai_enriched', 'old_value': 'false', 'new_value': 'true', 'reason': 'Enrichment completed (attempt ' || attempt || '). Model: offline.', 'actor': 'llm'} END,
        CASE WHEN NOT failed THEN {'seq': 3, 'field': 'consequence_rating', 'old_value': NULL, 'new_value': consequence_rating, 'reason': 'Assessed: ' || consequence_rating, 'actor': 'llm'} END,
        CASE WHEN NOT failed AND risk_override IS NOT NULL THEN {'seq': 4, 'field': 'risk_rating', 'old_value': 'analyst_override', 'new_value': risk_rating,
          'reason': 'Analyst override kept; matrix gives ''' || matrix_risk || '''', 'actor': 'pipeline'} END,
        CASE WHEN NOT failed AND risk_override IS NULL THEN {'seq': 4, 'field': 'risk_rating', 'old_value': NULL, 'new_value': risk_rating,
          'reason': 'risk_matrix[''' || likelihood_rating || '_' || consequence_rating || '''] = ''' || risk_rating || '''', 'actor': 'pipeline'} END
      ] IF x IS NOT NULL]) AS e FROM enriched)""",
    "response_json": """SELECT run_id, check_id, output_section, '{"finding_title": "' || CASE WHEN n = 1 THEN repeat('x', 121) ELSE check_id END || '", '
      || CASE WHEN n = 4 THEN '' ELSE '"root_cause_narrative": "c", ' END || '"situation_narrative": "s", "consequence_narrative": "q", "consequence_rating": "'
      || CASE WHEN n = 3 THEN 'Critical' ELSE 'Major' END || '", "access_required": ' || CASE WHEN n = 5 THEN 'null' ELSE '"a"' END || ', "needs_human_review": '
      || CASE WHEN n = 2 THEN '"true"' ELSE 'true' END || '}' AS body FROM (SELECT *, group_order % 8 AS n FROM grp)""",
    "enrich_validate": """SELECT run_id, check_id, output_section, CASE group_order % 8 WHEN 1 THEN 'finding_title is 121 chars, max 120'
      WHEN 2 THEN 'needs_human_review must be boolean true/false, got: "true"' WHEN 3 THEN 'consequence_rating=''Critical'' must be one of: [''Major'', ''Minor'', ''Moderate'']'
      WHEN 4 THEN 'missing field ''root_cause_narrative''' WHEN 5 THEN 'field ''access_required'' is null' ELSE '' END AS errors FROM grp""",
    "request_budget": """SELECT run_id, chunk_no, items, greatest(1000, least(300 + items * 90, 4000)) AS chunk_tokens, greatest(60, 60 + items * 3) AS chunk_seconds,
      greatest(1000, least(800 + items * 7 * 80, 8000)) AS regroup_tokens, greatest(60, 90 + items * 7 * 3) AS regroup_seconds
      FROM (SELECT run_id, chunk_no, count(*) AS items FROM chunks GROUP BY ALL)""",
    "prompt_keys": f"""SELECT run_id, chunk_no, count(*) AS items, greatest(1500, least(300 + count(*) * 90, 4000)) AS max_tokens, greatest(60, 60 + count(*) * 3) AS timeout_seconds,
      sha256('offline::' || '{CHUNK_HEAD}' || chunk_no || ' of ' || chunk_count || '.' || chr(10) || chr(10) || 'Checks:' || chr(10)
        || string_agg('[' || member_key || '] ' || coalesce(raw_check_title, check_id) || ' (severity=' || coalesce(raw_severity, 'None') || ', instances=' || instance_count || ')', chr(10) ORDER BY chunk_pos)
        || '{CHUNK_RULES + ARRAY_ONLY}') AS request_key FROM chunks GROUP BY run_id, chunk_no, chunk_count""",
    "cache_misses": """SELECT DISTINCT sha256('offline::' || check_id) AS request_key, check_id AS prompt FROM grp
      WHERE substr(sha256(check_id), 1, 1) >= '6' """,
    "resource_lines": "SELECT * FROM lines",
    "resource_text": """SELECT run_id, group_no, part_no, CASE WHEN part_no = 0 THEN 'Affected resources:' || chr(10) ELSE '' END
      || string_agg('  • ' || line, chr(10) ORDER BY pos) AS resource_text FROM (SELECT *, (pos - 1) // 20 AS part_no FROM lines) GROUP BY run_id, group_no, part_no""",
    "resource_detail": """SELECT w.run_id, w.check_id, w.output_section, w.row_seq, w.finding_instance_id, w.resource_uid_normalised AS resource_uid,
      coalesce(w.raw_resource_name, '') AS resource_name, w.raw_account_uid AS account_uid, w.raw_account_name AS account_name, w.raw_resource_type AS resource_type,
      coalesce(w.raw_status_extended, '') AS status_extended, w.region_normalised AS region, t.group_no, t.member_pos
      FROM work w JOIN att t ON t.run_id = w.run_id AND t.check_id = w.check_id AND t.output_section = w.output_section""",
    "recommendation_text": "SELECT * FROM recs",
    "report_rows": f"""SELECT e.run_id, e.output_section AS sheet, CASE e.output_section WHEN 'AWS' THEN 0 WHEN 'Azure' THEN 1 ELSE 2 END::BIGINT AS sheet_order,
        e.group_no, e.ref_number, coalesce(t.n, 0) AS affected_resources,
        CASE e.output_section WHEN 'Azure' THEN 'AZ' ELSE e.output_section END || e.ref_number AS ref, {_safe("e.finding_title")} AS finding, {_safe("coalesce(e.risk_rating, 'Medium')")} AS risk_rating,
        {_safe("e.root_cause")} AS root_cause, e.likelihood_rating AS likelihood, e.consequence_rating, e.access_required,
        e.situation AS situation, e.consequence, {_safe("r.recommendations")} AS recommendations
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id, output_section ORDER BY group_no) AS ref_number FROM enriched) e
      LEFT JOIN recs r ON e.run_id = r.run_id AND e.group_no = r.group_no
      LEFT JOIN (SELECT run_id, group_no, count(*) AS n FROM lines GROUP BY run_id, group_no) t ON e.run_id = t.run_id AND e.group_no = t.group_no""",
    "report_meta": """SELECT run_id, 'Acme / North' AS client, '2026' AS period, count(*) AS groups, count(*) FILTER (NOT failed) AS enriched, count(*) FILTER (failed) AS failed
      FROM enriched GROUP BY run_id""",
    "narrative_report": """SELECT run_id, group_no, concat_ws(chr(10), '== ' || group_name || ' ==', 'Section: ' || output_section, 'Severity: ' || coalesce(rep.sev, 'None'),
      'Likelihood: ' || likelihood_rating, 'Consequence: ' || consequence_rating, 'Risk rating: ' || coalesce(risk_rating, 'None'), 'Instances: ' || instance_count,
      'Finding title:' || chr(10) || '  ' || finding_title, 'Root cause:' || chr(10) || '  ' || root_cause, 'Situation:' || chr(10) || '  ' || situation,
      'Consequence:' || chr(10) || '  ' || consequence, 'Access required:' || chr(10) || '  ' || access_required, 'Failed: ' || failure_reason) AS text FROM enriched""",
    "audit_events": """SELECT run_id, finding_instance_id, stage_no::BIGINT AS stage_no, seq::BIGINT AS seq, stage, field, old_value, new_value, reason, 'pipeline' AS actor FROM audit
      UNION ALL SELECT run_id, finding_instance_id, 2, 4, 'check_grouping', 'instance_count', '1', instance_count::VARCHAR,
        'Grouped ' || instance_count || ' instance(s) of check_id=''' || check_id || ''' into one output row', 'pipeline' FROM grp
      UNION ALL SELECT run_id, finding_instance_id, 2, 5, 'likelihood', 'likelihood_rating', NULL, likelihood_rating, likelihood_reason, 'pipeline' FROM grp""",
    "merge_audit": """SELECT m.run_id, m.rep.id AS finding_instance_id, 3::BIGINT AS stage_no, 0::BIGINT AS seq, 'grouping' AS stage, 'semantic_group' AS field, check_ids AS old_value,
        m.group_name AS new_value, 'Semantic merge: ' || m.rationale AS reason, 'llm' AS actor FROM merged m WHERE is_merged
      UNION ALL SELECT m.run_id, m.rep.id, 3, 1, 'grouping', 'likelihood_rating', g.likelihood_rating, m.likelihood_rating,
        'Highest likelihood across merged group: ' || check_ids, 'pipeline' FROM merged m JOIN grp g ON g.run_id = m.run_id AND g.finding_instance_id = m.rep.id""",
    "exclusion_reasons": "SELECT run_id, finding_instance_id, exclusion_reason AS reason FROM proc WHERE exclusion_reason IS NOT NULL",
    "warnings_by_code": "SELECT * FROM codes",
    "run_manifest": """SELECT c.*, '1.0.0' AS schema_version, 'acme___north' AS client_slug, 'FAIL,MUTED(FAIL)' AS include_statuses,
      (SELECT string_agg(stage || ':' || code || ':' || warnings, ';' ORDER BY stage, code) FROM codes w WHERE w.run_id = c.run_id) AS warnings FROM counts c""",
    "ingest_summary": """SELECT run_id, 'status' AS section, scanner_status AS key, count(*) AS value FROM norm GROUP BY ALL
      UNION ALL SELECT run_id, 'warnings', code, count(*) FROM warn GROUP BY ALL
      UNION ALL SELECT run_id, 'blanks', 'description_blank', count(*) FILTER (blank_description = 'DATA_QUALITY') FROM norm GROUP BY run_id
      UNION ALL SELECT run_id, 'blanks', 'risk_blank', count(*) FILTER (blank_risk = 'DATA_QUALITY') FROM norm GROUP BY run_id
      UNION ALL SELECT run_id, 'blanks', 'remediation_blank', count(*) FILTER (blank_remediation = 'DATA_QUALITY') FROM norm GROUP BY run_id
      UNION ALL SELECT run_id, 'blanks', 'region_structural', count(*) FILTER (blank_region = 'STRUCTURAL') FROM norm GROUP BY run_id""",
    "process_summary": """SELECT run_id, 'counts' AS section, unnest(['total_findings', 'included', 'excluded', 'duplicates', 'output_groups']) AS key,
      unnest([total_findings, included, excluded, duplicates, output_groups]) AS value FROM counts
      UNION ALL SELECT run_id, 'likelihood', unnest(['high', 'medium', 'low']), unnest([count(*) FILTER (likelihood_rating = 'High'),
        count(*) FILTER (likelihood_rating = 'Medium'), count(*) FILTER (likelihood_rating = 'Low')]) FROM grp GROUP BY run_id""",
    "csv_scan": f"SELECT raw_risk || '; \"two\"' || chr(10) || 'lines' AS raw_risk, {_CSV_FIELDS} FROM raw",
    "json_scan": f"SELECT {_CSV_FIELDS} FROM raw",
    "nested_flatten": """SELECT run_id, row_no, raw_account_uid AS account_uid, raw_account_name AS account_name, 'a:1 | b:2' AS account_tags, coalesce(raw_provider, 'aws') AS provider,
      raw_check_id AS check_id, raw_check_title AS check_title, coalesce(raw_status, 'UNKNOWN') AS status, raw_muted AS muted, lower(raw_severity) AS severity,
      raw_service_name AS service_name, raw_resource_uid AS resource_uid, coalesce(raw_region, 'cloud-1') AS region, raw_description AS description,
      'u/' || raw_check_id AS remediation_recommendation_url, 'CIS: 1.1 | CIS: ' || raw_check_type || ' | ENS: op' AS compliance, raw_categories AS categories FROM raw""",
    "file_fingerprints": "SELECT page_id, sha256(html) AS fingerprint FROM pages",
    "html_strip": f"SELECT page_id, {_html('html')} AS content FROM pages",
    "instance_count_extract": f"""SELECT run_id, row_no, greatest(coalesce(try_cast(nullif(regexp_extract({_clean_control("raw_details")}, '\\b(\\d+)\\s+\\w+\\(s\\)', 1), '') AS BIGINT), 1), 1) AS instance_count
      FROM controls_raw""",
    "control_rows": """SELECT run_id, row_no, tenant_id, control_id, check_title, scanner_status, severity, likelihood_rating, service_prefix, service_name, output_section, ref_prefix,
      instance_count, completeness_score, stable_key, dedup_key, details AS raw_details, original_result AS raw_original_result, control_id = '' AS human_review_required FROM crow""",
    "service_resolve": "SELECT run_id, row_no, service_prefix, output_section, ref_prefix FROM crow",
    "control_severity": "SELECT crit AS criticality_raw, severity, likelihood_rating, count(*) AS n FROM crow GROUP BY ALL",
    "tenant_warnings": "SELECT DISTINCT run_id, 'UNKNOWN_TENANT' AS code FROM crow WHERE tenant_id = 'UNKNOWN-TENANT'",
    "control_filter": "SELECT run_id, row_no, CASE WHEN filter_reason IS NULL THEN 'INCLUDED' ELSE 'EXCLUDED' END AS report_inclusion, filter_reason AS exclusion_reason FROM crow",
    "control_dedup": "SELECT run_id, row_no, is_duplicate, duplicate_of, report_inclusion FROM cproc",
    "control_counts": """SELECT run_id, count(*) AS total_ingested, count(*) FILTER (report_inclusion = 'INCLUDED') AS included, count(*) FILTER (filter_reason IS NOT NULL) AS excluded,
      count(*) FILTER (filter_reason IS NULL AND is_duplicate) AS duplicates FROM cproc GROUP BY run_id""",
    "control_refs": "SELECT run_id, group_order, member_key, output_section, severity, ref_number, ref_prefix || ref_number AS ref_label, instance_count FROM cgrp",
    "control_chunks": f"""SELECT run_id, member_key, (rn - 1) // size + 1 AS chunk_no, (rn - 1) % size + 1 AS chunk_pos, (total + size - 1) // size AS chunk_count FROM (
      SELECT *, CASE WHEN total <= 20 THEN total ELSE 15 END AS size FROM (SELECT * EXCLUDE (rn), count(*) OVER (PARTITION BY run_id) AS total,
        row_number() OVER (PARTITION BY run_id ORDER BY {_SECRANK.format("output_section")}, {_CRANK.format("severity")}, control_id, tenant_id) AS rn FROM cgrp))""",
    "control_merged": f"""SELECT run_id, group_no, row_number() OVER (PARTITION BY run_id ORDER BY {_SECRANK.format("output_section")}, {_CRANK.format("severity")}, group_name, group_no) AS group_order,
      group_name, output_section, severity, likelihood_rating, instance_count, member_count, is_merged, first_ref_prefix FROM cmerged""",
    "control_resources": """SELECT run_id, group_no, check_id AS resource, left(check_title, 80) AS resource_name, service_name AS resource_type, tenant_id AS account_name,
      tenant_id AS account_uid, 'global' AS region, check_id, row_number() OVER (PARTITION BY run_id, group_no ORDER BY member_pos) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, group_no, details ORDER BY member_pos) AS n FROM catt WHERE details IS NOT NULL) WHERE n = 1""",
    "control_audit": """SELECT run_id, finding_instance_id, e.stage_no::BIGINT AS stage_no, e.seq::BIGINT AS seq, e.stage, e.field, e.old_value, e.new_value, e.reason, 'pipeline' AS actor FROM (
      SELECT run_id, finding_instance_id, unnest([x FOR x IN [
        CASE WHEN control_id = '' THEN {'stage_no': 1, 'seq': 0, 'stage': 'ingest', 'field': 'human_review_required', 'old_value': 'false', 'new_value': 'true',
          'reason': 'Row ' || row_no || ': Control ID is blank — cannot resolve service or build keys'} END,
        {'stage_no': 1, 'seq': 1, 'stage': 'ingest', 'field': 'ingested', 'old_value': NULL, 'new_value': control_id, 'reason': 'Parsed from row ' || row_no},
        CASE WHEN filter_reason IS NOT NULL AND NOT is_duplicate THEN {'stage_no': 2, 'seq': 0, 'stage': 'process', 'field': 'report_inclusion', 'old_value': 'INCLUDED',
          'new_value': 'EXCLUDED', 'reason': filter_reason} END,
        CASE WHEN is_duplicate THEN {'stage_no': 2, 'seq': 1, 'stage': 'process', 'field': 'report_inclusion', 'old_value': CASE WHEN filter_reason IS NULL THEN 'INCLUDED' ELSE 'EXCLUDED' END,
          'new_value': 'EXCLUDED', 'reason': 'Duplicate of ' || duplicate_of || ' (same dedup_key)'} END
      ] IF x IS NOT NULL]) AS e FROM cproc)""",
    "control_report": """SELECT run_id, section, place AS section_order, 'heading' AS kind, 0::BIGINT AS ref_number, '' AS ref, section AS finding, '' AS risk_rating, '' AS root_cause, '' AS likelihood,
        '' AS consequence_rating, '' AS access_required, '' AS situation, '' AS consequence, '' AS recommendations FROM (SELECT DISTINCT run_id FROM cenriched), placed
      UNION ALL SELECT run_id, output_section, (SELECT place FROM placed WHERE section = output_section), 'finding', ref_number, first_ref_prefix || ref_number,
        CASE WHEN failed THEN '[REQUIRES_HUMAN_INPUT] ' || coalesce(nullif(rep.title, ''), 'Unknown control') ELSE 'Finding ' || rc END,
        CASE WHEN failed THEN 'Medium' ELSE mr END, CASE WHEN failed THEN '[REQUIRES_HUMAN_INPUT: root_cause_narrative]' ELSE 'Cause of ' || rc || '.' END,
        likelihood_rating, cr, CASE WHEN failed THEN '[REQUIRES_HUMAN_INPUT: access_required]' ELSE 'Any user.' END,
        CASE WHEN failed THEN '[REQUIRES_HUMAN_INPUT: situation_narrative]' ELSE 'Situation of ' || rc || '.' END,
        CASE WHEN failed THEN '[REQUIRES_HUMAN_INPUT: consequence_narrative]' ELSE 'Consequence of ' || rc || '.' END,
        CASE WHEN failed THEN '[REQUIRES_HUMAN_INPUT: recommendations]' ELSE 'Fix ' || rc || '.' END FROM cenriched""",
}


def oracle_queries() -> dict[str, str]:
    from sightline.plans.oracle_outputs import OUTPUTS

    return {name: with_ctes(sql) for name, sql in (SELECTS | OUTPUTS).items()}
