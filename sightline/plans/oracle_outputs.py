"""SQL of the queries that give the outputs of whole runs."""

from sightline.plans.oracle import _RANK, SELECTS, _clean_control

_INGEST = """SELECT run_id, 'rows' AS section, 'findings' AS key, count(*) AS value FROM norm GROUP BY run_id
  UNION ALL SELECT run_id, 'status', scanner_status, count(*) FROM norm GROUP BY ALL
  UNION ALL SELECT run_id, 'reconciled', scanner_status, count(*) FROM norm WHERE muted_reconciled GROUP BY ALL
  UNION ALL SELECT run_id, 'warnings', code, count(*) FROM warn GROUP BY ALL
  UNION ALL SELECT run_id, 'blanks', unnest(['description', 'risk', 'remediation', 'region']), unnest([count(*) FILTER (blank_description = 'DATA_QUALITY'),
    count(*) FILTER (blank_risk = 'DATA_QUALITY'), count(*) FILTER (blank_remediation = 'DATA_QUALITY'), count(*) FILTER (blank_region = 'STRUCTURAL')]) FROM norm GROUP BY run_id
  UNION ALL SELECT run_id, 'fallbacks', unnest(['total', 'listed', 'more']), unnest([n, least(n, 5), greatest(n - 5, 0)]) FROM (
    SELECT run_id, count(*) FILTER (arn_fallback_used AND resource_uid_normalised <> '') AS n FROM norm GROUP BY run_id)
  UNION ALL SELECT run_id, 'review', unnest(['total', 'listed', 'more']), unnest([n, least(n, 10), greatest(n - 10, 0)]) FROM (
    SELECT run_id, count(*) FILTER (review_reason IS NOT NULL) AS n FROM norm GROUP BY run_id)"""

_PROCESS = """SELECT run_id, 'counts' AS section, unnest(['total_findings', 'included', 'excluded', 'duplicates', 'output_groups']) AS key,
    unnest([total_findings, included, excluded, duplicates, output_groups]) AS value FROM counts WHERE output_groups > 0
  UNION ALL SELECT run_id, 'excluded', exclusion_reason, count(*) FROM proc WHERE report_inclusion = 'EXCLUDED' AND NOT is_duplicate GROUP BY ALL
  UNION ALL SELECT run_id, 'duplicates', check_id, count(*) FROM proc WHERE is_duplicate GROUP BY ALL
  UNION ALL SELECT run_id, 'groups', output_section, count(*) FROM grp GROUP BY ALL
  UNION ALL SELECT run_id, 'instances', output_section, sum(instance_count)::BIGINT FROM grp GROUP BY ALL
  UNION ALL SELECT run_id, 'severity', coalesce(lower(raw_severity), '?'), count(*) FROM grp GROUP BY ALL
  UNION ALL SELECT run_id, 'likelihood', likelihood_rating, count(*) FROM grp GROUP BY ALL
  UNION ALL SELECT run_id, 'review', 'groups', count(*) FILTER (review_reason IS NOT NULL) FROM grp GROUP BY ALL"""

_EVENT = "run_id, finding_instance_id, stage_no, seq, stage, field, old_value, new_value, reason, actor"
_TRAIL = f"""SELECT *, row_number() OVER (PARTITION BY run_id, finding_instance_id ORDER BY stage_no, step_no, seq) AS event_no FROM (
  SELECT * EXCLUDE (step_no), step_no FROM (
    SELECT 1 AS step_no, 'findings' AS step, run_id, finding_instance_id, stage_no::BIGINT AS stage_no, seq::BIGINT AS seq, stage, field, old_value, new_value, reason, 'pipeline' AS actor FROM audit
    UNION ALL SELECT 2, 'groups', run_id, finding_instance_id, 2, 4, 'check_grouping', 'instance_count', '1', instance_count::VARCHAR,
      'Grouped ' || instance_count || ' instance(s) of check_id=''' || check_id || ''' into one output row', 'pipeline' FROM grp
    UNION ALL SELECT 2, 'groups', run_id, finding_instance_id, 2, 5, 'likelihood', 'likelihood_rating', NULL, likelihood_rating, likelihood_reason, 'pipeline' FROM grp
    UNION ALL SELECT 3, 'grouping', {_EVENT} FROM ({SELECTS["merge_audit"]})
    UNION ALL SELECT 4, 'review', m.run_id, m.rep.id, 3, 0, 'review', 'semantic_group', check_ids, m.group_name, 'Group as approved in review'
      || CASE WHEN m.group_no % 5 = 0 THEN ': Ask the owner of ' || m.group_name ELSE '' END, 'human' FROM merged m
    UNION ALL SELECT 4, 'review', m.run_id, m.rep.id, 3, 1, 'review', 'likelihood_rating', g.likelihood_rating, m.likelihood_rating,
      'Highest likelihood across merged group: ' || check_ids, 'pipeline' FROM merged m JOIN grp g ON g.run_id = m.run_id AND g.finding_instance_id = m.rep.id
    UNION ALL SELECT 5, 'enrichment', {_EVENT} FROM ({SELECTS["enrich_audit"]})))"""

_CONTROL_RUNS = f"""
  SELECT run_id, 'ingest' AS stage, unnest(['findings', 'warnings']) AS counter, unnest([count(*), max((tenant_id = 'UNKNOWN-TENANT')::BIGINT)]) AS value FROM cproc GROUP BY run_id
  UNION ALL SELECT run_id, 'process', unnest(['included', 'excluded', 'duplicates']), unnest([count(*) FILTER (report_inclusion = 'INCLUDED'),
    count(*) FILTER (filter_reason IS NOT NULL), count(*) FILTER (filter_reason IS NULL AND is_duplicate)]) FROM cproc GROUP BY run_id
  UNION ALL SELECT run_id, 'process', 'groups', count(*) FROM cgrp GROUP BY run_id
  UNION ALL SELECT run_id, 'grouping', 'original_controls', count(*) FROM cgrp GROUP BY run_id
  UNION ALL SELECT run_id, 'grouping', 'chunks_used', CASE WHEN count(*) <= 20 THEN 1 ELSE (count(*) + 14) // 15 END FROM cgrp GROUP BY run_id
  UNION ALL SELECT run_id, 'grouping', unnest(['groups_proposed', 'merges_applied']), unnest([count(*), count(*) FILTER (is_merged)]) FROM cmerged GROUP BY run_id
  UNION ALL SELECT run_id, 'review', 'approved_groups', count(*) FROM cmerged GROUP BY run_id
  UNION ALL SELECT run_id, 'enrich', unnest(['enriched', 'failed', 'risk_High', 'risk_Medium', 'risk_Low', 'risk_Unknown']), unnest([count(*) FILTER (NOT failed), count(*) FILTER (failed),
    count(*) FILTER (NOT failed AND mr = 'High'), count(*) FILTER (NOT failed AND mr = 'Medium'), count(*) FILTER (NOT failed AND mr = 'Low'), count(*) FILTER (failed)]) FROM cenriched GROUP BY run_id
  UNION ALL SELECT run_id, 'render', 'groups_written', count(*) FROM cenriched GROUP BY run_id"""

_CONTROL_SUMMARY = f"""SELECT * FROM ({_CONTROL_RUNS})
  UNION ALL SELECT NULL, CASE WHEN stage = 'ingest' THEN 'process' WHEN counter = 'groups' THEN 'groups' ELSE stage END, counter, sum(value)::BIGINT FROM ({_CONTROL_RUNS})
    WHERE counter NOT LIKE 'risk%' AND counter NOT IN ('original_controls', 'chunks_used', 'warnings', 'approved_groups') GROUP BY ALL"""

_ENRICHED = """SELECT e.run_id, e.group_no, p.page_no, pages, group_name, replace(check_ids, ', ', ',') AS check_ids, output_section, instance_count, likelihood_rating, risk_rating,
    consequence_rating, finding_title, root_cause AS root_cause_narrative, situation AS situation_narrative, consequence AS consequence_narrative, access_required,
    recommendations, NOT failed AS ai_enriched, failed AS llm_failed, enrichment_review IS NOT NULL AS human_review_required,
    coalesce(d.n, 0) AS resources, md5(coalesce(d.shown, '')) AS resources_md5, coalesce(a.names, '') AS accounts
  FROM enriched e JOIN (SELECT run_id, group_no, max(n) AS pages FROM (
      SELECT run_id, group_no, (count(*) - 1) // 50 + 1 AS n FROM rdetail GROUP BY ALL
      UNION ALL SELECT run_id, group_no, (count(*) - 1) // 50 + 1 FROM maccounts GROUP BY ALL
      UNION ALL SELECT run_id, group_no, 1 FROM enriched) GROUP BY ALL) c ON c.run_id = e.run_id AND c.group_no = e.group_no
    CROSS JOIN LATERAL (SELECT unnest(range(c.pages)) AS page_no) p
    LEFT JOIN recs r ON r.run_id = e.run_id AND r.group_no = e.group_no
    LEFT JOIN (SELECT run_id, group_no, (pos - 1) // 50 AS page_no, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS shown FROM rdetail GROUP BY ALL) d
      ON d.run_id = e.run_id AND d.group_no = e.group_no AND d.page_no = p.page_no
    LEFT JOIN (SELECT run_id, group_no, (pos - 1) // 50 AS page_no, string_agg(account, ';' ORDER BY pos) AS names FROM maccounts GROUP BY ALL) a
      ON a.run_id = e.run_id AND a.group_no = e.group_no AND a.page_no = p.page_no"""

_RESOURCES = """SELECT run_id, group_no, string_agg(resource, chr(10) ORDER BY member_pos) AS names,
    string_agg(concat_ws('|', resource, resource_name, resource_type, account_name, account_uid, region, check_id), chr(10) ORDER BY member_pos) AS shown FROM (
  SELECT run_id, group_no, member_pos, resource_uid_normalised AS resource, coalesce(raw_resource_name, '') AS resource_name, raw_resource_type AS resource_type,
    raw_account_name AS account_name, raw_account_uid AS account_uid, region_normalised AS region, check_id,
    row_number() OVER (PARTITION BY run_id, group_no, resource_uid_normalised ORDER BY member_pos) AS n FROM {att} WHERE resource_uid_normalised <> '') WHERE n = 1 GROUP BY ALL"""

_WORDS = """SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY group_name) AS group_no, row_number() OVER (PARTITION BY run_id, group_name ORDER BY member_key) AS member_pos
  FROM (SELECT *, split_part(member_key, '_', 1) AS group_name, member_key AS mk, 'Same word' AS rationale FROM grp WHERE run_id IN ('ASIA', 'EUROPE'))"""


def _proposed(att: str, version: int, runs: str) -> str:
    return f"""SELECT {version} AS version, g.run_id, g.group_no, g.group_name, g.rationale, check_ids, is_merged, instance_count, md5(coalesce(r.names, '')) AS affected_resources,
      coalesce(a.n, 0) AS affected_accounts, o.original_count, m.merged_count, m.merges_applied, c.chunks_used
    FROM (SELECT run_id, group_no, group_name, rationale, string_agg(mk, ',' ORDER BY member_pos) AS check_ids, count(*) > 1 AS is_merged, sum(instance_count)::BIGINT AS instance_count
        FROM {att} GROUP BY ALL) g
      LEFT JOIN ({_RESOURCES.format(att=att)}) r ON r.run_id = g.run_id AND r.group_no = g.group_no
      LEFT JOIN (SELECT t.run_id, t.group_no, count(DISTINCT x.account) AS n FROM {att} t JOIN accounts x
        ON x.run_id = t.run_id AND x.check_id = t.check_id AND x.output_section = t.output_section GROUP BY ALL) a ON a.run_id = g.run_id AND a.group_no = g.group_no
      JOIN (SELECT run_id, count(*) AS original_count FROM grp GROUP BY run_id) o ON o.run_id = g.run_id
      JOIN (SELECT run_id, count(*) AS merged_count, count(*) FILTER (n > 1) AS merges_applied FROM (SELECT run_id, group_no, count(*) AS n FROM {att} GROUP BY ALL) GROUP BY run_id) m ON m.run_id = g.run_id
      JOIN (SELECT run_id, max(chunk_no) AS chunks_used FROM chunks GROUP BY run_id) c ON c.run_id = g.run_id
    WHERE g.run_id {runs} IN ('ASIA', 'EUROPE')"""


_SCANNED = (
    "run_id || '#' || row_no AS raw_notes, raw_provider, raw_account_name, raw_check_id, raw_status, raw_severity, raw_resource_uid, "
    "raw_region, trim(raw_compliance) AS raw_compliance, raw_categories, raw_resource_tags"
)
_FAULTS = """SELECT run_id, chunk_no, CASE chunk_no % 7
    WHEN 1 THEN 'Missing check_ids: ' || min(member_key) FILTER (chunk_pos = 1)
    WHEN 2 THEN 'check_id ''' || min(member_key) FILTER (chunk_pos = 1) || ''' appears in more than one group'
    WHEN 3 THEN 'Group 0: missing or empty ''rationale''; Unknown check_ids: ghost_a, ghost_b'
    WHEN 4 THEN 'Group 0: missing or empty ''group_name''; Group 0: missing or empty ''rationale''; Group 1: missing or empty ''check_ids'''
    WHEN 5 THEN 'Expected a non-empty JSON array of groups' WHEN 6 THEN 'Expected a non-empty JSON array of groups' END AS errors
  FROM chunks GROUP BY run_id, chunk_no HAVING chunk_no % 7 <> 0"""
_RULED = """SELECT run_id, output_group_key AS item, CASE WHEN run_id <> 'ASIA' AND list_contains(categories_list, 'internet-exposed') THEN 'High'
    WHEN lower(raw_severity) IN ('critical', 'high') THEN 'High' WHEN lower(raw_severity) = 'low' AND run_id > 'B' THEN 'High'
    WHEN lower(raw_severity) IN ('low', 'informational') THEN 'Low' ELSE 'Medium' END AS value FROM grp
  UNION ALL SELECT '*', 'risk_matrix=' || lower(a || '_' || b), 'invalid' FROM (SELECT unnest(['High', 'Medium', 'Low']) AS a), (SELECT unnest(['Major', 'Moderate', 'Minor']) AS b)"""
_CONTROL_CELLS = ("raw_control_id", "raw_requirement", "raw_result", "raw_criticality", "raw_details", "raw_original_result")
_CONTROL_SCAN = f"""SELECT run_id || '#' || row_no AS row, 't' AS tenant_id, {", ".join(f"{_clean_control(c)} AS {c}" for c in _CONTROL_CELLS)}, NULL AS raw_comments FROM controls_raw
  UNION ALL SELECT 'missing required columns: [''Control ID'', ''Criticality'', ''Details'', ''Requirement'', ''Result'']', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"""
_APPROVAL_FILES = """SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY group_no) AS group_no, group_name, rationale, risk_rating_override,
    row_number() OVER (PARTITION BY run_id, group_no ORDER BY pos, member_key) AS pos, member_key FROM approved WHERE run_id <> 'ASIA'
  UNION ALL SELECT DISTINCT run_id, 0, 'a group lacks group_name or check_ids', NULL, NULL, NULL::BIGINT, NULL FROM approved WHERE run_id = 'ASIA'"""


OUTPUTS = {
    "control_review": """SELECT run_id, group_no, group_name, CASE WHEN group_no % 2 = 0 THEN 'Fix together' WHEN group_no % 3 = 0 THEN 'Note ' || group_no ELSE '' END AS rationale,
        output_section, severity, likelihood_rating, instance_count, member_count, is_merged, CASE group_no % 4 WHEN 1 THEN 'Low' WHEN 3 THEN 'High' END AS risk_override FROM cmerged""",
    "control_review_audit": """SELECT run_id, rep.id AS finding_instance_id, 3::BIGINT AS stage_no, 0::BIGINT AS seq, 'review' AS stage, 'semantic_group' AS field, ids AS old_value,
        group_name AS new_value, 'Group as approved in review' || CASE WHEN group_no % 3 = 0 THEN ': Note ' || group_no ELSE '' END AS reason, 'human' AS actor FROM cmerged
      UNION ALL SELECT run_id, rep.id, 3, 1, 'review', 'likelihood_rating', rep.lk, likelihood_rating, 'Highest likelihood across merged group: ' || ids, 'pipeline' FROM cmerged
      UNION ALL SELECT run_id, rep.id, 3, 2, 'review', 'risk_rating', NULL, CASE group_no % 4 WHEN 1 THEN 'Low' ELSE 'High' END, 'Rating set in review', 'human' FROM cmerged WHERE group_no % 4 IN (1, 3)
      UNION ALL SELECT run_id, '', 3, 9, 'review', 'UNKNOWN_CHECK_ID', 'ghost_' || group_no, NULL,
        'Approved group ''' || group_name || ''' references unknown check_id ''ghost_' || group_no || '''. Skipped.', 'pipeline' FROM cmerged WHERE group_no % 3 = 0""",
    "control_defaults": "SELECT run_id, row_no, 'azure' AS provider, 'global' AS region, NULL AS raw_comments, crit AS criticality_raw, service_prefix, ref_prefix FROM crow",
    "control_validate": """SELECT run_id, group_order, CASE group_order % 6 WHEN 1 THEN 'missing field ''recommendations''' WHEN 2 THEN 'field ''recommendations'' is null'
        WHEN 3 THEN 'consequence_rating=''major'' must be one of: [''Major'', ''Minor'', ''Moderate'']' WHEN 4 THEN 'needs_human_review must be boolean true/false, got: 1'
        WHEN 5 THEN 'no valid JSON object in response' ELSE '' END AS errors FROM cgrp""",
    "regroup_members": """SELECT run_id, 1::BIGINT AS seq, true AS ok, NULL::VARCHAR AS error, CASE WHEN group_no % 3 = 0 AND pos > 1 THEN 'Loose' ELSE group_name || '!' END AS group_name, member_key FROM members
      UNION ALL SELECT run_id, 2, true, NULL, CASE WHEN group_no = 1 THEN member_key ELSE group_name END, member_key FROM members WHERE group_no % 3 <> 0 OR pos = 1
      UNION ALL SELECT run_id, 3, false, 'Missing check_ids: ' || string_agg(member_key, ', ' ORDER BY member_key), NULL, NULL FROM members
        WHERE (group_no = 1 AND pos = 1) OR (group_no % 3 = 0 AND pos > 1) GROUP BY run_id""",
    "rule_versions": _RULED,
    "answer_faults": _FAULTS,
    "mixed_scan": f"""SELECT 'a|"b;"c,"d ' || coalesce(raw_check_title, 'none') || ' é' AS raw_check_title, {_SCANNED} FROM raw""",
    "file_report": """SELECT '' AS layout, 'NON_STANDARD_DELIMITER' AS code UNION ALL SELECT 'other', '0 known columns, at least 10 needed'""",
    "scan_fingerprints": "SELECT run_id, count(*) AS rows FROM raw GROUP BY run_id",
    "control_scan": _CONTROL_SCAN,
    "approval_files": _APPROVAL_FILES,
    "ingest_report": _INGEST,
    "process_report": _PROCESS,
    "audit_trail": f"SELECT * EXCLUDE (step_no) FROM ({_TRAIL})",
    "control_run_summary": _CONTROL_SUMMARY,
    "enriched_groups": _ENRICHED,
    "grouping_proposal": _proposed("att", 1, "NOT") + " UNION ALL " + _proposed(f"({_WORDS})", 2, ""),
    "approval_versions": """SELECT run_id, version, row_number() OVER w AS pos, dense_rank() OVER (PARTITION BY run_id ORDER BY group_no) AS group_no, group_name, rationale,
        risk_rating_override, member_key FROM (
      SELECT 1 AS version, * FROM approved WHERE run_id NOT IN ('AMERICA', 'ASIA')
      UNION ALL SELECT 2, * REPLACE ('second thoughts' AS rationale) FROM approved WHERE run_id IN ('AMERICA', 'ASIA') AND group_no % 2 = 1)
      WINDOW w AS (PARTITION BY run_id, group_no ORDER BY pos, member_key)""",
    "review_cards": f"""SELECT m.run_id, 'grp_' || (row_number() OVER (PARTITION BY m.run_id ORDER BY output_section, {_RANK.format("severity")}, group_name, m.group_no) - 1) AS id,
        group_name, rationale, is_merged, instance_count, severity, likelihood_rating AS likelihood, coalesce(a.n, 0) AS accounts, replace(check_ids, ', ', ',') AS checks,
        md5(coalesce(r.shown, '')) AS resources_md5
      FROM merged m LEFT JOIN ({_RESOURCES.format(att="att")}) r ON r.run_id = m.run_id AND r.group_no = m.group_no
      LEFT JOIN (SELECT run_id, group_no, count(*) AS n FROM maccounts GROUP BY ALL) a ON a.run_id = m.run_id AND a.group_no = m.group_no""",
    "review_lookup": """SELECT run_id, group_no, mk AS member_key, member_pos AS place, coalesce(raw_check_title, check_id) AS check_title, coalesce(raw_severity, 'unknown') AS severity,
        instance_count, likelihood_rating AS likelihood, raw_service_name AS service, array_to_string(categories_list, ';') AS categories FROM att""",
}
