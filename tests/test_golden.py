"""The thirty findings, from files through every stage."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import metrics, normalise, process
from sightline.sources.delimited import read_findings_csv
from sightline.sources.json_files import read_findings, read_findings_json
from tests import golden


def csv_text(delimiter=",", newline="\n"):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator=newline)
    writer.writerow(golden.COLUMNS)
    for row in golden.export_rows():
        writer.writerow(["" if c is None else c for c in row])
    return out.getvalue()


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("golden") / "client 1 + 2 é"
    folder.mkdir()
    (folder / "scan.csv").write_text(csv_text())
    return read_findings_csv(spark, str(folder))


@pytest.fixture(scope="module")
def findings(scan):
    return normalise.normalise_findings(scan.rows).cache()


def pairs(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_ingest_counts(findings):
    assert pairs(metrics.status_breakdown(findings), "scanner_status", "findings") == golden.STATUS
    blanks = metrics.blank_breakdown(findings).first()
    assert (blanks.description_blank, blanks.risk_blank, blanks.remediation_blank, blanks.region_structural) == (7, 8, 3, 8)
    assert findings.filter("human_review_required").count() == 11
    assert findings.filter("arn_fallback_used AND resource_uid_normalised <> ''").count() == 3


def test_warnings(findings):
    found = normalise.ingest_warnings(findings).unionByName(normalise.unknown_column_warnings(findings))
    assert pairs(metrics.warning_breakdown(found), "code", "warnings") == golden.WARNINGS


def test_rows_are_numbered_from_two(findings):
    assert [r.row_no for r in findings.select("row_no").orderBy("row_seq").collect()] == list(range(2, 32))


def test_process_counts(findings):
    processed = process.processed_findings(findings)
    counts = metrics.run_counts(process.assign_section(processed)).first()
    assert (counts.total_findings, counts.included, counts.excluded, counts.duplicates, counts.output_groups) == (30, 26, 2, 2, 16)
    links = processed.filter("is_duplicate").select("row_no", "duplicate_of").collect()
    ids = pairs(findings, "row_no", "finding_instance_id")
    assert {r.row_no: r.duplicate_of for r in links} == {6: ids[2], 22: ids[21]}


def test_groups_in_order(scan):
    groups = process.check_groups(scan.rows).orderBy("group_order").collect()
    assert [(g.raw_severity, g.likelihood_rating, g.instance_count, g.check_id) for g in groups] == golden.GROUPS
    volumes = next(g for g in groups if g.check_id.startswith("ec2_ebs"))
    assert volumes.row_no == 17


def test_groups_do_not_depend_on_partitioning(scan):
    key = lambda df: sorted((g.group_order, g.finding_instance_id, g.instance_count) for g in df.collect())
    assert key(process.check_groups(scan.rows)) == key(process.check_groups(scan.rows.repartition(7, F.rand(3))))


def test_odd_csv_reads_the_same(spark, scan, tmp_path):
    """Semicolons, doubled line ends, blank lines, Latin-1 and tiny splits change nothing."""
    text = "\n\n" + csv_text(";", "\r\r\n").replace("Why\nit", "Why\r\nit").replace("exactly", "genau é")
    (tmp_path / "odd.csv").write_bytes(text.encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        odd = read_findings_csv(spark, str(tmp_path))
        rows = {r.row_no: r for r in odd.rows.collect()}
        codes = {r.code for r in odd.warnings.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert codes == {"LINE_ENDING_FIXED", "NON_STANDARD_DELIMITER"}
    plain = {r.row_no: r for r in scan.rows.collect()}
    assert rows.keys() == plain.keys()
    for n, row in plain.items():
        assert rows[n].raw_check_id == row.raw_check_id
        assert rows[n].raw_risk == row.raw_risk
        assert rows[n].raw_description == (row.raw_description or "").replace("exactly", "genau é")


def test_file_with_few_known_columns_is_rejected(spark, tmp_path):
    (tmp_path / "other.csv").write_text("a,b,STATUS\n1,2,FAIL\n")
    scan = read_findings_csv(spark, str(tmp_path))
    assert scan.rows.count() == 0
    assert scan.rejected.first().reason.startswith("1 known columns")


def test_old_names_and_containers(spark, tmp_path):
    item = {"ACCOUNT_ID": "1", "check_id": "c1", "RESOURCE_ARN": "arn:aws:s3:::b/", "STATUS": "FAIL", "MUTED": True,
            "EXTRA": {"a": [1, 2]}, "RISK": None}
    (tmp_path / "a.json").write_text(json.dumps({"findings": [item, "noise", item]}))
    (tmp_path / "b.json").write_text(json.dumps({"data": [item]}))
    (tmp_path / "c.json").write_text(json.dumps(item))
    (tmp_path / "d.json").write_text('{"findings": 3}')
    scan = read_findings_json(spark, str(tmp_path))
    rows = scan.rows.collect()
    assert sorted(r.row_no for r in rows) == [2, 2, 2, 4]
    assert {(r.raw_account_uid, r.raw_check_id, r.raw_resource_uid, r.raw_muted.lower()) for r in rows} == {("1", "c1", "arn:aws:s3:::b/", "true")}
    assert json.loads(rows[0].extra_fields["EXTRA"]) == {"a": [1, 2]}
    assert scan.rejected.count() == 1
    done = normalise.normalise_findings(scan.rows).first()
    assert (done.scanner_status, done.resource_uid_normalised) == ("MUTED(FAIL)", "arn:aws:s3:::b")


def test_nested_findings(spark, tmp_path):
    doc = {
        "status": "Suppressed", "status_code": "FAIL", "severity": "High", "finding_info": {"uid": "prowler-aws-s3_x-111122223333-eu-1", "types": ["T"]},
        "cloud": {"region": "eu", "account": {"uid": "111122223333"}}, "resources": [{"uid": "u", "group": {"name": "s3"}, "labels": ["k:v", ""]}],
        "unmapped": {"categories": ["a", "b"], "compliance": {"CIS": ["1", "2"], "X": "9"}, "additional_urls": ["", "http://u"]},
    }
    (tmp_path / "n.export").write_text(json.dumps([doc]))
    (tmp_path / "scan.txt").write_text(csv_text())
    (tmp_path / "old.xlsx").write_bytes(b"PK")
    scan = read_findings(spark, str(tmp_path))
    assert scan.rows.count() == 31
    assert [r.reason for r in scan.rejected.collect()] == ["spreadsheets are not read"]
    r = scan.rows.filter("sheet_name = 'json'").first()
    assert (r.raw_check_id, r.raw_region, r.raw_severity, r.raw_muted, r.raw_service_name) == ("s3_x", "eu", "high", "True", "s3")
    assert (r.raw_compliance, r.raw_categories, r.raw_resource_tags) == ("CIS: 1 | CIS: 2 | X: 9", "a | b", "k:v")
    assert (r.raw_provider, r.raw_remediation_recommendation_url, r.raw_check_type) == ("aws", "http://u", "T")
    assert [w.code for w in scan.warnings.collect()] == ["OCSF_FORMAT_DETECTED"]
