"""Completion, review and control stages on small data; brute force where it helps."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sightline.operators import approvals, completion, controls, process, propose, report
from sightline.plans.catalog import QUERIES, Tables
from sightline.plans.oracle import oracle_queries
from sightline.schemas import RESOURCE_COLUMNS
from sightline.sinks import approvals_json, write_report_csv, write_table, write_text
from sightline.sources.delimited import read_controls_csv, read_findings_csv
from sightline.sources.json_files import read_approvals
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@needs_tables
@pytest.mark.parametrize("name", [
    "status_reconcile", "review_flags", "tag_maps", "dedup_findings", "merged_groups", "board_edits", "report_rows",
    "csv_scan", "json_scan", "nested_flatten", "html_strip", "control_report",
])
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), oracle_queries()[name]) is None


@needs_tables
def test_tables_in_several_files(spark, tmp_path):
    """Rows are numbered over all files of a table."""
    for name in ("orders", "customer", "nation", "region", "part"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    for name in ("supplier", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(3, "l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("duplicate_links", "ordered_groups"):
        assert difference(QUERIES[name](spark, str(tmp_path)), duck(str(tmp_path)), oracle_queries()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_queries())


def findings(spark, rows):
    """Processed rows from (run_id, row_seq, dedup_key, status)."""
    df = spark.createDataFrame(rows, "run_id STRING, row_seq LONG, dedup_key STRING, scanner_status STRING")
    return process.mark_duplicates(process.status_filter(df))


def test_hot_duplicate_key_against_brute_force(spark):
    rows = [("r", i, "hot" if i % 3 == 0 else f"k{i % 50}", "PASS" if i % 7 == 0 else "FAIL") for i in range(1, 1000)]
    got = {r.row_seq: r.is_duplicate for r in findings(spark, rows).collect()}
    seen, want = set(), {}
    for _, seq, key, status in rows:
        want[seq] = status == "FAIL" and key in seen
        if status == "FAIL":
            seen.add(key)
    assert got == want


def test_marking_twice_changes_nothing(spark):
    once = findings(spark, [("r", i, f"k{i % 4}", "FAIL") for i in range(1, 20)])
    kept = once.filter("NOT is_duplicate").select("run_id", "row_seq", "dedup_key", "scanner_status")
    assert process.mark_duplicates(process.status_filter(kept)).filter("is_duplicate").count() == 0


def test_cache_answers_are_not_asked_again(spark, tmp_path):
    cache, log = str(tmp_path / "cache"), str(tmp_path / "log")
    os.makedirs(log)

    def ask(prompt, tokens, seconds):
        with open(f"{log}/{prompt}", "a") as f:
            f.write("x")
        if prompt == "bad":
            raise ValueError("down")
        return prompt.upper()

    asks = spark.createDataFrame([("a",), ("b",), ("a",), ("bad",)], "prompt STRING").withColumns(
        {"max_tokens": F.lit(1), "timeout_seconds": F.lit(1)}
    )
    for _ in range(2):
        rows = completion.complete_requests(asks, ask, "m", cache).collect()
        assert sorted((r.prompt, r.response) for r in rows) == [("a", "A"), ("a", "A"), ("b", "B"), ("bad", None)]
        assert {r.error for r in rows} == {None, "ValueError: down"}
    assert {f: len(open(f"{log}/{f}").read()) for f in os.listdir(log)} == {"a": 1, "b": 1, "bad": 2}


def chunked(spark, n):
    rows = [("r", f"c{i}", i) for i in range(n)]
    return spark.createDataFrame(rows, "run_id STRING, member_key STRING, i INT").select(
        "run_id", "member_key", F.col("member_key").alias("check_id"), F.col("member_key").alias("raw_check_title"),
        F.lit("high").alias("raw_severity"), F.lit(1).alias("instance_count"), F.lit(1).alias("chunk_no"),
        F.lit(1).alias("chunk_count"), (F.col("i") + 1).alias("chunk_pos"),
    )


def test_single_proposal_skips_consolidation(spark):
    calls = []

    def ask(prompt, tokens, seconds):
        assert "proposed in separate batches" not in prompt
        return json.dumps([{"group_name": "all", "check_ids": ["c0", "c1"], "rationale": "r"}])

    found = propose.propose_groups(chunked(spark, 2), ask, "m")
    assert found.members.count() == 2 and found.warnings.count() == 0
    assert found.consolidation.first().consolidation_applied and not calls


def test_failed_consolidation_keeps_proposals(spark):
    def ask(prompt, tokens, seconds):
        if "proposed in separate batches" in prompt:
            return "[]"
        return json.dumps([{"group_name": c, "check_ids": [c], "rationale": "r"} for c in ("c0", "c1", "c2")])

    found = propose.propose_groups(chunked(spark, 3), ask, "m")
    assert sorted(r.member_key for r in found.members.collect()) == ["c0", "c1", "c2"]
    assert [w.code for w in found.warnings.collect()] == ["CONSOLIDATION_FAILED"]
    assert not found.consolidation.first().consolidation_applied


def test_board_edits(spark):
    members = spark.createDataFrame(
        [("r", c, g) for c, g in zip("abcdef", ["g1", "g1", "g2", "g2", "g3", "g3"])], "run_id STRING, member_key STRING, group_id STRING"
    )
    edits = spark.createDataFrame([
        ("r", 1, "move", "a", "g3", None), ("r", 2, "delete", None, "g3", None), ("r", 3, "move", "e", "g1", None),
        ("r", 4, "split", None, "g2", None), ("r", 5, "move", "c", "__unassigned__", None),
    ], "run_id STRING, seq INT, op STRING, check_id STRING, group_id STRING, value STRING")
    got = {r.member_key: r.group_id for r in approvals.board_assignment(approvals.replay_boards(members, edits)).collect()}
    pool = approvals.UNASSIGNED
    assert got == {"a": pool, "b": "g1", "c": pool, "d": "split:d", "e": "g1", "f": pool}
    later = edits.unionByName(spark.createDataFrame([
        ("r", 6, "rename", None, "split:d", " Mine "), ("r", 7, "risk", None, "split:d", "High"), ("r", 8, "move", "b", "split:d", None),
        ("r", 9, "rename", None, "g2", "gone"), ("r", 10, "split", None, "g1", None), ("r", 11, "move", "c", "g3", None),
    ], edits.schema))
    replayed = approvals.replay_boards(members.withColumn("title", F.upper("member_key")), later)
    assert {r.member_key: r.group_id for r in approvals.board_assignment(replayed).collect()} == {"a": pool, "b": "split:d", "c": pool, "d": "split:d", "e": "g1", "f": pool}
    boxes = {r.group_id: (r.group_name, r.rationale, r.risk_rating_override) for r in approvals.board_groups(replayed).collect()}
    assert boxes == {"g1": ("g1", "", None), "split:c": ("C", "Split from: g2", None), "split:d": ("Mine", "Split from: g2", "High")}
    approved = approvals.approvals_from_board(approvals.board_assignment(replayed), approvals.board_groups(replayed)).collect()
    assert sorted((r.group_no, r.group_name, r.member_key) for r in approved) == [(1, "g1", "e"), (2, "Mine", "b"), (2, "Mine", "d")]
    reset = edits.unionByName(spark.createDataFrame([("r", 9, "reset", None, None, None)], edits.schema))
    assert {r.member_key: r.group_id for r in approvals.board_assignment(approvals.replay_boards(members, reset)).collect()} == dict(zip("abcdef", ["g1", "g1", "g2", "g2", "g3", "g3"]))


def test_approval_files(spark, tmp_path):
    good = {"run_id": "r", "approved_at": "t", "groups": [{"group_name": "g", "check_ids": ["a", "b"], "risk_rating": "Low"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({"run_id": "x", "groups": [{"group_name": "", "check_ids": ["a"]}]}))
    (tmp_path / "c.json").write_text(json.dumps({"run_id": "y", "groups": []}))
    scan = read_approvals(spark, str(tmp_path))
    assert [(r.member_key, r.pos, r.risk_rating_override) for r in scan.rows.orderBy("pos").collect()] == [("a", 1, "Low"), ("b", 2, "Low")]
    assert sorted(r.run_id for r in scan.rejected.collect()) == ["x", "y"]
    payload = json.loads(approvals_json(scan.rows).first().payload)
    assert payload["groups"][0]["check_ids"] == ["a", "b"]


def test_controls_from_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "﻿Control ID,Requirement,Result,Criticality,Details,Comments,New\n"
        "MS.AAD.1.1v1,\"<b>Block</b>, now\",Fail,Shall,6 role(s) that,System.Object[],x\n"
        "MS.AAD.1.1v1,again,Fail,Shall,,,\n"
        ",blank,Fail,Shall,d,,\n"
        "MS.FOO.1.1v1,odd,Fail,Shall,d,,\n"
        "MS.TEAMS.1.1v1,may,Fail,May,d,,\n"
        ",,,,,,\n", encoding="utf-8",
    )
    scan = read_controls_csv(spark, str(tmp_path), tenant_id="t1")
    done = controls.processed_controls(controls.normalise_controls(scan.rows)).cache()
    counts = controls.control_run_counts(done).first()
    assert (counts.total_ingested, counts.included, counts.excluded, counts.duplicates) == (5, 2, 2, 1)
    groups = controls.control_groups(done).orderBy("group_order").collect()
    assert [(g.ref_label, g.instance_count, g.check_title) for g in groups] == [("ENT1", 6, "Block, now"), ("M3651", 1, "odd")]
    assert groups[0].extra_fields == {"New": "x"} and groups[0].raw_comments is None
    (tmp_path / "bad.csv").write_text("Control ID,Result\nx,Fail\n")
    rejected = read_controls_csv(spark, str(tmp_path)).rejected.collect()
    assert len(rejected) == 1 and "Criticality" in rejected[0].reason


def test_csv_records_like_the_reference_reader(spark, tmp_path):
    """Stray quotes, doubled quotes, line breaks in cells and long cells, over splits of a few bytes."""
    import csv
    import random

    rng = random.Random(3)
    header = ["STATUS", "CHECK_ID", "SEVERITY", "PROVIDER", "RESOURCE_UID", "CHECK_TITLE", "REGION", "SERVICE_NAME", *RESOURCE_COLUMNS[-8:]]
    stray = ['5" disk', 'a "b" c', "plain", '"in, side"', '"two\nlines"', '"doubled "" quote"', "", 'x""y', '"a"b', '"' + "z" * 200_000 + '"']
    lines = [",".join(header)]
    for k in range(300):
        lines.append(",".join([f"FAIL,c{k},low,aws,r{k}", stray[9] if k in (7, 150) else rng.choice(stray[:9]), "eu", rng.choice(stray[:9]), *[""] * 8]))
    text = "\n".join(lines) + "\n"
    (tmp_path / "a.csv").write_text(text)
    want = {row[1]: (row[5], row[7]) for row in csv.reader(text.splitlines(keepends=True)) if row[1] != "CHECK_ID"} if csv.field_size_limit(10**7) else {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        scan = read_findings_csv(spark, str(tmp_path))
        got = {r.raw_check_id: (r.raw_check_title, r.raw_service_name) for r in scan.rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    blank = lambda pair: tuple(v or None for v in pair)
    assert [r.reason for r in scan.rejected.collect()] == []
    assert {k: blank(v) for k, v in got.items()} == {k: blank(v) for k, v in want.items()} and len(got) == 300


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_quotes_after_other_delimiters_are_text(spark, tmp_path, delimiter):
    """Only the file's own delimiter ends a cell: a quote after another one opens nothing."""
    import csv

    header = delimiter.join(["STATUS", "CHECK_ID", "SEVERITY", "PROVIDER", "RESOURCE_UID", "CHECK_TITLE", "REGION", "SERVICE_NAME", *RESOURCE_COLUMNS[-8:]])
    cells = [f'a{d}"b' for d in ",;\t|" if d != delimiter] + ["plain", f'"quoted{delimiter} with\n{delimiter}""line"', '"x', 'y" z']
    rows = [delimiter.join(["FAIL", f"c{k}", "low", "aws", f"r{k}", c, "eu", "svc", *[""] * 8]) for k, c in enumerate(cells[:-2] + cells[-1:])]
    text = "\n".join([header, "   ", *rows, ""])
    (tmp_path / "a.csv").write_text(text, encoding="latin-1")
    (tmp_path / "b.csv").write_text(text.replace("plain", "pläin"), encoding="latin-1")
    (tmp_path / "poor.csv").write_text(delimiter.join(["STATUS", "CHECK_ID"]) + "\nFAIL" + delimiter + "x\n")
    scan = read_findings_csv(spark, str(tmp_path))
    want = [r[5] for r in csv.reader([line for line in text.splitlines(keepends=True) if line.strip()], delimiter=delimiter)][1:]
    for name, said in (("a.csv", "plain"), ("b.csv", "pläin")):
        got = {r.raw_check_id: r.raw_check_title for r in scan.rows.filter(F.col("source_file").endswith(name)).collect()}
        assert [got.get(f"c{k}") for k in range(len(want))] == [w.replace("plain", said).strip() for w in want]
    assert [(r.source_file[-8:], r.reason[:2]) for r in scan.rejected.collect()] == [("poor.csv", "2 ")]
    assert {w.code for w in scan.warnings.collect()} == ({"NON_STANDARD_DELIMITER"} if delimiter != "," else set())


@needs_tables
def test_long_resource_texts_are_split_not_cut(spark):
    t = Tables(spark, SF)
    lines = report.resource_lines(t.approved(), t.groups(), t.working()).cache()
    whole = report.resource_text(lines, 10**6).filter("part_no = 0")
    parts = report.resource_text(lines, 3).groupBy("run_id", "group_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "resource_text"))), lambda s: s["resource_text"]), "\n").alias("joined")
    )
    both = whole.join(parts, ["run_id", "group_no"])
    assert both.count() == whole.count() and both.filter("joined <> resource_text").count() == 0


@needs_tables
def test_sinks(spark, tmp_path):
    t = Tables(spark, SF)
    write_table(t.groups().select("run_id", "check_id"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).filter("client_slug = 'default'").count() == t.groups().count()
    rows = t.groups().select("run_id", F.lit(0).alias("sheet_order"), F.col("group_order").alias("ref_number"), F.col("check_id").alias("finding"))
    write_report_csv(rows, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == rows.count()
    write_text(t.groups().select("run_id", F.col("group_order").alias("group_no"), F.col("check_id").alias("text")), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).filter("value <> ''").count() == rows.count()


def test_streaming_input_is_accepted(spark, tmp_path):
    from sightline.operators.normalise import normalise_findings
    from sightline.schemas import RAW_FINDINGS

    assert normalise_findings(spark.readStream.schema(RAW_FINDINGS).parquet(str(tmp_path))).isStreaming
