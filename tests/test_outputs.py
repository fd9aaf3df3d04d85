"""Outputs of whole runs: event tables, versions, pages, summaries."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import responses
from sightline.operators import exports, grouping, rule_sets, summaries
from sightline.operators.numbering import rank_rows
from sightline.plans.catalog import QUERIES
from sightline.plans.oracle import oracle_queries
from sightline.schemas import AUDIT
from sightline.session import path_exists
from sightline.sinks import append_version, latest_version, read_events, write_events
from tests.compare import difference, duck
from tests.test_stages import SF, needs_tables


@needs_tables
@pytest.mark.parametrize("name", [
    "ingest_report", "process_report", "audit_trail", "control_run_summary", "enriched_groups", "grouping_proposal",
    "approval_versions", "review_cards", "review_lookup", "rule_versions", "answer_faults", "mixed_scan", "file_report",
    "scan_fingerprints", "control_scan", "approval_files", "control_review", "control_review_audit", "control_defaults", "control_validate",
    "regroup_members",
])
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), oracle_queries()[name]) is None


def events(spark, rows):
    """Events from (run_id, finding, stage_no, seq, new_value)."""
    return spark.createDataFrame([(r, f, n, s, "stage", "field", None, v, "why", "human") for r, f, n, s, v in rows], AUDIT)


def test_audit_ids_are_shuffled_as_bytes(spark, tmp_path):
    """All events were shuffled with their ids in hexadecimal, twice as long."""
    path, ids = str(tmp_path / "audit"), ["ab" * 32, "AB" * 32, "ab" * 32 + "\n", "ab" * 31, "", "é"]
    write_events(events(spark, [("r", i, n, 0, f"{i}{n}") for i in ids for n in (2, 1)]), path, "findings")
    found = read_events(spark, path)
    (dealt,) = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert "_digest" in dealt
    assert {(r.finding_instance_id, r.event_no, r.new_value) for r in found.collect()} == {(i, n, f"{i}{n}") for i in ids for n in (1, 2)}


def test_a_step_written_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "audit")
    write_events(events(spark, [("2026", "a", 1, 0, "x"), ("2026", "a", 1, 1, "y"), ("r2", "b", 1, 0, "z"), (None, "n", 1, 0, "w")]), path, "findings")
    for _ in range(2):
        write_events(events(spark, [("2026", "a", 3, 0, "merged")]), path, "grouping")
    write_events(events(spark, [("2026", "a", 3, 0, "approved"), ("r2", "b", 3, 0, "approved")]), path, "review")
    runs = spark.createDataFrame([("2026",), ("r2",)], "run_id string")
    write_events(events(spark, [("2026", "a", 3, 0, "approved")]), path, "review", runs)  # r2 has none any more
    got = sorted((r.run_id or "", r.finding_instance_id, r.event_no, r.step, r.new_value) for r in read_events(spark, path).collect())
    assert got == [
        ("", "n", 1, "findings", "w"), ("2026", "a", 1, "findings", "x"), ("2026", "a", 2, "findings", "y"),
        ("2026", "a", 3, "grouping", "merged"), ("2026", "a", 4, "review", "approved"), ("r2", "b", 1, "findings", "z"),
    ]
    with pytest.raises(ValueError):
        write_events(events(spark, []), path, "unheard")


def test_versions_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "versions")
    rows = lambda *r: spark.createDataFrame(list(r), "run_id string, value long")
    assert not path_exists(spark, path)
    append_version(rows(("a", 1), ("a", 2), ("b", 3)), path)
    append_version(rows(("a", 4)), path)
    got = lambda: sorted((r.run_id, r.value, r.version) for r in latest_version(spark, path, rows(("", 0)).schema).collect())
    assert got() == [("a", 4, 2), ("b", 3, 1)]
    # two writers that both saw version 2 of run a
    for name, values in (("w1", (5, 6)), ("w2", (7, 8))):
        spark.createDataFrame([("a", v, 3) for v in values], "run_id string, value long, version int").write.parquet(f"{path}/write=zz{name}")
    assert got() == [("a", 7, 3), ("a", 8, 3), ("b", 3, 1)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_pages_are_joined_without_a_shuffle(spark):
    keys = {"run_id": "r", "group_no": F.col("id") % 7, "group_name": "g", "output_section": "AWS", "instance_count": F.lit(1)}
    texts = ("likelihood_rating", "risk_rating", "consequence_rating", "finding_title", "root_cause_narrative", "situation_narrative",
             "consequence_narrative", "access_required", "enrichment_review")
    enriched = spark.range(7).withColumns({
        **{k: v if not isinstance(v, str) else F.lit(v) for k, v in keys.items()}, **{c: F.lit("t") for c in texts},
        "check_ids": F.array(F.lit("c")), "enrichment_failed": F.lit(False),
    }).drop("id")
    fields = {c: F.lit("x") for c in exports._DETAIL}
    detail = spark.range(3000).select(
        F.lit("r").alias("run_id"), F.when(F.col("id") < 2500, 1).otherwise(2).cast("long").alias("group_no"), F.lit(1).alias("member_pos"),
        F.col("id").alias("row_seq"), *[v.alias(k) for k, v in fields.items()],
    )
    accounts = spark.createDataFrame([("r", 3, "a", 1), ("r", 3, "b", 2)], "run_id string, group_no long, account string, pos int")
    recs = spark.createDataFrame([("r", 1, "fix")], "run_id string, group_no long, recommendations string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = exports.enriched_groups(enriched, recs, exports.group_pages(detail, accounts, 100), buckets=8)
        assert "Exchange hashpartitioning" not in _plan(found)
        sizes = {(r.group_no, r.page_no): (_length(r.affected_resources), _length(r.affected_accounts)) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for (g, _), (n, _) in sizes.items() if g == 1) == 2500 and max(n for n, _ in sizes.values()) == 100
    assert sizes[(3, 0)] == (0, 2) and sizes[(0, 0)] == (0, 0) and len(sizes) == 25 + 5 + 5


def _length(values):
    return len(values or [])


def test_observed_totals(spark):
    log = summaries.StageLog()
    df = spark.range(10).withColumn("run_id", F.lit("r"))
    back = log.write(df, "stage", rows=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    assert back.count() == 10 and log.totals == {"stage": {"rows": 10, "even": 5}}
    empty = log.write(df.filter("id < 0"), "none", rows=F.count(F.lit(1)), most=F.max("id"))
    assert empty.count() == 0 and log.totals["none"] == {"rows": 0, "most": 0}
    assert sorted((r.stage, r.counter, r.value) for r in log.rows(df).collect()) == [
        ("none", "most", 0), ("none", "rows", 0), ("stage", "even", 5), ("stage", "rows", 10)]


@needs_tables
def test_ingest_report_reads_the_lines_once(spark):
    from sightline.operators.normalise import normalise_findings
    from sightline.sources.tables import findings_view

    rows = normalise_findings(findings_view(spark, SF))
    plan = _plan(summaries._sections(rows.select("run_id", "scanner_status"), {"run": None, "status": "scanner_status"}, [F.count(F.lit(1)).alias("n")]))
    assert plan.count("lineitem.parquet") <= 1


def test_faults_of_answers_like_the_column_form(spark):
    """The same errors, in the same order, as the test of one parsed answer."""
    items = "array<struct<group_name:string,check_ids:array<string>,rationale:string>>"
    group = lambda name, ids, why="why": {"group_name": name, "check_ids": ids, "rationale": why}
    cases = [
        [group("g", ["a", "b"]), group("c", ["c"])], [group("g", ["a"])], [group("g", ["a"]), group("h", ["a", "b", "b"]), group("i", ["c", "a"])],
        [group("", None, ""), group(None, [], None), group("g", ["a", "b", "c"])], [group("g", ["c", "b", "a", "z", "y", "z"])], [], None,
        [group("g", ["a", None, "b"])],
    ]
    answers = spark.createDataFrame([("r", k, c) for k, c in enumerate(cases)], f"run_id string, chunk_no int, items {items}")
    expected = spark.createDataFrame([("r", k, c) for k in range(len(cases)) for c in "cab"], "run_id string, chunk_no int, member_key string")
    column = F.array(F.lit("c"), F.lit("a"), F.lit("b"))
    for strict in (True, False):
        want = {r.chunk_no: "; ".join(r.e) for r in answers.select("chunk_no", responses.grouping_errors(F.col("items"), column, strict).alias("e")).collect() if r.chunk_no < 7}
        found = grouping.fault_texts(grouping.answer_faults(expected, answers, ["run_id", "chunk_no"], strict), ["run_id", "chunk_no"]).collect()
        got = {r.chunk_no: r.errors for r in found if r.chunk_no < 7}
        assert got == {k: e for k, e in want.items() if e}


def test_rules_hold_from_their_date(spark):
    rows = [("*", "2020-01-01", "severity", "low", "Low"), ("*", "2022-01-01", "severity", "low", "High"), ("me", "2021-01-01", "severity", "low", "Medium"),
            ("me", "2021-01-01", "include_status", "PASS", "INCLUDED"), ("me", "2099-01-01", "severity", "low", "Low")]
    versions = spark.createDataFrame(rows, "client string, valid_from string, rule string, rule_key string, rule_value string").withColumn("valid_from", F.to_date("valid_from"))
    runs = spark.createDataFrame([("a", "x", "2021-06-01"), ("b", "x", "2022-01-01"), ("c", "me", "2023-01-01"), ("d", "me", "2020-06-01"), ("e", "x", "2019-01-01"), ("f", None, "2023-01-01")],
                                 "run_id string, client string, run_date string").withColumn("run_date", F.to_date("run_date"))
    held = rule_sets.rules_of_runs(runs, versions)
    assert {r.run_id: r.rule_value for r in held.filter("rule = 'severity'").collect()} == {"a": "Low", "b": "High", "c": "Medium", "d": "Low", "f": "High"}
    found = spark.createDataFrame([("c", "PASS"), ("c", "FAIL"), ("a", "PASS")], "run_id string, scanner_status string")
    assert {(r.run_id, r.scanner_status): r.included for r in rule_sets.status_by_rules(found, held).collect()} == {("c", "PASS"): True, ("c", "FAIL"): False, ("a", "PASS"): False}
    odd = spark.createDataFrame([("*", None, "severity", "x", "Huge"), ("*", None, "include_status", "UNKNOWN", "INCLUDED"), ("*", None, "unheard", "a", "b"),
                                 ("*", None, "risk_matrix", "High_Major", "High"), ("*", None, "risk_matrix", "Major_High", "High")],
                                "client string, valid_from date, rule string, rule_key string, rule_value string")
    assert sorted((r.rule, r.rule_key) for r in rule_sets.invalid_rules(odd).collect()) == [("include_status", "UNKNOWN"), ("risk_matrix", "Major_High"), ("severity", "x"), ("unheard", "a")]


def test_ranks_over_many_parts(spark):
    """Ranks of any order columns, with one key that holds most rows, over more parts than cores."""
    rows = spark.range(4000).selectExpr("IF(id % 10 < 8, 'hot', concat('k', id % 7)) AS run_id", "id % 5 AS a", "cast(hash(id) AS string) AS b", "id")
    rows = rows.unionByName(spark.createDataFrame([(None, 1, None, -1), ("hot", None, "z", -2)], "run_id string, a long, b string, id long"))
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    try:
        got = {r.id: r.place for r in rank_rows(rows.filter("run_id IS NOT NULL"), ["run_id"], ["a", "b"], "place").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    held = {}
    for r in rows.collect():
        if r.run_id is not None:
            held.setdefault(r.run_id, []).append((r.a is not None, r.a or 0, r.b is not None, r.b or "", r.id))
    assert got == {x[-1]: k + 1 for group in held.values() for k, x in enumerate(sorted(group))}
