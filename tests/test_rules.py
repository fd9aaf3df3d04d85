"""Single rules on literal values."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import controls as cf
from sightline.functions import findings as fn
from sightline.functions import responses, text
from sightline.operators.numbering import number_rows
from sightline.rules import Rules, load_control_rules, load_rules, risk_rating, validate


def apply(spark, expr, *rows, names=("a", "b", "c")):
    width = len(rows[0])
    schema = ", ".join(f"{n} STRING" for n in names[:width])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i INT, {schema}")
    out = df.select("i", expr(*[F.col(n) for n in names[:width]]).alias("v")).orderBy("i")
    return [r.v for r in out.collect()]


def test_reconcile_status(spark):
    cases = {
        ("FAIL", "True"): ("MUTED(FAIL)", True, False), ("PASS", "yes"): ("MUTED(PASS)", True, False),
        ("MUTED(MANUAL)", "1"): ("MUTED(MANUAL)", False, False), ("MUTED(BOGUS)", "true"): ("MUTED(FAIL)", False, False),
        (None, "True"): ("MUTED(FAIL)", True, False), ("odd", "True"): ("MUTED(FAIL)", True, False),
        ("fail", "False"): ("FAIL", False, False), ("MUTED(PASS)", None): ("MUTED(PASS)", False, False),
        ("MUTED(BOGUS)", "no"): ("UNKNOWN", False, True), ("weird", None): ("UNKNOWN", False, False),
        (None, None): ("UNKNOWN", False, False),
    }
    assert [tuple(v) for v in apply(spark, fn.reconcile_status, *cases)] == list(cases.values())


def test_resource_id(spark):
    cases = {
        ("arn:aws:s3:::b//", "n"): "arn:aws:s3:::b", ("ARN:aws:s3:::b/", None): "ARN:aws:s3:::b", ("plain/", "n"): "plain/",
        (None, "n"): "n", (None, None): "",
    }
    assert apply(spark, fn.resource_id, *cases) == list(cases.values())


def test_lists_tags_compliance(spark):
    assert apply(spark, text.pipe_list, ("a | b||",), (None,), (" | ",)) == [["a", "b"], [], []]
    assert apply(spark, text.tag_map, ("k:v | a:b:c | x | k: w ",), (None,)) == [{"k": "w", "a": "b:c", "x": ""}, {}]
    got = apply(spark, text.compliance, ("CIS | 1",), (None,), ("|",), ('["a"]',))
    assert [tuple(v) for v in got] == [(["CIS", "1"], True), ([], False), (["|"], False), (['["a"]'], True)]


def test_html(spark):
    cases = {
        "<b>A</b> &amp; &eacute;<div class='policy-indicators'><a>x</a></div>": "A & é", "a < b": "a < b",
        '<a title="x>y">t</a><!-- c --><script>if (a<b) "</p>"</script>': 't' + 'if (a<b) "</p>"', "cut <a href": "cut", "&amp;lt;": "&lt;", None: "",
    }
    assert apply(spark, text.strip_html, *[(c,) for c in cases]) == list(cases.values())


def test_instance_count(spark):
    cases = {"6 role(s) that contain": 6, "3 conditional access policy(s)": 1, "0 user(s)": 1, None: 1, "é 12 rôle(s)": 12}
    assert apply(spark, text.instance_count, *[(c,) for c in cases]) == list(cases.values())


def test_cells_and_slugs(spark):
    assert apply(spark, text.sanitise_cell, (" =1+1",), ("x",), (None,), ("@a",)) == [" =1+1", "x", "", " @a"]
    assert apply(spark, text.client_slug, (" Acme / Co ",), ("",)) == ["acme___co", "default"]
    assert apply(spark, text.client_folder, (" Acme  / Co. ",), ("//",)) == ["Acme_Co.", "output"]


def test_services(spark):
    rules = Rules()
    got = apply(spark, lambda c: cf.resolve_service(c, rules.control_services), ("MS.AAD.3.1v1",), ("ms.teams.1.1v1",), ("MS.FOO.1.1v1",), ("",))
    assert [v.ref_prefix for v in got] == ["ENT", "TEA", "M365", "M365"]
    assert apply(spark, cf.clean_control, (" N/A ",), ("System.Object[]",), (" x ",)) == [None, None, "x"]
    got = apply(spark, lambda c: cf.control_severity(c, {"May": "low"}), ("Shall/x",), ("should",), ("May",), ("odd",), (None,))
    assert got == ["high", "medium", "low", "low", "medium"]


def test_responses(spark):
    good = '{"a": 1}'
    cases = {good: good, f"```json\n{good}\n```": good, f"Sure: {good} done": good, "nothing": None, None: None}
    assert apply(spark, responses.json_object, *[(c,) for c in cases]) == list(cases.values())
    items = lambda body, want: responses.grouping_errors(responses.proposal_items(body), F.split(want, ","))
    ok = '[{"group_name": "g", "check_ids": ["a", "b"], "rationale": "r"}]'
    twice = '[{"group_name": "g", "check_ids": ["a", "a", "z"], "rationale": ""}]'
    assert apply(spark, items, (ok, "a,b"), (twice, "a,b"), (None, "a")) == [
        [],
        ["Group 0: missing or empty 'rationale'", "check_id 'a' appears in more than one group", "Missing check_ids: b", "Unknown check_ids: z"],
        ["Expected a non-empty JSON array of groups"],
    ]


def test_rules():
    config = {"processing": {}, "severity_rules": {"low": "Medium", "likelihood_high_if_categories": ["x"]}, "risk_matrix": {"Low_Minor": "Low"}, "output": {}}
    rules = load_rules(config)
    assert rules.severity_rules["low"] == "Medium" and rules.high_if_categories == ("x",)
    with pytest.raises(ValueError):
        load_rules({"processing": {}})
    with pytest.raises(ValueError):
        validate(Rules(include_statuses=("BROKEN",)))
    with pytest.raises(ValueError):
        validate(Rules(risk_matrix={"High-Major": "High"}))
    assert load_control_rules({"service_map": {"ms.x": {"section": "X", "ref_prefix": "XX"}}}).control_services["MS.X"] == ("X", "XX")


def test_risk(spark):
    got = apply(spark, lambda l, c: risk_rating(l, c, Rules().risk_matrix), ("High", "Minor"), ("Low", "Minor"), ("Low", "Huge"))
    assert got == ["High", "Low", "Medium"]


def test_numbering_is_exact_over_buckets(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3 == 0).alias("k"), (F.col("id") * 7).alias("seq")).repartition(5)
    got = number_rows(df, ["k"], ["seq"], width=100).orderBy("k", "seq").collect()
    seen: dict = {}
    for r in got:
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.pos == seen[r.k]
