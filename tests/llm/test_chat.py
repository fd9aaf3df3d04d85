"""The template language, and chat formatting read back from its output."""

import random

import pytest

from sightline.llm import chat_template as C
from sightline.llm.chat_format import CONTROLS, digest_conversations, escape, format_conversations, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def render(template, **values):
    return C.compile_template(template, {"up": str.upper}, {"sign": "!"})(values)


@pytest.mark.parametrize("template, values, expected", [
    ("plain", {}, "plain"),
    ("a{{ x }}b", {"x": 1}, "a1b"),
    ("{{ x.y | up }}", {"x": {"y": "é"}}, "É"),
    ("{{ 'a' + 'b' + sign }}", {}, "ab!"),
    ("{% if x == 'u' %}U{% elif x != 'v' %}W{% else %}V{% endif %}", {"x": "v"}, "V"),
    ("{% if not x and (1 == 1 or y) %}yes{% endif %}", {"x": "", "y": 0}, "yes"),
    ("{% for m in ms %}{% for n in m.k %}{{ n }}{% endfor %};{% endfor %}", {"ms": [{"k": "ab"}, {"k": ""}]}, "ab;;"),
    ("{% for sign in xs %}{{ sign }}{% endfor %}{{ sign }}", {"xs": "12"}, "12!"),
    ("{{ none }}|{{ 0 }}", {"none": None}, "|0"),
    ("{{ 'q\\'\\n\\\\' }}", {}, "q'\n\\"),
])
def test_rendering(template, values, expected):
    assert render(template, **values).text == expected


def test_generation_spans():
    out = render("x{% for m in ms %}{% generation %}{{ m }}{% endgeneration %}-{% endfor %}", ms=["ab", "", "é"])
    assert (out.text, out.spans) == ("xab--é-", [(1, 3), (4, 4), (5, 6)])


def test_folding():
    tree = C.fold(C.parse("a{{ 'b' | up }}{% if 1 == 2 %}no{% endif %}{% if 1 == 1 %}c{{ sign }}{% endif %}{{ x }}"), {"up": str.upper}, {"sign": "!"})
    assert tree == (C.Output(C.Const("aBc!")), C.Output(C.Name(("x",))))


@pytest.mark.parametrize("template", [
    "{% for m in x %}", "{% endif %}", "{{ }}", "{{ a b }}", "{{ (a }}", "{% while x %}{% endwhile %}", "{{ x | nope }}", "{{ f(x) }}",
    "{{ x.__class__ }}", "{{ missing }}", "{% if x %}{% else %}{% elif x %}{% endif %}", "{{ 'open }}", "{% if %}{% endif %}", "{% %}",
])
def test_sandbox_and_errors(template):
    with pytest.raises(C.TemplateError):
        render(template, x="v")


def random_text(rng):
    parts = [*CONTROLS, "\\", "<", "/s>", "[", "INST]", "[/", " ", "\n", "é", "\x00", "word", "[ROLE", "user"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def test_escape_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        text = random_text(rng)
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROLS)


def brute(rows):
    import hashlib

    found = {}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
    for conv, _, role, text in ordered:
        found.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back_like_input(spark):
    rng = random.Random(9)
    roles = ["user", "assistant", "assistant", "system", None, "", "tool[/ROLE]", "</s>", "user\n"]
    rows = [(rng.choice([*range(40), None]), rng.choice([0, 1, 2, 3, None]), rng.choice(roles), rng.choice([random_text(rng), None, ""])) for _ in range(600)]
    rows += [(1000, k, rng.choice(["user", "assistant"]), "long text " * 30) for k in range(3000)] + [rows[0]] * 3
    formatted = format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest_conversations(formatted).collect()}
    assert got == brute(rows)
    for r in formatted.collect():
        loss = "".join(unescape(r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert loss == "".join(t for role, t in read_back(r.formatted) if role == "assistant")


def test_empty_table(spark):
    formatted = format_conversations(spark.createDataFrame([], SCHEMA))
    assert digest_conversations(formatted).collect() == []


def test_like_sql(spark):
    import duckdb

    from sightline.llm.oracle import ORACLE
    from sightline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op3_chat_format"](spark, sf)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = db.sql(ORACLE["op3_chat_format"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
