"""Fill-in-middle: direct string versions, exact round trips, sentinels."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import fill_middle as fim


def by_slices(doc_id, text):
    """The same forms by cutting strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return "plain", None, None, text
    n = len(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_like_string_slices(spark):
    rng = random.Random(5)
    letters = "ab <>PSM\n\té漢😀"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "é" * 300_001 + "x"), (903, "same"), (903, "same"), (None, "no id"), (None, None), (904, "a<M>b")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, form string")
    found = fim.fill_in_middle(docs).collect()
    assert len(found) == len(rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        form, prefix, middle, output = by_slices(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (len(r.text or ""), form, prefix, middle, output)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text("<>PSMé漢 a", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]), st.integers(1, 5))
def test_round_trip(text, a, b, form, piece):
    marks = fim.Sentinels()
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    first, second = sorted((min(a, len(text)), min(b, len(text))))
    buffer = bytearray(text, "utf-8")
    old, fim.PIECE = fim.PIECE, piece  # reversals in many pieces
    try:
        fim.transform(buffer, *fim.byte_offsets(text, first, second), form, marks)
        p, m, s = text[:first], text[first:second], text[second:]
        assert buffer.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
        fim.restore(buffer, form, marks)
    finally:
        fim.PIECE = old
    assert buffer.decode() == text


def test_other_sentinels_and_rates(spark):
    marks = fim.Sentinels("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, f"text <P> number {i}") for i in range(60)], "doc_id long, text string")
    rows = fim.fill_in_middle(docs, marks=marks, rates=fim.Rates(plain=0, spm=100, seed="x")).collect()
    assert all(r.form == "spm" and r.output.startswith("[suf]") for r in rows)
    assert all(r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    for bad in (("aa", "b", "c"), ("", "b", "c"), ("x", "x", "c"), ("<a>", "a", "c"), ("<a", "a<", "c")):
        if bad == ("aa", "b", "c"):  # "aa" can begin inside itself
            with pytest.raises(ValueError):
                fim.Sentinels(*bad)
            continue
        with pytest.raises(ValueError):
            fim.Sentinels(*bad)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(docs).collect() == []
