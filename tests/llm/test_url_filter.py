"""URL filter: parsing and rules against plain Python, and the verdicts of the model."""

import re

import pytest

from sightline.llm.url_filter import RULES, judge_urls, labelled_urls, train

URLS = [
    None, "", "x", "example.org/es/", "http://", "HTTP://Example.ORG/es/1", "https://a.b.example.org/es/x?y#z", "https://example.org/en/1", "https://example.org/en/17.html",
    "https://example.org/en/2", "https://notexample.org/es/1", "https://x.com/fr/", "https://x.com/fr", "http://com/fr/1", "https://x.com/de/1", "https://x.com/de#/de/", "http://org",
    "http://org/", "http://h?u=http://x.org/", "a\nb://É.Org/é\nb?c", "http://h://x/y", "s://" + "h" * 50_000 + "/" + "p" * 50_000,
]


def plain(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None, None
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_parsing_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string, verdict string")
    got = judge_urls(pages)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "block_score", "verdict"]
    rows = got.collect()
    assert len(rows) == len(URLS) + 3
    for r in rows:
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score > 0.5 else "allow"))


@pytest.mark.parametrize("host, verdict", [
    ("blog.casino-win", "block"), ("m.adult-x", "block"), ("free-bets", "block"), ("www.cheap-pills", "block"), ("m.ads-track", "block"), ("spam-farm", "block"),
    ("www.rivers-museum", "allow"), ("blog.ththor", "allow"), ("m.tiontion", "allow"), ("old-library", "allow"), ("farm-news", "allow"),
])
def test_model_reads_names(spark, host, verdict):
    rows = [(f"http://{host}.example.net/{lang}/{n}",) for lang in ("en", "fr") for n in (3, 4711)]
    if not hasattr(spark, "_url_model"):
        spark._url_model = train(labelled_urls(spark))
    from unittest import mock

    from sightline.llm import url_filter

    with mock.patch.object(url_filter, "train", lambda *a, **k: spark._url_model):
        assert {r.verdict for r in judge_urls(spark.createDataFrame(rows, "url string")).collect()} == {verdict}


def test_no_python_on_the_main_path(spark):
    from sightline.llm import url_filter

    frame = spark.sql("SELECT 1L AS page_id, 'http://a.b/c' AS url")
    plan = frame.select(*url_filter.host_and_path(frame.url), url_filter.features(frame.url, frame.url))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "url string, blocked double")
    assert judge_urls(pages, labels).collect() == []
    assert judge_urls(spark.createDataFrame([("http://a.b/",)], "url string"), labels).first().verdict == "allow"
