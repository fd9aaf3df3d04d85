"""HTML extraction: markup cases, site templates, and the generated pages against a plain reading of them."""

import html
import re

import pytest

from sightline.llm.html_text import extract, host_of, parse

SCHEMA = "page_id long, url string, html string, text int, n_chars string"


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b<p><p>c", "a\nb\nc"), ("<P CLASS=x>a</P>b", "a\nb"),
    ("a &amp b &lt;p&gt; &#233;&#x41;&nbsp;&unknown; &am", "a & b <p> éA &unknown; &am"), ("1 < 2 <3 x", "1 < 2 <3 x"),
    ("a<br>b<b>c</b>d", "a bcd"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("x<!-- c --><script>var t='</p><p>no';</script><style>p{}</style>y", "xy"), ("x<script>open", "x"), ("x<!-- open", "x"), ("x<b title='a > b'>y</b>", "xy"),
    ("<title>t</title><p>a", "a"), ("<head><title>t</title></head><body><p>a", "a"), ("</div></p>a</article>", "a"), ("<p title=\"open>a</p>b", "a\nb"),
    ("<nav>n</nav><header>h</header><p>a</p><aside>s</aside><form>f</form><footer>f</footer>", "a"),
    ("<p>out</p><article><header><h1>T</h1></header><p>a</p><footer>x</footer><div class='share-bar'>s</div></article><p>out</p>", "T\na"),
    ("<main><p>m</p><article>a</article><article class=comment>c</article></main>", "a"), ("<main><p>m</p></main><p>o</p>", "m"),
    ("<div class='page has-sidebar'><article><p>a</p></article></div>", "a"), ("<div id=cookieNotice>c</div><div role=banner>b</div><p hidden>h</p><p>a", "a"),
    ('<article style="overflow:hidden"><p>a</p></article>', "a"), ('<article title="a hidden valley"><p>a</p></article>', "a"),
    ('<article data-id="ad-7"><p>a</p></article>', "a"), ('<article id="post-share-economy"><p>a</p></article>', "a"),
    ('<p><a href="/x?id=comments">a</a></p><img alt="hidden ad">b', "a\nb"), ("<article><p class=related-work>a</p><p class='x ad'>b</p></article>", "a"),
    ("<div data-x='1'hidden>a</div>b", "b"), ("<div ID = 'Footer'>a</div>b", "b"), ("<article hidden>a</article>", ""),
    ("<div class=head>kept</div><div class=shadow>kept</div>", "kept\nkept"), ("<pre>a\n  b</pre>", "a b"), ("<br/>a<p/>b", "a\nb"), ("<article>", ""),
])
def test_markup(source, text):
    assert parse(source).text == text


def test_hosts():
    assert [host_of(u) for u in (None, "", "x", "http://A.b/c", "s://h?q", "://")] == ["", "", "", "a.b", "h", ""]


def page(k, body, menu="<div class=top><span>Home</span><span>About us</span></div>"):
    return f"<html><body>{menu}{body}<div>All rights reserved</div></body></html>"


def test_templates_per_host(spark):
    rows = [(k, f"http://a.example/{k}", page(k, f"<p>Text {k}</p><div><p>More {k}</p></div>")) for k in range(8)]
    rows += [(100 + k, f"http://B.example/{k}", page(k, f"<p>Once {k}</p>")) for k in range(2)]  # too few pages to tell
    rows += [(200 + k, f"http://c.example/{k}", f"<article><h1>Same</h1><p>Repeated article.</p></article><p>menu {k % 2}</p>") for k in range(9)]
    rows += [(300, None, None), (301, None, ""), (302, "no host", "<p>x</p>"), (303, "http://a.example/9", "y" * 300_000 + "<b>" * 3000), (0, rows[0][1], rows[0][2])]
    got = extract(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    text = {r.page_id: r.text for r in found}
    assert all(text[k] == f"Text {k}\nMore {k}" for k in range(8))
    assert text[100] == "Home About us\nOnce 0\nAll rights reserved".replace("Home About us", "HomeAbout us")
    assert all(text[200 + k] == "Same\nRepeated article." for k in range(9))
    assert (text[300], text[301], text[302], text[303]) == ("", "", "x", "y" * 300_000)


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert got.keys() == source.keys()
    for k, h in source.items():
        body = re.search(r"<article>(.*)</article>", h, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|li|div|ul)>", body)]
        assert got[k] == "\n".join(b for b in blocks if b)


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_copied_articles_are_no_template(spark):
    """Exact and near copies on a host keep their text, whatever elements hold it."""
    bodies = ["<div><p>First words here.</p></div>", "<ul><li>One item</li><li>Two <b>items</b></li></ul>", "<table><tr><td>cell</td></tr></table>", "<section><h2>Head</h2></section>"]
    share = "<div class=x><a href=/s>Share this</a></div><div>Read our terms</div>"
    rows = []
    for k in range(12):  # near copies: one paragraph differs
        rows.append((k, "http://n.example/", f"<div>menu</div><article>{''.join(bodies)}{share}<p>Own {k % 4}</p></article>"))
    for k in range(6):  # exact copies without an article
        rows.append((50 + k, "http://p.example/", "<div>menu</div><p>Same page.</p><div><p>All of it.</p></div>"))
    for k in range(6):
        rows.append((70 + k, "http://q.example/", f"<div>menu</div><p>Page {k}.</p>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"First words here.\nOne item\nTwo items\ncell\nHead\nOwn {k % 4}" for k in range(12))
    assert all(got[50 + k] == "menu\nSame page.\nAll of it." for k in range(6))
    assert all(got[70 + k] == f"Page {k}." for k in range(6))


def plain_texts(pages, min_pages=3, min_share=0.2):
    """Counting and removal on well-formed pages by the standard library's trees, one host after the other."""
    import xml.etree.ElementTree as ET

    def blocks(e, drop):
        """Texts of the paragraphs below ``e``, without elements equal to one of ``drop``."""
        if ET.tostring(e) in drop:
            return []
        if e.tag == "p":
            return [" ".join("".join(e.itertext()).split())]
        own = [" ".join(e.text.split())] if e.text and e.text.strip() and e.tag == "div" else []
        return own + [b for c in e for b in blocks(c, drop)]

    out = {}
    for host in {h for _, h, _ in pages}:
        trees = {k: ET.fromstring(x) for k, h, x in pages if h == host}
        bare = {k: "\n".join(blocks(t, ())) for k, t in trees.items()}
        texts = {}
        for k, t in trees.items():
            for e in t.iter():
                if e.tag in ("div", "p") and "".join(e.itertext()).strip():
                    texts.setdefault(ET.tostring(e), set()).add(bare[k])
        least = max(min_pages, min_share * len(set(bare.values())))
        template = {x for x, seen in texts.items() if len(seen) >= least}
        out |= {k: "\n".join(b for b in blocks(t, template) if b) for k, t in trees.items()}
    return out


def test_like_plain_counting(spark):
    import random

    rng = random.Random(9)
    part = lambda k: f"<p>part {k}</p>" if k % 3 else f"<div>box {k}<p>in {k}</p></div>"
    rows = []
    for k in range(150):
        own = [part(rng.choice([1, 2, 3, 4, 5, 6]) if rng.random() < 0.5 else rng.randrange(20, 400)) for _ in range(rng.randrange(1, 7))]
        rows.append((k, f"http://h{k % 5}.example/x", f"<body>{''.join(own)}</body>"))
    rows += [(1000 + k, u, h) for k, (_, u, h) in enumerate(rows[:30])]  # copies
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == plain_texts([(k, host_of(u), h) for k, u, h in rows])
    assert any("part 1" in h and "part 1" not in got[k] for k, _, h in rows)
