"""Main text of web pages: site templates removed by counting element subtrees per host.

1. Every page is parsed; each element outside prose gets a hash of its tag and content.
2. Spark counts with how many different main texts of a host each hash occurs, so copies of a page count once.
   Subtrees that recur with many of them are template.
3. Every page is parsed again; template subtrees, and elements that are boilerplate by tag, role or class, go.
   What is left of the article (or of ``main``, or of the page) is joined block by block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import materialise

#: A subtree is template if it occurs with so many different main texts of its host, and with this share of them.
MIN_PAGES = 3
MIN_SHARE = 0.2

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup li dd dt".split())
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption b i em strong a span code small sub sup u br".split())

#: Boilerplate by tag, by role, and by a word of class or id.
DROP_TAGS = frozenset("head title script style noscript template iframe svg canvas object nav aside footer form button select textarea dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner popup "
    "modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comments comment "
    "disqus replies reply respond share sharing social related recommended recommendations widget widgets toolbar pagination pager".split()
)

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HOST = re.compile(r"://([^/?#]*)")


def host_of(url: str | None) -> str:
    m = _HOST.search(url or "")
    return m[1].lower() if m else ""


def attributes_of(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return found


def _is_boilerplate(tag: str, source: str, in_article: bool) -> bool:
    """Whether an element is boilerplate by its tag, role or names.

    Articles, and prose elements inside them, go by a whole class name only: a word inside a name or an id, as in
    ``post-share-economy``, may be what the text is about.
    """
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True
    if not source or tag in ("html", "body", "main"):
        return False
    attributes = attributes_of(source)
    if attributes.get("role", "").lower() in DROP_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    classes = attributes.get("class", "")
    if tag == "article" or (in_article and tag in _PROSE):
        return not DROP_WORDS.isdisjoint(classes.lower().split())
    return any(not DROP_WORDS.isdisjoint(w.lower() for w in _WORD.findall(v)) for v in (classes, attributes.get("id", "")))


@dataclass
class _Element:
    tag: str
    start: int  # pieces before it
    drop: bool
    in_article: bool
    prose: bool = False  # holds text of an article that is in a prose block and in no link
    content: list[str] = field(default_factory=list)


@dataclass
class Page:
    """A parsed page: hashes of the subtrees that may be template, and the text left after removal."""

    subtrees: set[int]
    text: str


def parse(source: str, template: frozenset[int] | set[int] = frozenset()) -> Page:
    """Read a page; subtrees whose hash is in ``template`` and boilerplate elements leave no text.

    Elements of an article that are prose or hold some are never template, since articles may repeat; nor is an
    element that holds an article.  Prose is text in a paragraph, heading, list item or cell that is no link.  Broken markup is read as browsers mostly do: unknown end tags are ignored, open
    elements end with their parent.
    """
    pieces: list[str | None] = []  # text, and None where a block begins or ends
    stack = [_Element("", 0, False, False)]
    mains: list[tuple[int, int, str]] = []
    subtrees: set[int] = set()

    def close() -> None:
        nonlocal mains
        e = stack.pop()
        content = "\x01".join(e.content)
        digest = xxhash.xxh64_intdigest(f"{e.tag}\x02{content}".encode("utf-8", "surrogatepass")) >> 1
        stack[-1].content.append(f"{digest:x}")
        has_main = bool(mains) and mains[-1][0] >= e.start
        drop = e.drop and not (has_main and e.tag not in DROP_TAGS)
        held = e.in_article and (e.tag in _PROSE or e.prose)
        if not drop and not has_main and content and e.tag not in ("html", "body", "main", "article") and not held:
            subtrees.add(digest)
            drop = digest in template
        stack[-1].prose |= e.prose and not drop
        if drop:
            del pieces[e.start :]
            mains = [m for m in mains if m[0] < e.start]
        if e.tag in _BLOCK:
            pieces.append(None)
        if not drop and e.tag in ("article", "main"):
            mains = [m for m in mains if m[0] < e.start or m[2] != e.tag]  # the outermost counts
            mains.append((e.start, len(pieces), e.tag))

    def close_through(depth: int) -> None:
        while len(stack) > depth:
            close()

    def innermost(tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> int | None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in barrier:
                return None
        return None

    def add_text(text: str) -> None:
        if text:
            pieces.append(html.unescape(text) if "&" in text else text)
            if text.strip():
                if stack[-1].in_article and not any(e.tag == "a" for e in stack):
                    inner = next((e for e in reversed(stack) if e.tag in _BLOCK), None)
                    if inner is not None and inner.tag in _PROSE:
                        inner.prose = True
                stack[-1].content.append(" ".join(text.split()))

    at = 0
    while True:
        m = _MARKUP.search(source, at)
        add_text(source[at : m.start()] if m else source[at:])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = innermost({tag}, frozenset())
            if depth:
                close_through(depth)
            continue
        if tag in _CLOSES_P and (depth := innermost({"p"}, {"table", "td", "th", "button"})):
            close_through(depth)
        if tag in _SIBLINGS:
            tags, barrier = _SIBLINGS[tag]
            while depth := innermost(tags, barrier):
                close_through(depth)
        if tag in _BLOCK or tag == "br":
            pieces.append(" " if tag == "br" else None)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK and tag not in _RAW:
            continue
        in_article = stack[-1].in_article or tag in ("article", "main")
        stack.append(_Element(tag, len(pieces), _is_boilerplate(tag, m[3], stack[-1].in_article), in_article))
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            stop = end.start() if end else len(source)
            at = stop
    close_through(1)
    return Page(subtrees, _join(pieces, mains))


def _join(pieces: list[str | None], mains: list[tuple[int, int, str]]) -> str:
    for tag in ("article", "main"):
        ranges = [(a, b) for a, b, t in mains if t == tag]
        if ranges:
            break
    else:
        ranges = [(0, len(pieces))]
    blocks: list[str] = []
    for a, b in ranges:
        held: list[str] = []
        for piece in [*pieces[a:b], None]:
            if piece is not None:
                held.append(piece)
            elif held:
                block = " ".join("".join(held).split())
                blocks += [block] if block else []
                held = []
    return "\n".join(blocks)


def template_subtrees(pages: DataFrame, url_column: str, html_column: str, min_pages: int, min_share: float) -> DataFrame:
    """(host, subtrees): hashes of the subtrees that occur with many different main texts of the host.

    A page has a bounded number of subtrees, and each listed one occurs with ``min_share`` of the texts, so a host's
    list holds at most ``1 / min_share`` times the subtrees of an average page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, int, int]] = set()
            for url, source in zip(batch.column(0), batch.column(1)):
                page = parse(source.as_py() or "")
                text = xxhash.xxh64_intdigest(page.text.encode("utf-8", "surrogatepass")) >> 1
                found.update((host_of(url.as_py()), h, text) for h in (-1, *page.subtrees))  # -1: the page itself
            hosts, hashes, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(texts, pa.int64())], names=["host", "subtree", "main_text"],
            )

    seen = pages.select(url_column, html_column).mapInArrow(run, "host string, subtree long, main_text long").distinct()
    counts = materialise(seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(f"subtree = -1 OR n >= {min_pages}"), "subtree_counts")
    size = counts.where("subtree = -1").select("host", F.col("n").alias("texts"))
    many = counts.where("subtree <> -1").join(size, "host").where(F.col("n") >= min_share * F.col("texts"))
    return many.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("subtrees"))


def extract(
    pages: DataFrame, url_column: str = "url", html_column: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
) -> DataFrame:
    """All columns of ``pages`` except the html, with ``text`` and ``n_chars`` (code points).

    Blocks are joined by one line feed; white space inside a block is one space.  Null html is an empty page
    with empty text; pages whose url is null or has no host count as one host.  Pages with the same main text,
    repeated rows among them, count once.  Existing columns with the result's names are replaced.
    """
    pages = pages.drop("text", "n_chars", "__host", "__template")
    template = materialise(template_subtrees(pages, url_column, html_column, min_pages, min_share), "site_templates")
    carried = [c for c in pages.columns if c != html_column]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_column), F.lit("")), r"://([^/?#]*)", 1))
    joined = pages.withColumn("__host", host).join(
        template.select(F.col("host").alias("__host"), F.col("subtrees").alias("__template")), "__host", "left"
    ).select(*carried, html_column, "__template")
    schema = T.StructType([*pages.drop(html_column).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [parse(h.as_py() or "", set(t.as_py() or ())).text for h, t in zip(batch.column(len(carried)), batch.column(len(carried) + 1))]
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *added], names=schema.names)

    return joined.mapInArrow(run, schema)
