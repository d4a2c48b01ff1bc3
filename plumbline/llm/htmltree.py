"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of style paths (tag and class of every element from the root down). For
each path the tree counts how many pages show which presentation (the tags of its children) and which content (a
hash of its text). A node's importance is the entropy of these counts over the pages that have it, divided by the
logarithm of their number, so content that differs from page to page is near 1 and a repeated menu near 0. A branch
is removed from a page if its importance is under `least` on a host with at least `min_pages` pages of it, or if its
tag, role or class names it as furniture. The article (or main) element itself and what it lies in are not judged by
importance, only the branches inside. What is left of the article (or, where no element is marked as one, of the
page) is the text.

A class or id names furniture if all its parts (between - and _) are furniture names or plain layout words, so
`site-footer` does and `legal-analysis` does not. A header is furniture wherever it stands, but the headings in an
article's own header are the article's and stay. Furniture inside a line (a link, a button) goes without cutting the
block around it.

Paths are 64-bit hashes, made from the parent's, and content hashes are folded upwards as elements close, so a page
costs time and memory in proportion to its length however deep it is. Rows of the tree are counted by (host, path,
content) before they meet by (host, path), so a host with a third of all pages spreads over the tasks.

Edge cases: null html is an empty page and has no text; a null or odd url has the host '' ; unclosed and stray tags
are closed or ignored; a tag cut off by the end of the page is markup; repeated rows count as pages each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from plumbline.llm.common import as_string, slices, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW = frozenset("script style noscript template textarea iframe object svg math select option button title head canvas audio video".split())
#: Of these the content is not parsed as markup.
OPAQUE = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body p div article section main header footer nav aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hgroup dialog center".split())
NOISE_TAGS = frozenset("nav header footer aside form dialog menu head title".split())
#: Furniture that may stand inside a line of text.
INLINE_NOISE = RAW - OPAQUE - NOISE_TAGS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOISE_NAMES = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header footer masthead sidebar side aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies disqus respond form search pagination pager skip toolbar copyright legal disclaimer".split())
#: Layout words that may stand beside a furniture name.
LAYOUT_NAMES = frozenset("site page main top bottom left right center box wrap wrapper container inner outer block list item items area section global primary secondary bar slot unit panel row col column link links button buttons icon icons post posts entry article articles content text title small large mobile desktop sticky fixed js is has the".split())
#: start tag -> open elements that it closes
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}} | {t: {"p"} for t in BLOCK - {"html", "body"}}
LEAST, MIN_PAGES = 0.3, 10
#: Up to so many low paths (16 bytes each) go to every task; beyond, pages meet them by (host, salt).
MAX_BROADCAST, SALTS = 500_000, 32
WORD = (1 << 64) - 1


def host_of(url):
    """The part between // and the next / ? # of a url, without user and port, in lower case; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def attributes_of(source: str) -> dict[str, str]:
    """Names in lower case with their values; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), next(filter(None, values), ""))
    return found


@lru_cache(1 << 14)
def names_furniture(name: str) -> bool:
    parts = [p for p in re.split(r"[^a-z]+", name.lower()) if p]
    return any(p in NOISE_NAMES for p in parts) and all(p in NOISE_NAMES or p in LAYOUT_NAMES for p in parts)


def marks(tag: str, found: dict[str, str]) -> tuple[str, bool]:
    """(style name, is furniture by name, role or visibility)."""
    classes = found.get("class", "").lower().split()
    noise = found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    noise = noise or any(map(names_furniture, classes)) or names_furniture(found.get("id", "")) or bool(UNSEEN.search(found.get("style", "")))
    return tag + "".join(f".{c}" for c in sorted(classes)), noise


@lru_cache(1 << 16)
def _hash(text: str) -> int:
    return xxh64_intdigest(text)


def fold(a: int, b: int) -> int:
    return ((a ^ b) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 ^ (a >> 29)) & WORD


class Element:
    """An open element: its path, its flags (inherited from its parent), what is folded of its children and content, and the block it lies in (home)."""

    __slots__ = ("tag", "path", "home", "block", "heading", "noise", "header", "inline", "article", "main", "low", "low_article", "low_main", "style", "content")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.block, self.style, self.content = tag, False, 0, 0
        self.home, self.heading = (self, False) if parent is None else (parent.home, parent.heading or tag in HEADINGS)
        if parent is None:
            self.path, self.noise, self.header, self.inline, self.article, self.main, self.low, self.low_article, self.low_main = (1, *[False] * 8)
        else:
            self.path, self.noise, self.header, self.inline, self.article, self.main = parent.path, parent.noise, parent.header, parent.inline, parent.article, parent.main
            self.low, self.low_article, self.low_main = parent.low, parent.low_article, parent.low_main


class Page:
    """Blocks of a page in order, as (text, low, in article, low in it, in main, low in it), without named furniture; and
    the nodes of its style tree: path -> (presentation, content). low: paths of the host that are unimportant."""

    def __init__(self, source: str, low: frozenset[int] = frozenset()):
        self.blocks: list[tuple[str, bool, bool, bool, bool, bool]] = []
        self.nodes: dict[int, tuple[int, int]] = {}
        self.marked = [False, False]
        self._low, self._parts, self._open_tags = low, [], Counter()
        self._stack = [Element("", None)]
        self._read(source)

    def _end_block(self) -> None:
        if not self._parts:
            return
        parts, self._parts = self._parts, []
        e = self._stack[-1].home
        words = entities.unescape("".join([t for t, _ in parts])).split()
        if not words:
            return
        e.content = fold(e.content, xxh64_intdigest(" ".join(words)))
        self.marked[0] |= e.article
        self.marked[1] |= e.main
        if not e.noise and not (e.header and not (e.article and e.heading)):
            if any(inline for _, inline in parts):
                words = entities.unescape("".join([t for t, inline in parts if not inline])).split()
            if words:
                self.blocks.append((" ".join(words), e.low, e.article, e.low_article, e.main, e.low_main))

    def _pop(self) -> None:
        e = self._stack.pop()
        self._open_tags[e.tag] -= 1
        if e.block:
            style, content = self.nodes.get(e.path, (0, 0))
            self.nodes[e.path] = fold(style, e.style), fold(content, e.content)
            up = self._stack[-1].home
            up.content = fold(up.content, e.content)

    def _open(self, tag: str, source: str) -> None:
        if tag in CLOSES and any(self._open_tags[t] for t in CLOSES[tag]):
            closes = CLOSES[tag]
            for i in range(len(self._stack) - 1, 0, -1):
                own = self._stack[i].tag
                if own in closes:
                    self._end_block()
                    while len(self._stack) > i:
                        self._pop()
                    break
                if own in BLOCK:
                    break
        found = attributes_of(source) if source else {}
        parent = self._stack[-1]
        if tag in BLOCK or tag in NOISE_TAGS:
            self._end_block()
            e = Element(tag, parent)
            style, noise = marks(tag, found)
            up = parent.home
            own = _hash(style)
            up.style = fold(up.style, own)
            e.home, e.block, e.inline, e.path = e, True, False, fold(up.path, own)
            if tag not in ("html", "body"):
                e.noise = parent.noise or parent.inline or noise or tag in NOISE_TAGS and tag != "header"
                e.header = parent.header or tag == "header"
            if e.path in self._low:
                e.low, e.low_article, e.low_main = True, parent.article, parent.main
            e.article = parent.article or tag == "article" or found.get("role", "").lower() == "article"
            e.main = parent.main or tag == "main" or found.get("role", "").lower() == "main"
        else:
            e = Element(tag, parent)
            e.inline = parent.inline or tag in INLINE_NOISE or bool(found) and marks(tag, found)[1]
        self._stack.append(e)
        self._open_tags[tag] += 1

    def _close(self, tag: str) -> None:
        if not self._open_tags[tag]:
            return
        at = next(i for i in range(len(self._stack) - 1, 0, -1) if self._stack[i].tag == tag)
        if any(e.block for e in self._stack[at:]):
            self._end_block()
        while len(self._stack) > at:
            self._pop()

    def _text(self, text: str) -> None:
        self._parts.append((text, self._stack[-1].inline))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if (tag := m.group(2)) is None:
                continue
            tag = tag.lower()
            if m.group(1):
                self._close(tag)
            elif tag == "br" or tag == "hr":
                self._end_block()
            elif tag in VOID:
                continue
            elif tag in OPAQUE:
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
            elif not m.group(3).endswith("/"):
                self._open(tag, m.group(3))
        self._end_block()
        while len(self._stack) > 1:
            self._pop()


def style_nodes(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """host, path, kind (0 presentation, 1 content), sig, n: the merged trees, counted by batch first."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_html"):
                seen: Counter = Counter()
                for host, source in zip(part.column("_host").to_pylist(), as_string(part.column("_html")).to_pylist(), strict=True):
                    for path, (style, content) in Page(source).nodes.items():
                        seen[host, path, 0, style] += 1
                        seen[host, path, 1, content] += 1
                cols = list(zip(*[(*k, n) for k, n in seen.items()], strict=True)) or [[]] * 5
                signed = lambda c: pa.array(np.array(c, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), signed(cols[1]), pa.array(cols[2], pa.int32()), signed(cols[3]), pa.array(cols[4], pa.int64())], ["host", "path", "kind", "sig", "n"])

    slim = pages.select(F.xxhash64(host_of(F.col(url))).alias("_host"), F.col(html).cast("string").alias("_html"))
    return slim.mapInArrow(run, "host long, path long, kind int, sig long, n long")


def importance(nodes: DataFrame) -> DataFrame:
    """host, path, n_pages, importance: the greater of the entropies of presentation and content, from 0 to 1."""
    counted = nodes.groupBy("host", "path", "kind", "sig").agg(F.sum("n").alias("n"))
    per = counted.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    entropy = F.when(F.col("m") > 1, (F.log2("m") - F.col("nl") / F.col("m")) / F.log2("m")).otherwise(F.lit(1.0))
    return per.withColumn("e", entropy).groupBy("host", "path").agg(F.max("m").alias("n_pages"), F.max("e").alias("importance"))


def main_text(page: Page) -> str:
    """Blocks of the articles if the page marks any, else of main, else of the page; each less its unimportant branches."""
    if page.marked[0]:
        return "\n".join([b[0] for b in page.blocks if b[2] and not b[3]])
    if page.marked[1]:
        return "\n".join([b[0] for b in page.blocks if b[4] and not b[5]])
    return "\n".join([b[0] for b in page.blocks if not b[1]])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: float = LEAST, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """key, url, text. Two passes over the pages: the tree, then the text; pages meet the low paths of their host by a join."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    weak = written(importance(style_nodes(pages, key, url, html)).where((F.col("n_pages") >= min_pages) & (F.col("importance") < least)), "styles")
    per_host = weak.groupBy("host").agg(F.collect_set("path").alias("low"))  # style paths of a host, whatever its number of pages
    slim = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.xxhash64(host_of(F.col(url))).alias("host"), F.col(html).cast("string").alias("_html"))
    if weak.count() <= max_broadcast:
        met = slim.join(F.broadcast(per_host), "host", "left")
    else:
        salted = per_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = slim.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_html"):
                lows = [frozenset(np.array(x, np.int64).view(np.uint64).tolist()) if x else frozenset() for x in part.column("low").to_pylist()]
                texts = [main_text(Page(source, low)) for low, source in zip(lows, as_string(part.column("_html")).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_url"), pa.array(texts, pa.string())], ["_key", "_url", "text"])

    found = met.select("_key", "_url", "low", "_html").mapInArrow(run, f"_key {kinds[key]}, _url {kinds[url]}, text string")
    return found.select(F.col("_key").alias(key), F.col("_url").alias(url), "text")
