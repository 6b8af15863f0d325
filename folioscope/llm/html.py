"""Main text of web pages by composite text density (operator 1).

A page becomes a tree of elements. Scripts, styles, forms, menus, page headers and footers, sidebars,
notices, adverts and reader comments are cut out by element, role and class name. A class or id names noise
by its first label's first word or by a label of noise words alone. A label that ends in a noise word
("article-comments"), and a noise word elsewhere if no label has a word for articles, name noise too, unless the
element holds an article: an article, main or first-level heading element that is not cut itself. How much text a cut
takes away decides nothing; only a page of which nothing is left is read again without the cuts of this second
sort. Every remaining node
gets its link-adjusted characters-per-tag density, a piece of text that of a leaf among its parent's tags; a
node's sum is that of its children's densities. The node of the greatest sum leads (an article or main
element before another of the same sum), and the least density on its path to the body is the threshold
for what is taken beside it (``main_nodes``). The text of these subtrees, in page order, is the result.

Cases: null, empty and text-free pages give an empty text. Markup that is never closed is closed at
the end; a quoted value that is never closed ends with its tag. Pages without tags are one block. Repeated
rows are treated alike. Pages of any length are read whole, in time that grows with their length whatever
the markup. Other ties go to the earlier, outer node. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template iframe object embed applet svg math canvas audio video map form button input select "
    "textarea option datalist nav menu aside footer dialog noembed noframes xmp title".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "head", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"} | {"li", "dd", "dt"}
P_BARRIERS = frozenset("td th table button object caption".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure b i em strong span code br".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner billboard breadcrumb breadcrumbs comment "
    "comments commentlist disqus respond replies reply consent cookie cookies gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login register masthead menu menus nav navbar navigation topnav subnav pager pagination paging "
    "footer foot sidebar sidenav sidebars aside rail widget widgets related recommended recommendations share sharing social "
    "sponsor sponsored sponsors promo promos promotion outbrain taboola toolbar copyright legal disclaimer colophon skip hidden".split()
)
KEPT_WORDS = frozenset("article main content post entry story body".split())
HOLDS_ARTICLE = frozenset("article main h1".split())
MODIFIERS = frozenset("has with no without is not".split())  # "has-sidebar" tells what a block holds, not what it is
ARTICLE_NOISE = frozenset("ad ads advert comment comments promo promos related reply sponsored teaser teasers".split())

OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
TAG_STOP = re.compile(r">|=\s*([\"'])")  # a quote opens a value only after its sign
ATTRIBUTE = re.compile(r"(?:^|\s|/)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "depth", "chars", "links", "tags", "link_tags", "density", "total", "paragraph", "inner", "unsure")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.depth: int = 0 if parent is None else parent.depth + 1
        # The paragraph that is open here, and whether an article, main part or section is.
        self.paragraph: Node | None = self if tag == "p" else None if parent is None or tag in P_BARRIERS else parent.paragraph
        self.inner: bool = tag in ("article", "main", "section") or parent is not None and parent.inner
        self.children: list[Node | str] = []
        self.unsure = False  # cut, unless it holds an article
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


SURE, UNSURE = 2, 1


def noise(tag: str, attributes: str, parent: Node, forms: bool = False) -> int:
    """Whether an element starts a part that is no article text, by its name, role and class words: SURE, UNSURE
    (unless it holds an article) or 0. ``forms``: a form may hold the article."""
    if tag in DROPPED and not (forms and tag == "form"):
        return SURE
    if tag == "header" and not parent.inner:  # an article's own header is part of it
        return SURE
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    found = ATTRIBUTE.findall(attributes)
    labels = [[[w.lower() for w in WORD.findall(label)] for label in (a or b or c).split()] for name, a, b, c in found if name.lower() in ("class", "id")]
    kept = any(not KEPT_WORDS.isdisjoint(words) and words[0] not in NOISE for own in labels for words in own)
    level = 0
    for name, a, b, c in found:
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return SURE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
        if name == "role" and value.strip().lower() in ROLES:
            return SURE
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            named = ARTICLE_NOISE if tag == "article" else NOISE
            for k, label in enumerate(value.split()):
                words = [w.lower() for w in WORD.findall(label)]
                if MODIFIERS & set(words):
                    continue
                pairs = [a + b for a, b in zip(words, words[1:], strict=False)]  # "side-bar" is "sidebar"
                if not any(w in named for w in words + pairs):
                    continue
                if k == 0 and (words[0] in named or pairs[:1] and pairs[0] in named) or all(w in named for w in words) or len(words) == 2 and pairs[0] in named:
                    return SURE
                if k == 0 and (words[-1] in named or pairs[-1] in named) or not kept:
                    level = UNSURE
    return level


class Tokens:
    """The pieces of a page: (text, end sign, tag, attributes), where either text or tag is None. Every search
    goes on where the last one ended, or finds nothing and is not made again, so the time is linear."""

    def __init__(self, html: str) -> None:
        self.html, self.at = html, 0
        self.missing: dict[str, int] = {}  # strings and the place from which on they don't occur

    def _find(self, what: str, start: int) -> int:
        if start >= self.missing.get(what, len(self.html)):
            return -1
        found = self.html.find(what, start)
        if found < 0:
            self.missing[what] = start
        return found

    def _past(self, what: str, start: int) -> int:
        """The place after the next ``what``, or the end."""
        found = self._find(what, start)
        return len(self.html) if found < 0 else found + len(what)

    def _tag_end(self, start: int) -> tuple[int, int]:
        """Where the attributes that start here end, and where the tag does."""
        at = start
        while m := TAG_STOP.search(self.html, at):
            if m[1] is None:
                return m.start(), m.end()
            close = self._find(m[1], m.end())
            at = m.end() if close < 0 else close + 1
        return len(self.html), len(self.html)

    def skip_raw(self, tag: str) -> bool:
        """Moves past the end tag of an element whose content is no markup; False if there is none."""
        name = f"</{tag}"
        if name not in self.missing:
            for m in re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).finditer(self.html, self.at):
                self.at = self._past(">", m.end())
                return True
            self.missing[name] = self.at
        return False

    def __iter__(self) -> Iterator[tuple[str | None, str, str | None, str]]:
        html = self.html
        while m := OPEN.search(html, self.at):
            if m.start() > self.at:
                yield html[self.at : m.start()], "", None, ""
            if m[2] is not None:
                stop, self.at = self._tag_end(m.end())
                yield None, m[1], m[2].lower(), html[m.end() : stop]
            elif m[0] == "<!--":
                self.at = self._past("-->", m.end())
            elif m[0] == "<![CDATA[":
                self.at = self._past("]]>", m.end())
                yield html[m.end() : self.at].removesuffix("]]>"), "", None, ""
            else:
                self.at = self._past(">", m.end())
        if self.at < len(html):
            yield html[self.at :], "", None, ""


def parse(html: str, forms: bool = False, unsure: bool = True) -> Node:
    """The tree below a root; raw and dropped elements keep no text. ``unsure``: elements that are unsurely noise are
    dropped, but for those that hold an article."""
    root = Node("body", None)
    here = root
    opened: dict[str, list[Node]] = defaultdict(list)  # the open elements of each name, outer ones first
    marked: list[Node] = []  # unsurely noise,
    doubted: list[Node] = []  # and those of them that are open

    def close(node: Node) -> None:
        nonlocal here
        while True:
            last = here
            opened[last.tag].pop()
            if doubted and doubted[-1] is last:
                doubted.pop()
            here = last.parent
            if last is node:
                return

    def innermost(tags: Iterable[str]) -> Node | None:
        return max((opened[t][-1] for t in tags if opened[t]), key=lambda x: x.depth, default=None)

    tokens = Tokens(html)
    for text, end, tag, attributes in tokens:
        if tag is None:
            if text and not here.dropped:
                here.children.append(unescape(text) if "&" in text else text)
            continue
        if end:
            if opened[tag]:
                close(opened[tag][-1])
            elif tag in ("p", "br") and not here.dropped:
                here.children.append(Node("br", here))
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            if (not attributes.endswith("/") or tag not in ("svg", "math")) and not tokens.skip_raw(tag) and tag in ("script", "style", "textarea", "title", "xmp"):
                tokens.at = len(html)
            continue
        if (tag in CLOSES_P or tag == "p") and here.paragraph is not None:
            close(here.paragraph)
        if tag in SAME_LEVEL:
            up, stop = innermost(SAME_LEVEL[tag]), innermost(SCOPE[tag])
            if up is not None and (stop is None or up.depth > stop.depth):
                while up.parent.tag in SAME_LEVEL[tag]:
                    up = up.parent
                close(up)
        level = 0 if here.dropped else noise(tag, attributes, here, forms)
        node = Node(tag, here, here.dropped or level == SURE)
        if tag in HOLDS_ARTICLE and not level and not node.dropped:
            while doubted:
                doubted.pop().unsure = False
        if unsure and level == UNSURE:
            node.unsure = True
            marked.append(node)
            doubted.append(node)
        here.children.append(node)
        if tag not in VOID:
            here = node
            opened[tag].append(node)
        elif doubted and doubted[-1] is node:
            doubted.pop()
    for node in marked:
        node.dropped = node.unsure
    return root


def measure(root: Node) -> list[Node]:
    """Fills counts, densities and sums; the kept nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    for node in reversed(order):
        node.chars += sum(_length(c) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.links, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None and node is not root:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    whole = root.links / root.chars if root.chars else 0.0
    for node in order:
        node.density = density(node.chars, node.links, node.tags, node.link_tags, whole)
    for node in order:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped)
        if node.tag != "a":  # a link's own text is no text of the page's
            node.total += sum(density(n, 0, node.tags, 0, whole) for n in (_length(c) for c in node.children if isinstance(c, str)) if n)
    return order


def _length(text: str) -> int:
    words = text.split()
    return sum(map(len, words)) + len(words)


def density(chars: int, links: int, tags: int, link_tags: int, whole: float) -> float:
    """Characters per tag, lowered by the share of links among characters and tags; ``whole`` is the share
    of link characters in the page."""
    if not chars:
        return 0.0
    t, lt = max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - links, 1) * links + whole * chars + math.e)
    return chars / t * math.log(max(chars / max(links, 1) * t / lt, 1.0) + 1e-9) / max(math.log(base) if base > math.e else 1.0, 1.0)


def main_nodes(root: Node) -> list[Node | str]:
    """The parts that hold the article, in page order; none if no node has a density.

    The leading node is taken, and of the branches beside its path to the body those as dense as the
    threshold, with headings and plain text blocks that aren't mostly links. Groups of links are cut inside the leading
    node too.
    """
    lead = max(measure(root), key=lambda x: (x.total, x.tag in ("article", "main")))
    if lead.total <= 0:
        return []
    path, up, threshold = set(), lead, lead.density
    while up is not None:
        path.add(id(up))
        threshold = min(threshold, up.density)
        up = up.parent
    chosen: list[Node | str] = []
    stack: list[Node | str] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            chosen.append(x)
        elif x is lead:
            _cut_links(x, threshold)
            chosen.append(x)
        elif x.dropped or not x.chars:
            continue
        elif id(x) in path:
            stack.extend(reversed(x.children))
        elif 2 * x.links < x.chars:
            if x.density >= threshold or x.tag in PLAIN:
                chosen.append(x)
            else:
                stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return chosen


def _cut_links(lead: Node, threshold: float) -> None:
    """Drops the groups of links in the leading node: elements that group, less dense than the threshold, of which
    nearly all text is in three links or more. In an article element only those that are no lists."""
    stack = [c for c in lead.children if isinstance(c, Node)]
    while stack:
        x = stack.pop()
        if x.dropped:
            continue
        groups = x.tag in ("div", "section", "table") or x.tag in ("ul", "ol") and not x.inner
        if groups and x.link_tags >= 3 and 10 * x.links >= 9 * x.chars and x.density < threshold:
            x.dropped = True
        else:
            stack.extend(c for c in x.children if isinstance(c, Node))


def text_of(nodes: list[Node | str]) -> str:
    """Text with each block's white space turned into single spaces, blocks joined by one."""
    out: list[str] = []
    for top in nodes:
        stack: list[Node | str] = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x.dropped:
                out.append(" ")
                continue
            if x.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.children))
        out.append(" ")
    return " ".join("".join(out).split())


def extract(html: str | None) -> str:
    """The main text of a page. If nothing is left otherwise, unsure cuts are not made, and then a form around
    the whole page is opened."""
    if not html:
        return ""
    for forms, unsure in ((False, True), (False, False), (True, True), (True, False)):
        text = text_of(main_nodes(parse(html, forms, unsure)))
        if text:
            break
    return text


def main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, text, n_chars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
