"""HTML extraction by composite text density."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the HTML standard: elements without content, elements whose content is raw text, elements that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend li option optgroup tbody td tfoot th thead tr".split()) | {"dd", "dt", "li"}
#: A start tag ends an open element of these kinds, up to the barrier.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
#: Elements, roles and words of class or id that mark what is not the article.
DROPPED = frozenset("nav footer aside form button select datalist dialog menu head template svg math object audio video canvas map fieldset input label search".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager footer masthead topbar toolbar cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related "
    "recommended recommendations widget widgets comment comments commentlist disqus respond replies reply skip".split()
)
PAGE_MARKS = frozenset({"header", "hero"})
KEPT_TAGS = frozenset({"html", "body", "article", "main"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
TOKEN = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
MARK = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.dropped = tag, parent, [], False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def marked(tag: str, raw: str, in_article: bool) -> bool:
    """Whether an element's own tag and attributes say that it is not part of the article."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not raw or tag in KEPT_TAGS:
        return False
    for name, *values in ATTRIBUTE.findall(raw):
        name, value = name.lower(), html.unescape("".join(values))
        if name in ("class", "id"):
            words = {w.lower() for w in MARK.findall(value)}
            if words & MARKS or (words & PAGE_MARKS and not in_article):
                return True
        elif name == "role" and value.strip().lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


def parse(page: str) -> tuple[Node, list[Node], list[tuple[Node, str | None]]]:
    """The root, all nodes in page order, and the stream of (node, text), where None ends a block."""
    root = Node("html", None)
    nodes, stream, at, place = [root], [], root, 0
    articles = 0  # open article and main elements
    has_body = False
    while True:
        m = TOKEN.search(page, place)
        end = m.start() if m else len(page)
        if end > place:
            stream.append((at, html.unescape(page[place:end])))
        if not m:
            break
        place = m.end()
        close, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if m[5] and not m[0].endswith(">"):
            break  # a tag that the page's end cuts off
        if tag in BLOCKS:
            stream.append((at, None))
        elif tag == "br":
            stream.append((at, " "))
        if close:
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up is not root:
                gone = at
                while True:
                    articles -= gone.tag in ("article", "main")
                    if gone is up:
                        break
                    gone = gone.parent
                at = up.parent
            continue
        if tag in ("html", "body"):
            if tag == "body" and not has_body:
                has_body = True
                at = Node("body", root)
                root.children.append(at)
                nodes.append(at)
            continue
        kinds, barrier = ENDS.get(tag, ((), ()))
        if tag in ENDS_P or kinds:
            up, found = at, None
            while up is not None and up is not root and up.tag not in barrier and up.tag not in ("body", "article", "main", "section", "div", "button", "table") or (up is not None and up.tag in kinds):
                if up.tag in kinds or (up.tag == "p" and tag in ENDS_P):
                    found = up
                up = up.parent
            if found is not None:
                at = found.parent
        node = Node(tag, at)
        node.dropped = marked(tag, raw, articles > 0)
        at.children.append(node)
        nodes.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, place)
            place = stop.end() if stop else len(page)
        elif tag not in VOID and not raw.endswith("/"):
            articles += tag in ("article", "main")
            at = node
    holders: set[Node] = set()
    for node in reversed(nodes):  # a wrapper whose class only mentions a sidebar, say, still holds the article
        if node.tag in ("article", "main") or node in holders:
            holders.add(node.parent)
    for node in nodes:
        node.dropped = (node.dropped and (node.tag in DROPPED or node not in holders)) or (node.parent is not None and node.parent.dropped)
    return root, nodes, stream


def densities(root: Node, nodes: list[Node], stream: list[tuple[Node, str | None]]) -> None:
    """Fills in each node's composite text density and the sum of its children's.

    With C, T the characters and tags of a node, LC, LT those of its links, and ratio
    the page's share of link characters, the density is
    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + ratio * C + e),
    where counts are at least 1. The published base is 1, and its logarithm 0, on
    pages without links, so the base's excess over 1 is added to e here: the order of
    nodes stays, and pages with few links give no boundless densities. A node that is
    all link has density 0.
    """
    linked: dict[Node, bool] = {}
    for node in nodes:
        linked[node] = node.tag == "a" or (node.parent is not None and linked[node.parent])
    for node, text in stream:
        if text and not node.dropped:
            n = len("".join(text.split()))
            node.chars += n
            node.link_chars += n * linked[node]
    for node in reversed(nodes):
        if node.dropped:
            continue
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    ratio = root.link_chars / max(root.chars, 1)
    for node in nodes:
        if node.dropped or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + e)
        node.density = c / t * log(max(c / lc * t / lt, 1.0) + 1e-9) / log(max(base, 1.0) + e - 1)
    for node in nodes:
        if node.parent is not None and not node.dropped:
            node.parent.total += node.density


def main_text(page: str | None) -> str:
    """The article of a page; '' for a null, blank or text-free page.

    Elements that by their kind, role or class are menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles or reader comments go. Of the
    others that hold blocks, the one with the largest sum of its children's densities
    is the core; the least density on its path up to the body is the threshold, and
    the siblings on that path that reach it, and headings, belong to the text too.
    article and main are elements like others.
    """
    if not page or not page.strip():
        return ""
    root, nodes, stream = parse(page)
    densities(root, nodes, stream)
    live = [n for n in nodes if not n.dropped and n.chars]
    if not live:
        return ""
    held = {n.parent for n in live if n.tag in BLOCKS}
    core = max([n for n in live if n in held] or live, key=lambda n: (n.total, n.density))
    roots, threshold, node = {core}, core.density, core
    while node.parent is not None and node.tag != "body":
        node = node.parent
        threshold = min(threshold, node.density or threshold)
    node = core
    while node.parent is not None:
        roots |= {x for x in node.parent.children if not x.dropped and (x.density >= threshold or x.tag in HEADINGS)} - {node}
        node = node.parent
    inside: dict[Node, bool] = {}
    for node in nodes:
        inside[node] = not node.dropped and (node in roots or (node.parent is not None and inside[node.parent]))
    blocks: list[str] = []
    current: list[str] = []
    for node, text in [*stream, (root, None)]:
        if text is None:
            if line := " ".join("".join(current).split()):
                blocks.append(line)
            current = []
        elif inside[node]:
            current.append(text)
    return "\n".join(blocks)


def extracted(pages: DataFrame, body: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """A row a page: ``keep``, text (see ``main_text``), n_chars. One pass, a page at a time; equal pages get equal texts; an empty table gives none."""
    rows = pages.select(*[F.col(c).alias(c) for c in keep], F.col(body).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                text = [main_text(p.as_py()) for p in b.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keep, "text", "n_chars"])

    schema = rows.drop("__html").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)
