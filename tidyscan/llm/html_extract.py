"""Main text of web pages by composite text density.

A page's tags become a tree.  Each node has C characters, T tags below it, LC characters in links and LT links; its
composite density is C / T, weighed down by its links against those of the whole body:

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

with zero counts taken as one and the last divisor as one at least (a page without links would divide by zero).  A container's sum is
that of its children's densities, its own text counting as a child.  The container of the largest sum is the article's; the
least density on its path to the body is the threshold.  If it lies in an ``article`` or ``main``, that is taken whole.  If not,
the siblings along the path are taken that reach the threshold, and headings right before it.

What never is article goes before: tags, roles and class names of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, hidden elements, and lists of links alone.

Nulls and empty pages give the empty text.  Very long pages are read in time linear in their length (and nesting, of which 512 levels are told apart), by one task each, as a tree
cannot be cut.  Ties of the sum go to the container that begins first.  Repeated pages are extracted each for itself; other
columns of the table don't matter.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from .common import ship

ship(__name__)

# Tags and words.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Their content isn't markup.  Pages are read as by a browser that runs scripts.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
#: Elements that are no article wherever they stand.
NEVER = RAW - {"xmp"} | {
    "head", "nav", "aside", "form", "button", "select", "option", "optgroup", "datalist", "fieldset", "input", "dialog", "menu",
    "template", "svg", "canvas", "object", "embed", "audio", "video", "map",
}
NEVER_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar",
    "toolbar", "tablist",
}
#: Words in class names and ids of what is no article.
NEVER_WORDS = {
    "ad", "ads", "adbox", "adsense", "adslot", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "announcement", "disclaimer",
    "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "aside", "nav",
    "navbar", "navigation", "navigator", "menu", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead",
    "topbar", "toolbar", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "comment", "comments",
    "disqus", "respond", "replies", "skip", "search", "searchbox", "form",
}
#: Class names and ids of a whole page's head: an article's own header holds its title.
PAGE_HEADS = {"header", "siteheader", "pageheader", "topheader"}
CONTAINERS = {
    "html", "body", "main", "article", "section", "div", "td", "th", "table", "tbody", "tr", "center", "blockquote", "dl", "ul", "ol", "dd", "li",
    "figure", "details", "pre", "header", "hgroup", "footer",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = CONTAINERS | HEADINGS | {
    "p", "address", "caption", "dt", "figcaption", "hr", "legend", "summary", "thead", "tfoot", "search", "listing", "plaintext", "xmp",
}
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "html", "body"} | {"nav", "aside", "form", "menu", "dialog", "fieldset"}
#: Start tags that end an open element of these kinds, and where the look for one ends.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "a": ({"a"}, {"table", "td", "th"}),
}

TAG = re.compile(
    r"""</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)>"""
)
ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+(?=[\s/]|$)""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements nested deeper than this become siblings, as in browsers; no text is lost.
DEEPEST = 512
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "up", "below", "attributes", "chars", "tags", "link_chars", "links", "density", "gone")

    def __init__(self, tag: str, up: Node | None, attributes: dict[str, str]):
        self.tag, self.up, self.attributes = tag, up, attributes
        self.below: list[Node | str] = []
        self.gone = False


def tree(html: str) -> Node:
    """The page's elements under one root.  What is left open ends with its parent, as pages cut off have it."""
    root = Node("html", None, {})
    stack, at, end = [root], 0, len(html)
    opened: dict[str, int] = {}  # open elements by tag

    def enter(name: str, written: str) -> None:
        node = Node(name, stack[-1], _attributes(written))
        stack[-1].below.append(node)
        stack.append(node)
        opened[name] = opened.get(name, 0) + 1

    def leave() -> None:
        name = stack.pop().tag
        opened[name] -= 1
        if not opened[name]:
            del opened[name]

    def text(piece: str) -> None:
        if piece:
            stack[-1].below.append(unescape(piece) if "&" in piece else piece)

    def close(kinds: set[str], bounds: set[str]) -> None:
        if opened.keys().isdisjoint(kinds):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in kinds:
                while len(stack) > depth:
                    leave()
                return
            if stack[depth].tag in bounds:
                return

    while at < end:
        mark = html.find("<", at)
        if mark < 0:
            text(html[at:])
            break
        text(html[at:mark])
        if html.startswith("<!--", mark):
            stop = html.find("-->", mark + 4)
            at = end if stop < 0 else stop + 3
            continue
        follows = html[mark + 1 : mark + 2]
        if follows in ("!", "?") and follows:
            stop = html.find(">", mark)
            at = end if stop < 0 else stop + 1
            continue
        found = TAG.match(html, mark)
        if not found:
            if not (follows.isalpha() or follows == "/"):  # a plain less-than sign
                text("<")
                at = mark + 1
            else:  # a tag that is cut off, or </ without a name
                stop = html.find(">", mark)
                at = end if stop < 0 else stop + 1
            continue
        at, name = found.end(), found[1].lower()
        if follows == "/":
            if name == "br":
                stack[-1].below.append(Node("br", stack[-1], {}))
            elif name in HEADINGS:
                close(HEADINGS, CONTAINERS)
            elif name not in ("html", "body"):
                close({name}, {"td", "th"} - {name} if name not in CONTAINERS and name != "tr" else set())
            continue
        if name in ("html", "body", "head") and len(stack) > 1 and name != "head":
            for inner in stack:
                if inner.tag == name:
                    break
            else:
                close({"head"}, set())
                enter(name, found[2])
            continue
        if name == "html":
            root.attributes = _attributes(found[2])
            continue
        if name in ENDS_P:
            close({"p"}, {"button", "td", "th", "object", "table", "caption"})
        if name in HEADINGS and stack[-1].tag in HEADINGS:
            leave()
        if name in ENDS:
            close(*ENDS[name])
        if name in BLOCKS and stack[-1].tag == "head":
            leave()
        while len(stack) > DEEPEST:
            leave()
        enter(name, found[2])
        if name in VOID or (found[2].endswith("/") and name in ("path", "rect", "use", "circle")):
            leave()
        elif name in RAW:
            stop = RAW_ENDS[name].search(html, at)
            if name == "xmp":
                stack[-1].below.append(html[at : stop.start() if stop else end])
            at = stop.start() if stop else end
    return root


def _attributes(written: str) -> dict[str, str]:
    if not written or written.isspace():
        return {}
    return {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(written)}


def order(root: Node) -> list[Node]:
    """All nodes that aren't gone, parents first.  No recursion: pages may nest to any allowed depth."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.gone:
            found.append(node)
            todo += [x for x in reversed(node.below) if isinstance(x, Node)]
    return found


def _named(node: Node) -> bool:
    """Whether class or id say that it's no article."""
    for key in ("class", "id"):
        for name in node.attributes.get(key, "").split():
            words = [w.lower() for w in NAME_WORD.findall(name)]
            if not NEVER_WORDS.isdisjoint(words) or "".join(words) in PAGE_HEADS:
                return True
    return False


def prune(nodes: list[Node]) -> None:
    """Mark what is no article by its kind as gone."""
    held: dict[int, bool] = {}  # whether a node holds a title or an article, which spares it from being dropped by name
    for node in reversed(nodes):
        own = node.tag in ("main", "h1", "body") or node.tag == "article" and not _named(node)
        held[id(node)] = own or any(isinstance(x, Node) and held[id(x)] for x in node.below)
    inside: dict[int, bool] = {}
    for node in nodes:
        inside[id(node)] = node.tag in ("article", "main") or node.up is not None and inside[id(node.up)]
        if node.tag in ("html", "body"):
            continue
        a = node.attributes
        if node.tag in NEVER or node.tag == "footer" and not _within(node, "blockquote"):
            node.gone = True
        elif node.tag == "header" and not inside[id(node)]:
            node.gone = True
        elif a and (
            "hidden" in a or a.get("aria-hidden", "").lower() == "true" or INVISIBLE.search(a.get("style", ""))
            or a.get("role", "").lower() in NEVER_ROLES or _named(node) and not held[id(node)]
        ):
            node.gone = True


def _within(node: Node, tag: str) -> bool:
    while node.up is not None:
        node = node.up
        if node.tag == tag:
            return True
    return False


def weigh(nodes: list[Node]) -> None:
    """Counts of every node, children before parents."""
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.links = 0
    for node in reversed(nodes):
        node.chars += sum(len("".join(x.split())) for x in node.below if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1
        if node.up is not None:
            up = node.up
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.links += node.links


def density(node: Node, body: Node) -> float:
    """Composite text density of a node, 0 without characters."""
    if not node.chars:
        return 0.0
    c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.links
    base = c / max(c - lc, 1) * lc + body.link_chars / max(body.chars, 1) * c + e
    return c / t * max(log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / max(log(log(base)), 1.0)


def chosen(nodes: list[Node]) -> list[Node]:
    """The nodes whose text is the article, in page order: see the module's text."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    whole = nodes[0]
    for node in nodes:
        node.density = density(node, whole)
    best, most = body, -1.0
    for node in nodes:
        if node.tag in CONTAINERS:
            own = sum(len("".join(x.split())) for x in node.below if isinstance(x, str))
            total = own + sum(x.density for x in node.below if isinstance(x, Node) and not x.gone)
            if total > most:
                best, most = node, total
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    for kind in ("article", "main"):
        for node in path:
            if node.tag == kind or kind == "main" and node.attributes.get("role", "").lower() == "main":
                return [node]
    least = min(n.density for n in path)
    kept, picked = best, [best]
    for up in path[1:]:
        beside = [x for x in up.below if x is kept or isinstance(x, Node) and not x.gone]
        place = next(i for i, x in enumerate(beside) if x is kept)
        head = place
        while head and beside[head - 1].tag in HEADINGS:
            head -= 1
        taken = [(i, x) for i, x in enumerate(beside) if x is not kept and (head <= i < place or x.chars and x.density >= least > 0)]
        picked = [x for i, x in taken if i < place] + picked + [x for i, x in taken if i > place]
        kept = up
    return picked


def blocks(start: Node) -> list[str]:
    """Texts of the blocks below a node: white space runs are one space, a line break counts as one."""
    found: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        line = " ".join("".join(pieces).split())
        if line:
            found.append(line)
        pieces.clear()

    todo: list[Node | str | None] = [start]  # None: the end of a block
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            pieces.append(x)
        elif x.gone:
            if x.tag in BLOCKS or x.tag in ENDS_P:
                flush()
        elif x.tag == "br":
            pieces.append(" ")
        else:
            block = x.tag in BLOCKS
            if block:
                flush()
                todo.append(None)
            todo += reversed(x.below)
    flush()
    return found


def main_text(html: str | None) -> str:
    if not html or html.isspace():
        return ""
    root = tree(html)
    nodes = order(root)
    weigh(nodes)
    for node in nodes:  # menus without a name: links and nothing else
        if node.tag in CONTAINERS and node.links > 2 and node.link_chars >= 0.9 * node.chars and node.tag not in ("html", "body"):
            node.gone = True
    prune(nodes)
    nodes = order(root)
    weigh(nodes)
    return "\n".join(line for node in chosen(nodes) for line in blocks(node))


@F.pandas_udf(StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page with ``html``."""
    return pages.select("page_id", "url", _main_texts("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
