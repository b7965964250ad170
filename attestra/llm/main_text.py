"""Main text of web pages by tree scoring.

A page is read into a tree in one pass, in time that grows with its length whatever it holds. Parts that are never the
article (menus, footers, controls, scripts) are cut off, and so are headers, sidebars, forms and boxes whose class or id names
adverts, notices or comments, unless they hold the page's text: a box with such a name as a whole (``comments``) stays where nothing else of the page is a paragraph, one with the name as a part
(``has-sidebar``) where boxes of its name hold more than half of the unlinked text, though its points then count less
than those of other paragraphs. A page that is empty without its named boxes is read with them. Every paragraph then passes points for its
length and commas to its ancestors, half as much with each step up; a container's points are discounted by the
share of its text that stands in links. The best container is kept, with those of its siblings that look like
parts of the same article.

Defined results: a null or empty page has the empty text; unclosed and misnested tags are closed where a browser
would close them; pages of any length are read whole; rows that repeat give the same text each; other columns are
left alone.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A quote counts where a value begins; a value that is never closed ends with the tag, at the first ">". Possessive, so linear in the tag.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""", re.S)
BARE_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")

# Values that follow from HTML itself.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES = {  # an opening tag ends an open one of these, up to the given containers
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

ENDS: dict[str, list[str]] = {}  # by tag, the opening tags that end it, and those that stop at it
STOPS: dict[str, list[str]] = {}
for _kind, (_ends, _stops) in CLOSES.items():
    for _tag in _ends:
        ENDS.setdefault(_tag, []).append(_kind)
    for _tag in _stops:
        STOPS.setdefault(_tag, []).append(_kind)

CUT = {"nav", "footer", "button", "select", "label", "dialog", "menu", "object", "embed", "canvas", "audio", "video", "head"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
CUT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
BOXES = {"header", "aside", "form"}  # cut like boxes of such a name
WHOLE = CUT_NAMES | BOXES
KEPT = {"html", "body", "article", "main"}  # never cut for what they are named
WORD = re.compile(r"[a-z]+")
PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
START = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0}
SIBLING_SHARE = 0.2  # of the best score that a sibling container needs
LONG = 80  # unlinked characters of a paragraph that speaks for an article
NEARLY_ALL = 0.8  # share of the unlinked text that makes a box named as a whole the page
NAMED_WEIGHT = 0.2  # of points from a named box that is kept beside other paragraphs
LINKED = 0.5  # share of link text above which a sibling paragraph or a list is left out


class Node:
    __slots__ = ("tag", "up", "items", "score", "chars", "linked", "commas", "name", "weight", "block", "inner", "near")

    def __init__(self, tag: str, up: Node | None, name: str = ""):
        self.tag, self.up, self.items, self.score, self.chars, self.linked, self.commas = tag, up, [], None, 0, 0, 0
        self.name, self.weight = name, 1.0  # of an advert, notice or the like; share of its points that count
        # While the tree grows: the nearest block, the open inline tags in it, and the open items that a next one closes.
        self.block, self.inner = (self, {}) if up is None or tag in BLOCK else (up.block, None)
        self.near = up.near if up is not None else {}
        if tag in ENDS or tag in STOPS:
            self.near = self.near | {kind: self for kind in ENDS.get(tag, ())} | {kind: None for kind in STOPS.get(tag, ()) if kind not in ENDS.get(tag, ())}


def boxed(tag: str, attributes: str) -> bool:
    """Whether an element is cut off with all it holds."""
    if tag in CUT:
        return True
    if not attributes or tag in KEPT:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            if value in CUT_ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def named(tag: str, attributes: str) -> str:
    """The class or id by which an element may be an advert, notice or the like: one of CUT_NAMES as a whole, else one with such a part, else empty."""
    if tag in BOXES:
        return tag
    found = ""
    if attributes and tag not in KEPT:
        for name, value in ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id"):
                for token in value.strip("\"'").lower().split():
                    words = WORD.findall(token)
                    if CUT_NAMES.intersection(words):
                        if len(words) == 1:
                            return words[0]
                        found = found or "-".join(words)
    return found


class Tags:
    """The tags of a page in order. Where a tag's end is hidden by quotes to the end of the page, this and all tags after it
    end at their first ``>``; so no place is searched to the end of the page twice."""

    def __init__(self, page: str):
        self.page, self.last, self.pattern = page, page.rfind(">"), TAG

    def next(self, pos: int) -> tuple[int, int, re.Match | None] | None:
        """(start, end, match) of the next tag from ``pos`` on; without a match it is a comment or declaration."""
        page, at = self.page, self.page.find("<", pos)
        while at >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, (end + 3 if end >= 0 else len(page)), None
            if at > self.last:
                return None
            if page[at + 1 : at + 2] in ("!", "?"):
                return at, page.find(">", at) + 1, None
            if page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/":
                m = self.pattern.match(page, at)
                if m is None and self.pattern is TAG and BARE_TAG.match(page, at):
                    self.pattern = BARE_TAG
                    m = BARE_TAG.match(page, at)
                if m is not None:
                    return at, m.end(), m
            at = page.find("<", at + 1)
        return None


class Tree:
    """The open end of a growing tree. Every node is left once, so closing costs no more than opening."""

    def __init__(self):
        self.root = self.at = Node("html", None)
        self.open: dict[str, int] = {}  # open blocks by tag

    def enter(self, tag: str, name: str) -> None:
        child = Node(tag, self.at, name)
        self.at.items.append(child)
        self.at = child
        counts = self.open if tag in BLOCK else child.block.inner
        counts[tag] = counts.get(tag, 0) + 1

    def leave(self, node: Node) -> None:
        """Close ``node`` and all that is open in it."""
        while True:
            at = self.at
            counts = self.open if at.tag in BLOCK else at.block.inner
            counts[at.tag] -= 1
            self.at = at.up
            if at is node:
                return

    def make_room(self, tag: str) -> None:
        """Close what the opening of a block closes: an open paragraph (with the inline tags in it) and items of its kind."""
        block = self.at.block
        if block.tag == "p":
            self.leave(block)
        while tag in CLOSES and self.at.near.get(tag) is not None:
            self.leave(self.at.near[tag])

    def close(self, tag: str) -> None:
        """An end tag closes the nearest open element of its kind, if there is one; an inline one does not reach out of its block."""
        if tag in BLOCK:
            if not self.open.get(tag):
                return
        elif not self.at.block.inner.get(tag):
            return
        node = self.at
        while node.tag != tag:
            node = node.up
        self.leave(node)


def parse(page: str) -> Node:
    """The tree of what is not cut off. Items of a node are its text pieces and child nodes in page order."""
    tree, tags = Tree(), Tags(page)
    pos, depth, cut_tag = 0, 0, ""
    while pos < len(page):
        found = tags.next(pos)
        if found is None:
            if not depth:
                tree.at.items.append(page[pos:])
            break
        start, end, m = found
        if start > pos and not depth:
            tree.at.items.append(page[pos:start])
        pos = end
        if m is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if depth and cut_tag == "p" and tag in BLOCK and (not closing or tag != "p"):
            depth = 0  # a paragraph ends where the next block begins
        if depth:  # inside a part that is cut off: only its own tag counts
            if tag == cut_tag:
                depth += -1 if closing else 1
            elif tag in RAW and not closing:
                pos = _after_raw(page, tag, pos)
            elif closing and tag in ("body", "html"):
                depth = 0
            continue
        if closing:
            tree.close(tag)
        elif tag in RAW:
            pos = _after_raw(page, tag, pos)
        elif tag in VOID or m[3].endswith("/"):
            tree.at.items.append("\n" if tag == "hr" else " ")
        elif tag in ("html", "body"):
            continue
        elif boxed(tag, m[3]):
            if tag in BLOCK:
                tree.make_room(tag)
                tree.at.items.append(Node("cut", tree.at))
            depth, cut_tag = 1, tag
        else:
            if tag in BLOCK:
                tree.make_room(tag)
            tree.enter(tag, named(tag, m[3]))
    return tree.root


def _after_raw(page: str, tag: str, pos: int) -> int:
    m = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
    return m.end() if m else len(page)


def _ordered(root: Node) -> list[Node]:
    """Parents before children, without recursion: misnested pages can be thousands of levels deep."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.items if isinstance(x, Node))
    return order


def _measured(root: Node) -> tuple[dict[Node, int], dict[Node, bool]]:
    """Unlinked characters of every node with all it holds, and whether it is itself a paragraph of some length."""
    order, free, long = _ordered(root), {}, {}
    for node in reversed(order):
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        free[node] = 0 if node.tag == "a" else own + sum(free[x] for x in node.items if isinstance(x, Node))
        long[node] = free[node] >= LONG and (node.tag in PARAGRAPH or (node.tag in START and own >= LONG))
    return free, long


def _cut_named(root: Node) -> None:
    """Cut named boxes off the tree, but for those that hold the page's text."""
    if not any(x.name for x in _ordered(root)):
        return
    free, long = _measured(root)
    whole: dict[Node, Node] = {}  # the nearest box named as a whole around a node, or the root
    direct = {root: False}
    for node in _ordered(root):
        whole[node] = node if node is root or node.name in WHOLE else whole[node.up]
        direct[whole[node]] = direct.get(whole[node], False) or long[node]
    if not direct[root]:  # boxes within each other that hold nearly all: the outer ones are no boxes, up to the first paragraph
        for node in _ordered(root):
            if whole[node] is node and node is not root and free[node] > NEARLY_ALL * free[root]:
                node.name = ""
                if direct[node]:
                    break
    for node in _ordered(root):
        if node.name in WHOLE:
            _cut(node)
    free, long = _measured(root)
    sums: dict[str, int] = {}  # unlinked characters by name, a box within a box of its name not counted again
    around: dict[Node, Node | None] = {root: None}
    for node in _ordered(root):
        above = around.get(node.up) if node.up is not None else None
        around[node] = node if node.name else above
        if node.name and (above is None or above.name != node.name):
            sums[node.name] = sums.get(node.name, 0) + free[node]
    kept = {name for name, n in sums.items() if 2 * n > free[root]}
    light, outside = set(), False
    for node in _ordered(root):
        if node.name and node.name not in kept:
            _cut(node)
        elif node.name or node.up in light:
            light.add(node)
        outside = outside or (long[node] and node not in light and node.tag != "cut")
    if outside:
        for node in light:
            node.weight = NAMED_WEIGHT


def _cut(node: Node) -> None:
    node.items.clear()
    node.name = ""
    node.tag = "cut" if node.tag in BLOCK else "span"


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _cut_named(root)
    text = _written(root)
    return text or _written(parse(page))


def _written(root: Node) -> str:
    best = _scored(root)
    keep = [best]
    if best.up is not None and best.tag not in ("article", "main"):
        keep = [x for x in best.up.items if isinstance(x, Node) and (x is best or _belongs(x, best))]
    blocks: list[str] = []
    line: list[str] = []
    for node in keep:
        _write(node, blocks, line)
        _flush(blocks, line)
    return "\n".join(blocks)


def _scored(root: Node) -> Node:
    """Sum lengths, links and commas upwards, pass points, and return the container with the most."""
    order = _ordered(root)
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.linked += x.linked
                node.commas += x.commas
            else:
                node.chars += len(x.strip())
                node.commas += x.count(",") + x.count("、") + x.count("，")
        if node.tag == "a":
            node.linked = node.chars
    for node in order:
        loose = node.tag in START and node is not root and any(isinstance(x, str) and len(x.strip()) >= 25 for x in node.items)
        if (node.tag in PARAGRAPH or loose) and node.chars:
            points = 1.0 + node.commas + min(node.chars / 100, 3.0)
            points *= (1 - node.linked / node.chars) * node.weight
            up, share = (node if loose and node.tag not in PARAGRAPH else node.up), 1.0
            while up is not None and share > 0.1:
                up.score = (START.get(up.tag, 0.0) if up.score is None else up.score) + points * share
                up, share = up.up, share / 2
    best, top = root, 0.0
    for node in order:
        if node.score is not None and node.tag not in ("p", "a", "b", "i", "span", "em", "strong", "h1", "h2", "h3", "h4", "h5", "h6"):
            value = node.score * (1 - node.linked / node.chars) if node.chars else 0.0
            if value > top:
                best, top = node, value
    node = best
    while node.up is not None:  # an article or main element around the best container is the article
        node = node.up
        if node.tag in ("article", "main"):
            best = node
            break
    best.score = max(top, best.score or 0.0)
    return best


def _belongs(node: Node, best: Node) -> bool:
    if not node.chars or node.weight < best.weight:
        return False
    linked = node.linked / node.chars
    if node.tag in PARAGRAPH and node.tag != "li":
        return linked < 0.25 if node.chars > 80 else linked == 0
    return (node.score or 0.0) * (1 - linked) >= max(10.0 * best.weight, best.score * SIBLING_SHARE) and linked < LINKED


def _write(top: Node, blocks: list[str], line: list[str]) -> None:
    stack: list = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            _flush(blocks, line)
        elif x.tag == "cut":
            _flush(blocks, line)
        elif x.tag in ("ul", "ol", "dl") and x.chars and x.linked / x.chars > LINKED:
            _flush(blocks, line)  # a list of links is a menu
        else:
            block = x.tag in BLOCK
            if block:
                _flush(blocks, line)
                stack.append(None)
            stack.extend(reversed(x.items))


def _flush(blocks: list[str], line: list[str]) -> None:
    if line:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()


def extracted(page: str | Column) -> Column:
    """The main text of a column of pages."""

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return F.pandas_udf(run, T.StringType())(page)
