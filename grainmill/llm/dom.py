"""A small, forgiving HTML tree: block elements and blocks of text, with features of each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# What browsers do not show, and controls of forms. Text in anything else is for the trees to judge.
RAW = set("script style noscript template iframe textarea select".split())
NEVER = RAW | set("head button option".split())
# Formulas and drawings stand in a line of text; in them only these elements are not shown.
FOREIGN, FOREIGN_UNSEEN = {"math", "svg"}, set("title desc metadata annotation annotation-xml".split())
# What a head may hold; anything else, text too, ends it.
IN_HEAD = set("title meta link base script style noscript template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s"
    " samp small span strike strong sub sup time tt u var img br wbr".split()
)
CLOSED_BY = {  # an open element of the key ends where one of the values begins
    "p": set(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3"
        " h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"},
}
BLOCKS = CLOSED_BY["p"] | {"p", "body", "html", "head", "li", "dt", "dd", "tr", "td", "th"}
SCOPE = set("ul ol dl table div article section main aside nav body".split())

# Tokens of class, id and role that speak for or against main text.
GOOD_TAGS, BAD_TAGS = {"article", "main"}, set("nav header footer aside form menu dialog".split())
GOOD_WORDS = set("article content entry main post story text body page blog single".split())
BAD_WORDS = set(
    "ad ads advert advertisement sponsor sponsored promo banner nav menu navbar breadcrumb breadcrumbs"
    " sidebar side widget related recommended share social cookie cookies consent notice alert popup"
    " modal newsletter subscribe signup login search form footer header masthead copyright legal tags"
    " pagination pager toolbar skip".split()
)
TALK_WORDS = set("comment comments reply replies respond discussion disqus thread".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# Quotes in a tag are minded up to this length; a longer tag ends at the next >.
TAG_CHARS = 4096
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_TOKEN = re.compile(r"[a-z]+")


class _Tags:
    """The tags of a page one after another; comments and declarations are left out.

    A place is looked at a bounded number of times, so a page of unclosed tags takes no longer.
    """

    def __init__(self, page: str):
        self.page = page
        self.bracket = -1  # a > that is not before the place looked at last

    def _bracket(self, at: int) -> int:
        if self.bracket < at:
            found = self.page.find(">", at)
            self.bracket = found if found >= 0 else len(self.page)
        return self.bracket

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """(start, end, "/" of an end tag, name, attributes); an empty name is no tag.

        Without any more markup the start is the end of the page.
        """
        page, size = self.page, len(self.page)
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, size if end < 0 else end + 3, "", "", ""
            first = page[at + 1 : at + 2]
            if first in ("!", "?"):
                if (end := self._bracket(at)) < size:
                    return at, end + 1, "", "", ""
            elif name := _NAME.match(page, at, at + TAG_CHARS):
                if whole := _TAG.match(page, at, at + TAG_CHARS):
                    return at, whole.end(), *whole.group(1, 2, 3)
                if (end := self._bracket(at)) < size:
                    stop = min(name.end(), end)
                    return at, end + 1, name.group(1), name.group(2), page[stop:end]
            at += 1
        return size, size, "", "", ""


@dataclass
class Node:
    """A block element, or (tag ``#text``) a block of text in one."""

    tag: str
    parent: int
    depth: int
    tokens: list[str] = field(default_factory=list)
    text: str = ""
    link_chars: int = 0
    dropped: bool = False


def _tokens(attributes: str) -> list[str]:
    if not attributes or "=" not in attributes:
        return []
    found = " ".join(v for _, v in _ATTRIBUTE.findall(attributes))
    return _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower())


class _Ends:
    """Where the contents of elements that hold no markup end; each search goes on from there."""

    def __init__(self, page: str):
        self.page = page
        self.absent: set[str] = set()

    def after(self, tag: str, at: int) -> int | None:
        """The place after the end tag, past elements of the same name inside; None without one."""
        if tag in self.absent:
            return None
        inside = 1
        for found in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(self.page, at):
            inside += -1 if found.group(1) else tag == "template"
            if not inside:
                return found.end()
        self.absent.add(tag)
        return None


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children; the first is the document.

    The work is in proportion to the page: whether an element is open is known from counts, and
    only elements that others may end, and the borders of their scope, are looked through.
    """
    nodes = [Node("body", -1, 0)]
    stack: list[tuple[str, int]] = [("body", 0)]
    opened: dict[str, int] = {}
    stops: list[int] = []  # places in the stack of elements in CLOSED_BY or SCOPE
    ends = _Ends(page)
    parts: list[str] = []
    in_link = 0
    link_chars = 0
    foreign = 0

    def cut(size: int) -> None:
        for tag, _ in stack[size:]:
            opened[tag] -= 1
        del stack[size:]
        while stops and stops[-1] >= size:
            stops.pop()

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            at = stack[-1][1]
            nodes.append(Node("#text", at, nodes[at].depth + 1, text=text, link_chars=link_chars))
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if stack[-1][0] == "head" and text and not text.isspace():
            cut(len(stack) - 1)
        if text and not nodes[stack[-1][1]].dropped:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                link_chars += len(text.strip())

    tags, at = _Tags(page), 0
    while at < len(page):
        start, end, closing, tag, attributes = tags.next(at)
        add(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if stack[-1][0] == "head" and not closing and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if tag in FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (not attributes.endswith("/"))
            continue
        if foreign and tag not in RAW:
            if tag in BLOCKS:  # as a formula never holds these, its end is missing
                foreign = 0
            else:
                if tag in FOREIGN_UNSEEN and not closing:
                    at = ends.after(tag, at) or at
                continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            continue
        if closing:
            if opened.get(tag):
                flush()
                in_link = 0
                size = len(stack)
                while stack[size - 1][0] != tag:
                    size -= 1
                cut(size - 1)
            continue
        if tag in RAW or (tag == "title" and stack[-1][0] == "head"):
            # The contents of these are not markup.
            end = None if attributes.endswith("/") else ends.after(tag, at)
            if end:
                at = end
            elif tag in ("script", "style"):
                at = len(page)
            continue
        if tag == "html":
            continue
        flush()
        in_link = 0
        # One of each kind is open in a scope at most, so this ends soon.
        last = len(stops) - 1
        while last >= 0:
            k = stops[last]
            if tag in CLOSED_BY.get(stack[k][0], ()):
                cut(k)
            elif stack[k][0] in SCOPE:
                break
            last -= 1
        if tag == "body" or tag in VOID or attributes.endswith("/"):
            continue
        up = stack[-1][1]
        dropped = nodes[up].dropped or tag in NEVER
        nodes.append(Node(tag, up, nodes[up].depth + 1, _tokens(attributes), dropped=dropped))
        stack.append((tag, len(nodes) - 1))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in CLOSED_BY or tag in SCOPE:
            stops.append(len(stack) - 1)
    flush()
    return unwrapped(nodes)


def unwrapped(nodes: list[Node]) -> list[Node]:
    """Without forms around an article or most of the text; their children take their place.

    Such a form is set around a page by its server and says nothing about what it holds.
    """
    if all(x.tag != "form" for x in nodes):
        return nodes
    chars, articles = [len(x.text) for x in nodes], [x.tag in GOOD_TAGS for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        articles[nodes[i].parent] |= articles[i]
    out, place, forms = [nodes[0]], [0] * len(nodes), [0] * len(nodes)
    for i, x in enumerate(nodes[1:], start=1):
        up = x.parent
        if x.tag == "form" and (articles[i] or 2 * chars[i] > chars[0]):
            place[i], forms[i] = place[up], forms[up] + 1
            continue
        place[i], forms[i] = len(out), forms[up]
        x.parent, x.depth = place[up], x.depth - forms[up]
        out.append(x)
    return out


TAG_KIND = {t: k for k, group in enumerate([
    ("#text",), ("p", "blockquote", "pre", "figure", "figcaption"), ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("ul", "ol", "dl", "li", "dt", "dd"), ("table", "tbody", "tr", "td", "th", "thead"),
    ("div", "section", "body"), ("article", "main"), ("nav", "menu"), ("header", "footer"), ("aside", "dialog"),
], start=1) for t in group}
N_FEATURES = 26


def features(nodes: list[Node]) -> np.ndarray:
    """One row of numbers for each node: its subtree, tag, tokens, place, siblings, ancestors."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    chars, links, tags, paragraphs, stops, blocks = (np.zeros(n) for _ in range(6))
    good, bad, talk, over_good, over_bad, over_talk = (np.zeros(n) for _ in range(6))
    index, siblings = np.zeros(n), np.zeros(n)
    before = np.zeros(n)
    position = 0.0
    for i, x in enumerate(nodes):
        before[i] = position
        if x.tag == "#text":
            chars[i], links[i], blocks[i] = len(x.text), x.link_chars, 1
            stops[i] = x.text.count(".") + x.text.count(",") + x.text.count("!") + x.text.count("?")
            position += len(x.text)
        else:
            tags[i], paragraphs[i] = 1, x.tag == "p"
            good[i] = (x.tag in GOOD_TAGS) + sum(t in GOOD_WORDS for t in x.tokens)
            bad[i] = (x.tag in BAD_TAGS) + sum(t in BAD_WORDS for t in x.tokens)
            talk[i] = sum(t in TALK_WORDS for t in x.tokens)
        if i:
            p = parent[i]
            index[i] = siblings[p]
            siblings[p] += 1
            over_good[i] = over_good[p] + (good[p] > 0)
            over_bad[i] = over_bad[p] + (bad[p] > 0)
            over_talk[i] = over_talk[p] + (talk[p] > 0)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for total in (chars, links, tags, paragraphs, stops, blocks):
            total[p] += total[i]
    up = np.maximum(parent, 0)
    whole = max(1.0, chars[0])
    kind = np.array([TAG_KIND.get(x.tag, 0) for x in nodes])
    depth = np.array([x.depth for x in nodes])
    sibling_chars = chars[up] - chars
    return np.stack([
        np.log1p(chars), chars / whole, links / np.maximum(chars, 1), tags / np.maximum(chars, 1),
        paragraphs, stops / np.maximum(chars, 1), blocks, chars / np.maximum(blocks, 1), depth,
        index, siblings[up], index / np.maximum(siblings[up], 1), sibling_chars / whole,
        chars / np.maximum(chars[up], 1), before / whole, kind, kind[up], good, bad, talk,
        over_good, over_bad, over_talk, good[up], bad[up] + talk[up], links[up] / np.maximum(chars[up], 1),
    ], axis=1)


def decode(nodes: list[Node], logit: np.ndarray) -> list[bool]:
    """Keep or drop for each node; a kept node's ancestors are all kept.

    Of all such choices, the one with the largest sum of logits of kept minus dropped nodes.
    """
    n = len(nodes)
    keep, drop = logit.astype(float).tolist(), (-logit).astype(float).tolist()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [False] * n
    for i in range(n):
        out[i] = (i == 0 or out[nodes[i].parent]) and keep[i] > drop[i]
    return out
