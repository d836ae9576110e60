"""A light document tree of block elements for HTML pages, and what describes each node."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from zlib import crc32

import numpy as np

# Elements by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template head title iframe select option textarea".split())
SVG_TITLE = "svg title"  # of a drawing, not of the page: its words are text
#: elements that may stand in a head; any other one ends it, as text does
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody thead tfoot tr caption ul".split()
)
#: an element of the first kind ends open elements of the second, up to the stop elements
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
SECTIONS = ("article", "main", "section", "div", "p", "li", "ul", "ol", "nav", "aside", "header", "footer", "form", "table", "blockquote", "pre", "figure")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Words in class, id, role and the like, by what they tell of an element.
WORDS = {
    "main": "article articles content main post entry story body text prose copy page hentry blog news read markdown document",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs tabs tab pager pagination toc skip links toolbar topbar directory",
    "header": "header head masthead banner top logo brand site hero",
    "footer": "footer foot bottom copyright legal imprint colophon credits",
    "sidebar": "sidebar side aside rail related recommended recommendations widget widgets more popular trending recent archive tags tagcloud complementary secondary right left column",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored sponsors promo promos promotion promoted adsense doubleclick dfp outbrain taboola affiliate teaser banner",
    "notice": "notice notices cookie cookies consent gdpr alert alerts warning message popup modal overlay toast disclaimer privacy paywall dialog",
    "form": "form search login signin signup register subscribe subscription newsletter contact input field fields poll survey",
    "comment": "comment comments reply replies respond disqus discussion thread reviews review responses feedback reader readers user commentlist",
    "social": "social share sharing shares follow facebook twitter like likes bookmark author byline meta date print email",
}
KINDS = {w: k for k, ws in enumerate(WORDS.values()) for w in ws.split()}
BAD_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "search"}
# Attributes that name what an element is for.
NAMING = {"class", "id", "role", "itemprop", "aria-label", "data-role"}
#: buckets of the words in them
TOKENS = 1 << 12
MARK = "data-y"  # of training pages; never a feature


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    kinds: np.ndarray
    tokens: tuple[int, ...] = ()
    mark: str | None = None
    children: list = field(default_factory=list)  # nodes, and strings of the node's own text
    number: int = 0
    # of the subtree
    chars: int = 0
    link_chars: int = 0
    words: int = 0
    stops: int = 0
    links: int = 0
    nodes: int = 1
    own: int = 0  # characters that stand in the node itself


def _described(value: str) -> tuple[np.ndarray, tuple[int, ...]]:
    """Which lists the words of an attribute's value are in, and the words' buckets."""
    out, words = np.zeros(len(WORDS), np.int8), re.findall(r"[^\W\d_]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", value).lower())
    for w in words:
        if w in KINDS:
            out[KINDS[w]] = 1
    return out, tuple(sorted({crc32(w.encode("utf-8", "replace")) % TOKENS for w in words}))


_described_short = lru_cache(4096)(_described)  # sites use few names; long values aren't kept


def described(attrs: list[tuple[str, str | None]]) -> tuple[np.ndarray, tuple[int, ...]]:
    """Kinds and buckets of the words in an element's class, id, role and the like, read whole."""
    kinds, tokens = _NONE, ()
    for name, value in attrs:
        if value and name in NAMING:
            more, found = (_described_short if len(value) < 200 else _described)(value)
            kinds, tokens = (np.maximum(kinds, more), tuple(sorted({*tokens, *found}))) if kinds is not _NONE else (more, found)
    return kinds, tokens


_NONE = np.zeros(len(WORDS), np.int8)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None, 0, _NONE)
        self.open: list[tuple[str, Node]] = []  # all open elements, with the block node that holds their text
        self.hidden = self.linked = 0

    @property
    def node(self) -> Node:
        return self.open[-1][1] if self.open else self.root

    def _pop(self, keep: int) -> None:
        for tag, _ in self.open[keep:]:
            self.hidden -= tag in HIDDEN
            self.linked -= tag == "a"
        del self.open[keep:]

    def _leave_head(self, tag: str = "") -> None:
        """Ends an open head that has no end tag, before an element or a text that may not stand in it."""
        if self.hidden and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop(len(self.open) - 1)
        elif self.hidden and tag == "body":
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "template":
                    break
                if self.open[k][0] == "head":
                    self._pop(k)
                    break

    def handle_starttag(self, tag, attrs):
        self._leave_head(tag)
        if tag in ("br", "wbr") or tag in VOID and tag != "hr":
            if tag != "wbr":
                self._text(" ", 0)
            return
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in stops:
                    break
                if self.open[k][0] in ends:
                    self._pop(k)
        if tag in BLOCKS and tag not in ("html", "body"):
            for k in range(len(self.open) - 1, -1, -1):  # a block ends an open paragraph, whatever is open in it
                if self.open[k][0] == "p":
                    self._pop(k)
                    break
                if self.open[k][0] in BLOCKS or self.open[k][0] in ("td", "th"):
                    break
            parent = self.node
            node = Node(tag, parent, parent.depth + 1, *(described(attrs) if attrs else (_NONE, ())))
            if attrs:
                node.mark = dict(attrs).get(MARK)
            if not self.hidden:
                parent.children.append(node)
            if tag != "hr":
                self.open.append((tag, node))
            return
        if tag in ("html", "body"):
            return
        if tag in ("td", "th"):
            self._text(" ", 0)
        if tag == "title" and any(t == "svg" for t, _ in self.open):
            tag = SVG_TITLE
        self.open.append((tag, self.node))
        self.hidden += tag in HIDDEN
        self.linked += tag == "a"
        self.node.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._text(" ", 0)
        if tag == "title" and any(t == SVG_TITLE for t, _ in self.open):
            tag = SVG_TITLE
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:  # an inline element doesn't end a block
                return

    def _text(self, data, chars):
        if not self.hidden:
            node = self.node
            node.children.append(data)
            if chars:
                node.own += chars
                node.link_chars += chars * bool(self.linked)

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
        self._text(data, len(data) if data.strip() else 0)


def parse(html: str | None) -> list[Node]:
    """Block nodes in the order of the page, the root first; subtree statistics are filled in."""
    builder = _Builder()
    builder.feed((html or "").replace("\0", "�"))
    builder.close()
    order, stack = [], [builder.root]
    while stack:
        node = stack.pop()
        node.number = len(order)
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(order):
        text = "".join(c for c in node.children if isinstance(c, str))
        node.chars += node.own
        node.words += len(text.split()) if node.own else 0
        node.stops += sum(map(text.count, ".,;:!?")) if node.own else 0
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.link_chars += node.link_chars
            p.words += node.words
            p.stops += node.stops
            p.links += node.links
            p.nodes += node.nodes
    return order


@lru_cache(512)
def _tag_columns(tag: str) -> tuple[bool, ...]:
    return (tag in HEADINGS, *(tag == t for t in SECTIONS))


def features(order: list[Node], ratios: np.ndarray) -> np.ndarray:
    """A row for each node: subtree density, tags, attribute words of it and what it is in, depth, place, siblings.

    `ratios` holds for each bucket of attribute words how much likelier main text has it.
    """
    root, rows, above, seen = order[0], [], {}, 0
    total, links = max(root.chars, 1), max(root.links, 1)
    only = sum(n.tag == "article" for n in order) == 1  # a page with one article says where its main text is
    known: dict[int, tuple] = {}
    top = (_NONE, 0, 0, 0, 0.0, 0.0, 0.0)

    def siblings(parent: Node) -> tuple:
        if id(parent) not in known or not parent.tag:
            nodes = [c for c in parent.children if isinstance(c, Node)]
            chars = [c.chars for c in nodes]
            known[id(parent)] = len(nodes), Counter(c.tag for c in nodes), sum(chars), sum(c.link_chars for c in nodes), max(chars)
        return known[id(parent)]

    for node in order:
        kinds, bad, article, heads, said, least, most_said = above.get(id(node.parent), top)
        own = [float(ratios[t]) for t in node.tokens]
        told, low, high = sum(own), min(own, default=0.0), max(own, default=0.0)
        inside = (
            np.maximum(kinds, node.kinds) if node.kinds is not _NONE else kinds,
            bad + (node.tag in BAD_TAGS), article + (node.tag in ("article", "main")), heads + (node.tag == "header"),
            said + told, min(least, low), max(most_said, high),
        )
        above[id(node)] = inside
        n, tags, text_siblings, linked, most = siblings(node.parent or Node("", None, 0, _NONE, children=[node]))
        same = tags[node.tag]
        rows.append([
            np.log1p(node.chars), node.chars / total, node.link_chars / max(node.chars, 1), np.log1p(node.words), node.stops / max(node.words, 1),
            node.links / max(node.words, 1), node.links / links, np.log1p(node.nodes), node.chars / node.nodes, node.own / max(node.chars, 1),
            node.depth, seen / total, node.number / len(order), n, same / n, node.chars / max(text_siblings, 1),
            linked / max(text_siblings, 1), most / total, np.log1p(node.parent.chars if node.parent else total),
            *inside[1:4], only, only and inside[2] > 0, told, low, high, *inside[4:], *_tag_columns(node.tag), *node.kinds.tolist(), *kinds.tolist(),
        ])
        seen += node.own
    return np.array(rows, np.float32)


def block_text(parts: list[str]) -> str:
    return " ".join("".join(parts).split())
