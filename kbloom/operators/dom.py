"""A small tolerant HTML tree on the standard library's tokenizer.

Void elements, raw-text elements and the implied end tags of paragraphs, list
items, table cells, rows, options and definition terms are handled; unclosed
elements end with their parent.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": frozenset({"p"}),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body html article section div nav aside footer header main".split())
HIDDEN = frozenset("script style noscript template svg".split())
#: Elements that keep the words on their two sides apart.
APART = BLOCKS | frozenset("p li dt dd tr td th br option summary figcaption caption legend title body head html tbody thead tfoot button label select textarea".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self):
        """This node and those below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)

    def has_class(self, pattern: str) -> bool:
        return re.search(pattern, self.attrs.get("class") or "", re.I) is not None

    def inside(self, *tags: str) -> bool:
        node = self.up
        while node is not None:
            if node.tag in tags:
                return True
            node = node.up
        return False

    def after(self) -> Node | None:
        """The next element of the same parent."""
        if self.up is None:
            return None
        kids = [k for k in self.up.kids if isinstance(k, Node)]
        k = kids.index(self) + 1
        return kids[k] if k < len(kids) else None

    def text(self, apart: bool = False) -> str:
        """Visible text, white space squashed; ``apart`` separates blocks."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            if node.tag in HIDDEN:
                continue
            if apart and node.tag in APART:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(node.kids))
        return re.sub(r"[\s ]+", " ", "".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, frozenset({"p"}) if tag in BLOCKS else None)
        if closes:
            node, end = self.at, None
            while node.up is not None and node.tag not in SCOPES:
                if node.tag in closes:
                    end = node
                node = node.up
            if end is not None:
                self.at = end.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.up

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


#: An ampersand that begins no closed reference.
_OPEN = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


def parse(html: str | None, closed: bool = False) -> Node:
    """The tree of a page; with ``closed``, references without a semicolon are text."""
    builder = _Builder()
    builder.feed(_OPEN.sub("&amp;", html or "") if closed else html or "")
    builder.close()
    return builder.root


def anchors(html: str | None) -> list[tuple[str, str, str]]:
    """(href, text, place) of each link; place is nav, footer or body."""
    out = []
    for node in parse(html).find("a"):
        href = node.attrs.get("href")
        if href:
            place = "nav" if node.inside("nav", "header") else "footer" if node.inside("footer") else "body"
            out.append((href, node.text()[:120], place))
    return out
