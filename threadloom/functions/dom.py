"""A small document tree for selectors, on the standard library's parser.

Tag and attribute lookup follow one rule for classes: a single class name matches
an element that has it among others; a name with spaces matches only that exact
attribute value.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these open elements first.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: ... but not beyond these.
SCOPES = frozenset("html body div section article table ul ol dl select td th blockquote".split())


class Node:
    """An element: tag, attributes, children (nodes and strings)."""

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def matches(self, tag: str, wanted: dict[str, str | list[str]]) -> bool:
        if self.tag != tag:
            return False
        for key, value in wanted.items():
            own = self.attrs.get(key)
            if own is None:
                return False
            for one in value if isinstance(value, list) else [value]:
                if own == one or key == "class" and " " not in one and one in own.split():
                    break
            else:
                return False
        return True

    def find_all(self, tag: str, **wanted: str | list[str]) -> list[Node]:
        """Matching descendants; ``class_`` stands for class, ``__`` for a hyphen."""
        attrs = {k.rstrip("_").replace("__", "-"): v for k, v in wanted.items()}
        return [n for n in self.walk() if n.matches(tag, attrs)]

    def find(self, tag: str, **wanted: str | list[str]) -> Node | None:
        attrs = {k.rstrip("_").replace("__", "-"): v for k, v in wanted.items()}
        return next((n for n in self.walk() if n.matches(tag, attrs)), None)

    @property
    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in CLOSES.get(tag, ()):
                del self.open[at:]
                break
            if self.open[at].tag in SCOPES:
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def title_of(root: Node) -> str:
    """The page title, or ``Title: Unknown`` when there is none with a single text."""
    node = root.find("title")
    return node.text if node and node.children else "Title: Unknown"


def pure_text(html: str | None) -> str:
    """Text of markup: scripts and styles dropped, white space collapsed."""
    out, stack = [], [parse(html)]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag not in ("script", "style"):
            stack.extend(reversed(node.children))
    return " ".join(" ".join(out).split())
