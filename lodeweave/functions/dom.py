"""A small DOM on the standard library's parser: end tags close the nearest open tag of that name, nothing else closes
anything, void elements hold nothing, the end of the input closes all. Pages may nest as deep as they like: no function
recurses, and parsing takes steps in proportion to the page."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript iframe template".split())


class Node:
    """An element; children are nodes and strings, heading tells whether it holds one of the first three levels."""

    __slots__ = ("attrs", "children", "heading", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children, self.heading = name, attrs, parent, [], False

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *names: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.name in names)

    def first(self, *names: str) -> Node | None:
        return next(self.find(*names), None)

    def strings(self) -> Iterator[str]:
        """Text pieces outside of scripts and styles."""
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.name not in UNSEEN:
                stack += reversed(c.children)

    def text(self, sep: str = "") -> str:
        """Trimmed non-empty pieces, joined."""
        return sep.join(s for s in map(str.strip, self.strings()) if s)

    def raw(self) -> str:
        """All text below, scripts included."""
        stack, out = list(reversed(self.children)), []
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += reversed(c.children)
        return "".join(out)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def has(self, *words: str) -> bool:
        """Whether class or id holds one of these."""
        own = (self.attrs.get("class", "") + " " + self.attrs.get("id", "")).lower()
        return any(w in own for w in words)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def _close(self, node: Node) -> None:
        """Close node and all that is open in it."""
        while self.at is not node:
            self.open[self.at.name] -= 1
            self.at = self.at.parent
        self.open[node.name] -= 1
        self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag in ("h1", "h2", "h3"):
            above = self.at
            while above is not None and not above.heading:
                above.heading, above = True, above.parent
        if tag not in VOID:
            self.open[tag] += 1
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag] > 0:
            node = self.at
            while node.name != tag:
                node = node.parent
            self._close(node)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The root node; its children are the document's."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):  # broken declarations: keep what was read
        pass
    return builder.root
