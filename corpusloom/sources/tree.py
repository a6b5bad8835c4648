"""A page as a tree, and the selectors that rules name parts of it by. Small helpers for tasks that read one page at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An element that begins ends an open one of these, up to a holder.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"div", "td", "li", "article", "section"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
#: Text in these is none of the page's.
SILENT = {"script", "style", "template"}
COMPOUND = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+|\[[\w:-]+(?:\*?='[^']*')?\])*)")
PART = re.compile(r"[.#][\w-]+|\[([\w:-]+)(?:(\*?=)'([^']*)')?\]")


class Node:
    """An element: tag, attributes, children (elements and texts), parent; ``place`` counts elements in document order and ``last`` is the
    place of the last one inside."""

    __slots__ = ("tag", "attrs", "children", "parent", "place", "last", "classes")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, place: int):
        self.tag, self.attrs, self.parent, self.place, self.last = tag, attrs, parent, place, place
        self.children: list = []
        self.classes = set((attrs.get("class") or "").split())

    def texts(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
            elif isinstance(x, str):
                if x.strip():
                    yield x.strip()
            elif x.tag not in SILENT:
                stack.append(iter(x.children))

    def text(self, between: str = "") -> str:
        return between.join(self.texts())

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class Page(HTMLParser):
    """All elements of a page in document order, also of one with tags that are missing or out of place."""

    def __init__(self, html: str | None):
        super().__init__()
        self.root = Node("", {}, None, -1)
        self.open, self.nodes = [self.root], []
        self.feed(html or "")
        self.close()
        for node in reversed(self.nodes):
            node.parent.last = max(node.parent.last, node.last)

    def handle_starttag(self, tag, attrs):
        ended, holders = ENDS.get(tag, ((), ()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in ended:
                del self.open[k:]
                break
            if self.open[k].tag in holders:
                break
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        node = Node(tag, known, self.open[-1], len(self.nodes))
        self.open[-1].children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def select(self, selector: str, within: Node | None = None) -> list[Node]:
        """The elements inside ``within`` (or of the page) that match, in document order."""
        first, last = (within.place + 1, within.last + 1) if within is not None and within.place >= 0 else (0, len(self.nodes))
        chains = compiled(selector)
        return [n for n in self.nodes[first:last] if any(matches(n, c) for c in chains)]

    def first(self, selector: str, within: Node | None = None) -> Node | None:
        return next(iter(self.select(selector, within)), None)


@lru_cache(maxsize=512)
def compiled(selector: str) -> list[list[tuple]]:
    """Each alternative (between commas) as compounds (tag, tests) from the last to the first; blanks mean "inside"."""
    out = []
    for alternative in selector.split(","):
        chain = []
        for word in alternative.split():
            m = COMPOUND.fullmatch(word)
            if not m or not word:
                raise ValueError(f"not a selector: {selector!r}")
            chain.append((m[1], [(p[0][0], p[0][1:], p[1], p[2], p[3]) for p in PART.finditer(m[2])]))
        out.append(chain[::-1])
    return out


def fits(node: Node, compound: tuple) -> bool:
    tag, tests = compound
    if tag and node.tag != tag:
        return False
    for kind, name, attr, op, value in tests:
        if kind == "." and name not in node.classes or kind == "#" and node.attrs.get("id") != name:
            return False
        if kind == "[" and (attr not in node.attrs or op == "=" and node.attrs[attr] != value or op == "*=" and value not in node.attrs[attr]):
            return False
    return True


def matches(node: Node, chain: list[tuple]) -> bool:
    """Whether an element fits the last compound and its ancestors the others, in turn."""
    if not fits(node, chain[0]):
        return False
    k = 1
    for above in node.above():
        if k == len(chain):
            break
        k += fits(above, chain[k])
    return k == len(chain)
