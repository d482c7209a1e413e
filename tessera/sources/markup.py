"""Markup as a tree: selectors, texts, links and tables of what they take."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements that have no end tag, and those that a reader doesn't see.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "noscript", "iframe"}


class Node:
    """An element; children are elements and texts."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order in which they begin."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                todo += reversed(x.children)
            elif x.strip():
                yield x.strip()

    def leave(self) -> Node:
        """Takes the element out of what it stands in."""
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None
        return self

    def markup(self) -> str:
        out: list[str] = []
        todo: list[Node | str | tuple[str]] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(html.escape(x, quote=False))
            else:
                if x.tag:
                    out.append(f"<{x.tag}{''.join(f' {k}={chr(34)}{html.escape(v)}{chr(34)}' for k, v in x.attrs.items())}{'/' if x.tag in VOID else ''}>")
                    if x.tag not in VOID:
                        todo.append((f"</{x.tag}>",))
                todo += reversed(x.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.here = Node("", {}, None)
        self.unseen: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen.append(tag)
        elif not self.unseen:
            node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
            self.here.children.append(node)
            if tag not in VOID:
                self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.unseen:
            if tag in self.unseen:
                del self.unseen[self.unseen.index(tag) :]
            return
        node = self.here
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data):
        if not self.unseen:
            self.here.children.append(data)


def parsed(page: str | None) -> Node:
    """The tree of a page, without what a reader doesn't see. Any text is a page."""
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"([.#]?)([\w-]+|\*)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


def _step(text: str) -> list[tuple[str, str, str | None]]:
    """One compound selector: kinds and names of what an element must have."""
    out, at = [], 0
    for m in _SIMPLE.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        out.append(("[", m[3], m[4]) if m[3] else (m[1] or "tag", m[2], None))
    if at != len(text) or not out:
        raise ValueError(f"not a selector that is known: {text}")
    return out


def _fits(node: Node, step: list[tuple[str, str, str | None]]) -> bool:
    for kind, name, value in step:
        have = node.attrs
        if not {"tag": name in ("*", node.tag), ".": name in have.get("class", "").split(), "#": have.get("id") == name, "[": name in have and value in (None, have.get(name))}[kind]:
            return False
    return True


def compiled(selector: str) -> list[list]:
    """Alternatives of steps with what stands between them; names, .class, #id, [attribute], [attribute=value], ` ` and `>`."""
    out = []
    for part in selector.split(","):
        chain, child = [], False
        for token in re.sub(r"\s*>\s*", " > ", part.strip()).split():
            if token == ">":
                child = True
            else:
                chain.append((child, _step(token)))
                child = False
        if not chain or child or chain[0][0]:
            raise ValueError(f"not a selector that is known: {selector}")
        out.append(chain)
    return out


def _matches(node: Node, chain: list) -> bool:
    child, step = chain[-1]
    if not _fits(node, step):
        return False
    if len(chain) == 1:
        return True
    up = node.parent
    while up is not None and up.tag:
        if _matches(up, chain[:-1]):
            return True
        if child:
            return False
        up = up.parent
    return False


def selected(root: Node, chains: list[list]) -> list[Node]:
    """The elements that a compiled selector takes, in the order in which they begin."""
    return [n for n in root.walk() if any(_matches(n, c) for c in chains)]


def apart(nodes: list[Node]) -> Node:
    """A new element that holds these, each taken out of its place, so an inner one stands after the one around it."""
    box = Node("div", {}, None)
    for n in nodes:
        n.leave()
        n.parent = box
        box.children.append(n)
    return box


def text_of(root: Node, most: int | None = None) -> str:
    """The texts, a line each; no more than one blank line in a row."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(root.strings()))[:most]


def links_of(root: Node, most: int = 50, chars: int = 50) -> list[dict[str, str]]:
    """Addresses that are whole, and texts of the first anchors with one."""
    found = ({"url": n.attrs["href"], "text": "".join(n.strings())[:chars]} for n in root.walk() if n.tag == "a" and n.attrs.get("href", "").startswith(("http://", "https://")))
    return [x for x, _ in zip(found, range(most), strict=False)]


def tables_of(root: Node, most: int = 5) -> list[list[list[str]]]:
    """Cell texts of the first tables that have a row with cells."""
    out = []
    for t in root.walk():
        if t.tag == "table" and len(out) < most:
            rows = [["".join(c.strings()) for c in r.walk() if c.tag in ("td", "th")] for r in t.walk() if r.tag == "tr"]
            if rows := [r for r in rows if r]:
                out.append(rows)
    return out
