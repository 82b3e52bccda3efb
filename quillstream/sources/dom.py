"""A small document tree of HTML with selectors, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that stand on lines of their own.
BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style noscript template".split())


class Node:
    """An element with its attributes, children and texts in order, and the length of its inner source."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []
        self.start = self.end = 0

    @property
    def size(self) -> int:
        return max(0, self.end - self.start)

    def walk(self) -> Iterator[Node]:
        """The element and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [p for p in reversed(n.parts) if isinstance(p, Node)]

    def above(self) -> Iterator[Node]:
        """The element and all above it, without the document."""
        n: Node | None = self
        while n is not None and n.tag:
            yield n
            n = n.parent

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def sibling(self, step: int) -> Node | None:
        """The element before (-1) or after (1) it."""
        if self.parent is None:
            return None
        all_ = self.parent.children()
        k = next(i for i, n in enumerate(all_) if n is self) + step
        return all_[k] if 0 <= k < len(all_) else None

    def inner(self, without: frozenset[str] | set[int] = frozenset(), tags: frozenset[str] = frozenset()) -> str:
        """Text as it is read: blocks on lines of their own, runs of blanks as one. Elements of `tags` and those whose
        identity is in `without` are left out."""
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.parts))
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p if p == "\n" else re.sub(r"\s+", " ", p))
            elif p.tag not in HIDDEN and p.tag not in tags and id(p) not in without:
                edge = ["\n"] if p.tag in BLOCK else []
                stack += [*edge, *reversed(p.parts), *edge]
        lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)

    def all(self, selector: str) -> list[Node]:
        """Elements below that match, in document order."""
        wanted = parsed(selector)
        return [n for n in self.walk() if n is not self and any(_matches(n, s) for s in wanted)]

    def one(self, selector: str) -> Node | None:
        wanted = parsed(selector)
        return next((n for n in self.walk() if n is not self and any(_matches(n, s) for s in wanted)), None)

    def matches(self, selector: str) -> bool:
        return any(_matches(self, s) for s in parsed(selector))

    def within(self, selector: str) -> Node | None:
        """The nearest of the element and those above it that matches."""
        return next((n for n in self.above() if n.matches(selector)), None)


class _Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.lines = [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.feed(html)
        self.close()
        while self.at is not self.root:
            self.at.end = len(html)
            self.at = self.at.parent

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        n.start = n.end = self.place() + len(self.get_starttag_text() or "")
        self.at.parts.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            here = self.place()
            while self.at is not n.parent:
                self.at.end = here
                self.at = self.at.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str) -> Node:
    """The document of a page; broken pages give what can be read."""
    return _Tree(html).root


_PART = re.compile(r"""(?P<tag>^[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)["']?(?P<val>[^"'\]]*)["']?)?\]""")
Simple = tuple[str, tuple[tuple[str, str, str], ...]]


@lru_cache(maxsize=512)
def parsed(selector: str) -> tuple[tuple[tuple[str, Simple], ...], ...]:
    """Alternatives of steps (how it follows the step before, test)."""
    out = []
    for alternative in selector.split(","):
        steps, how = [], " "
        for word in re.findall(r"""(?:\[[^\]]*\]|[^\s\[])+""", alternative):
            if word == ">":
                how = ">"
                continue
            tag, tests = "", []
            for m in _PART.finditer(word):
                if m["tag"]:
                    tag = m["tag"].lower()
                elif m["id"]:
                    tests.append(("id", "=", m["id"]))
                elif m["cls"]:
                    tests.append(("class", "~=", m["cls"]))
                else:
                    tests.append((m["attr"].lower(), m["op"] or "", m["val"] or ""))
            steps.append((how, (tag, tuple(tests))))
            how = " "
        out.append(tuple(steps))
    return tuple(out)


def _is(n: Node, simple: Simple) -> bool:
    tag, tests = simple
    if tag and n.tag != tag:
        return False
    for name, op, value in tests:
        got = n.attrs.get(name)
        if got is None or op == "=" and got != value or op == "~=" and value not in got.split() or op == "*=" and value not in got or op == "^=" and not got.startswith(value):
            return False
    return True


def _matches(n: Node, steps: tuple[tuple[str, Simple], ...]) -> bool:
    how, simple = steps[-1]
    if not _is(n, simple):
        return False
    if len(steps) == 1:
        return True
    up = [n.parent] if how == ">" else list(n.above())[1:]
    return any(p is not None and p.tag and _matches(p, steps[:-1]) for p in up)
