"""A small HTML tree: parse, walk, locate by path, edit and serialise.

The parser supplies html, head, body and tbody, closes paragraphs, items, cells and options where
their end tags are left out, and carries open formatting elements over into the next block. Other
misnested tags are closed where their parent is.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from functools import cache
from html.parser import HTMLParser

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split()
)
#: What a start tag closes, and what it doesn't look beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("html table td th caption button object template".split())
CELLS = frozenset("td th caption".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption colgroup".split())


class Node:
    """An element by its tag, or ``#text``, ``#comment``, ``#doctype`` with data."""

    __slots__ = ("attrs", "children", "data", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def within(self, other: Node) -> bool:
        up = self.parent
        while up is not None and up is not other:
            up = up.parent
        return up is not None

    @property
    def is_element(self) -> bool:
        return not self.tag.startswith("#")

    def walk(self) -> Iterator[Node]:
        """This node and what it holds, in document order, without recursion."""
        open_ = [self]
        while open_:
            node = open_.pop()
            yield node
            open_.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(n.data for n in self.walk() if n.tag == "#text")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.stack: list[Node] = []
        self.formatting: list[Node] = []
        self.in_body = False

    def begin_body(self) -> None:
        if not self.in_body:
            self.in_body, self.stack = True, [self.body]

    def top(self) -> Node:
        return self.stack[-1] if self.stack else (self.body if self.in_body else self.head)

    def reopen(self) -> None:
        """Formatting elements that a block's end closed go on in what follows."""
        cell = next((n for n in reversed(self.stack) if n.tag in CELLS), None)
        for i, node in enumerate(self.formatting):
            if node not in self.stack and (cell is None or node.within(cell)):
                again = self.top().add(Node(node.tag, dict(node.attrs)))
                self.formatting[i] = again
                self.stack.append(again)

    def close(self, tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> bool:
        for i in range(len(self.stack) - 1, 0 if self.in_body else -1, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return True
            if self.stack[i].tag in within:
                return False
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        for special, node in (("html", self.html), ("head", self.head), ("body", self.body)):
            if tag == special:
                node.attrs = {**given, **node.attrs}
                if tag == "body":
                    self.begin_body()
                return
        if not self.in_body and not self.stack and tag not in HEAD:
            self.begin_body()
        if self.in_body:
            if tag in CLOSES_P:
                self.close({"p"}, SCOPE)
            if tag in IMPLIED:
                closed, within = IMPLIED[tag]
                while self.close(closed, within):
                    pass
            if tag == "tr" and self.top().tag == "table":
                self.stack.append(self.top().add(Node("tbody")))
            if tag == "a" and any(n.tag == "a" for n in self.formatting):
                self.handle_endtag("a")
            if tag not in CLOSES_P and tag not in IMPLIED and tag not in RAW:
                self.reopen()
        node = self.top().add(Node(tag, given))
        if tag in VOID:
            return
        self.stack.append(node)
        if tag in FORMATTING and self.in_body:
            self.formatting.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.stack = self.stack if self.in_body else []
        elif tag in ("body", "html") or tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
        elif tag == "p" and self.in_body and not any(n.tag == "p" for n in self.stack):
            self.top().add(Node("p"))
        else:
            if tag in FORMATTING:
                last = next((n for n in reversed(self.formatting) if n.tag == tag), None)
                if last is not None:
                    self.formatting.remove(last)
            self.close({tag}, {"table"} - {tag} if tag in TABLE else SCOPE)

    def handle_data(self, data: str) -> None:
        if not self.in_body and not self.stack:
            data = data.lstrip(" \t\n\f\r")  # between the parts of a head
            if not data:
                return
            self.begin_body()
        if self.in_body and self.top().tag not in RAW:
            self.reopen()
        here = self.top()
        if here.children and here.children[-1].tag == "#text":
            here.children[-1].data += data
        else:
            here.add(Node("#text", data=data))

    def handle_comment(self, data: str) -> None:
        self.top().add(Node("#comment", data=data))

    def handle_decl(self, decl: str) -> None:
        if not self.root.children:
            self.root.add(Node("#doctype", data=decl))

    def finish(self) -> Node:
        self.html.add(self.head)
        self.html.add(self.body)
        self.root.add(self.html)
        return self.root


def parse(source: str | None) -> Node:
    """The document of a source; null and empty sources have a document without content."""
    builder = _Builder()
    builder.feed(source or "")
    try:
        HTMLParser.close(builder)
    except AssertionError:  # an unfinished declaration at the end
        pass
    return builder.finish()


def _quoted(value: str) -> str:
    return value.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


def _outer(node: Node) -> str:
    if node.tag == "#text":
        if node.parent is not None and node.parent.tag in RAW:
            return node.data
        return entities.escape(node.data, quote=False).replace("\xa0", "&nbsp;")
    if node.tag == "#comment":
        return f"<!--{node.data}-->"
    if node.tag == "#doctype":
        return f"<!{node.data}>"
    return f"<{node.tag}{''.join(f' {k}="{_quoted(v)}"' for k, v in node.attrs.items())}>" if node.is_element else ""


def serialise(root: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        out.append(_outer(at))
        if at.is_element and at.tag not in VOID:
            todo.append(f"</{at.tag}>")
        todo.extend(reversed(at.children))
    return "".join(out)


_COMPOUND = re.compile(
    r"""(?P<any>\*)|(?P<tag>[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<bare>[^\s\]]+))\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?P<call>\()?""",
    re.X,
)
#: Whether an attribute's value fits, by operator; an empty operand of the last three fits nothing.
_FITS = {
    "=": lambda have, want: have == want, "~=": lambda have, want: want in have.split(), "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: bool(want) and have.startswith(want), "$=": lambda have, want: bool(want) and have.endswith(want), "*=": lambda have, want: bool(want) and want in have,
}
Test = Callable[[Node], bool]


def _siblings(node: Node) -> list[Node]:
    return [c for c in node.parent.children if c.is_element] if node.parent is not None else [node]


def _nth(formula: str) -> Callable[[int], bool]:
    """Whether a position from 1 is in an+b."""
    bare = formula.replace(" ", "").lower()
    bare = {"odd": "2n+1", "even": "2n"}.get(bare, bare)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", bare)
    if m is None:
        raise ValueError(f"unknown selector formula {formula!r}")
    if m[3]:
        return lambda k: k == int(m[3])
    step, first = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    return lambda k: (k == first) if step == 0 else ((k - first) % step == 0 and (k - first) // step >= 0)


def _pseudo(name: str, inside: str | None) -> Test:
    if inside is None:
        plain: dict[str, Test] = {
            "first-child": lambda n: _siblings(n)[0] is n, "last-child": lambda n: _siblings(n)[-1] is n, "only-child": lambda n: len(_siblings(n)) == 1,
            "first-of-type": lambda n: next(c for c in _siblings(n) if c.tag == n.tag) is n, "last-of-type": lambda n: [c for c in _siblings(n) if c.tag == n.tag][-1] is n,
            "empty": lambda n: not any(c.is_element or c.tag == "#text" and c.data for c in n.children), "root": lambda n: n.tag == "html",
        }
        if name in plain:
            return plain[name]
    elif name in ("not", "is", "where", "has"):
        inner = compile_selector(inside)
        if name == "has":
            return lambda n: any(inner(c) for c in n.walk() if c is not n)
        return (lambda n: not inner(n)) if name == "not" else inner
    elif name in ("nth-child", "nth-of-type", "nth-last-child"):
        at = _nth(inside)

        def place(n: Node) -> bool:
            among = [c for c in _siblings(n) if name != "nth-of-type" or c.tag == n.tag]
            k = among.index(n)
            return at(len(among) - k if name == "nth-last-child" else k + 1)

        return place
    raise ValueError(f"unknown pseudo-class :{name}")


def _closing(text: str, at: int) -> int:
    """Where the parenthesis that is open at a place closes."""
    depth = 1
    for k in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[k], 0)
        if not depth:
            return k
    raise ValueError(f"unclosed parenthesis in selector {text!r}")


def _compound(text: str, at: int) -> tuple[Test, int]:
    tests: list[Test] = []
    start = at
    while (m := _COMPOUND.match(text, at)) is not None and m.end() > at:
        at = m.end()
        if m["tag"]:
            tests.append(lambda n, want=m["tag"].lower(): n.tag == want)
        elif m["cls"]:
            tests.append(lambda n, want=m["cls"]: want in n.attrs.get("class", "").split())
        elif m["id"]:
            tests.append(lambda n, want=m["id"]: n.attrs.get("id") == want)
        elif m["attr"]:
            name, fits = m["attr"].lower(), _FITS.get(m["op"])
            value = next((v for v in (m["q"], m["s"], m["bare"]) if v is not None), "")
            tests.append(lambda n, name=name, fits=fits, value=value: name in n.attrs and (fits is None or fits(n.attrs[name], value)))
        elif m["pseudo"]:
            inside = None
            if m["call"]:
                close = _closing(text, at)
                inside, at = text[at:close], close + 1
            tests.append(_pseudo(m["pseudo"], inside))
    if at == start:
        raise ValueError(f"unknown selector syntax at {text[at:]!r}")
    return (lambda n: n.is_element and all(t(n) for t in tests)), at


def _above(node: Node) -> Iterator[Node]:
    while (node := node.parent) is not None:
        yield node


def _before(node: Node) -> list[Node]:
    among = _siblings(node)
    return among[: next(i for i, c in enumerate(among) if c is node)]


def _one(text: str) -> Test:
    """A selector without commas: compounds joined by space, ``>``, ``+`` and ``~``."""
    test, at = _compound(text, 0)
    while at < len(text):
        m = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
        if m is None:
            raise ValueError(f"unknown selector syntax at {text[at:]!r}")
        left, how = test, m[1]
        right, at = _compound(text, m.end())

        def joined(n: Node, left: Test = left, right: Test = right, how: str | None = how) -> bool:
            if not right(n):
                return False
            if how == ">":
                return n.parent is not None and left(n.parent)
            if how == "+":
                return any(left(c) for c in _before(n)[-1:])
            return any(left(c) for c in (_before(n) if how == "~" else _above(n)))

        test = joined
    return test


@cache
def compile_selector(selector: str) -> Test:
    """Whether an element matches a list of selectors; syntax that isn't known is an error.

    Tags, classes, ids, attributes with all operators, the four combinators, :not, :is, :where,
    :has, and the positional pseudo-classes.
    """
    parts, depth, start = [], 0, 0
    for k, char in enumerate(selector):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(char, 0)
        if char == "," and not depth:
            parts.append(selector[start:k])
            start = k + 1
    tests = [_one(p.strip()) for p in (*parts, selector[start:])]
    return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)


def matches(node: Node, selector: str) -> bool:
    """Whether a node is an element that the selector matches."""
    return node.is_element and compile_selector(selector)(node)


def roots(document: Node, include: tuple[str, ...]) -> list[Node]:
    """The outermost elements that a selector finds, in selector order; the body without selectors."""
    found: list[Node] = []
    for selector in include or ("body",):
        found += [n for n in document.walk() if matches(n, selector) and n not in found]
    return [n for n in found if not any(n.within(other) for other in found)]


def locate(tops: list[Node], path: str) -> Node | None:
    """The node at a path; only the positions count. Null if there is none."""
    steps = [re.fullmatch(r"[^\[]+\[(\d+)\]", s) for s in path.split("/")]
    if not all(steps) or not path.startswith("root["):
        return None
    level, node = tops, None
    for step in steps:
        at = int(step[1])
        if at >= len(level):
            return None
        node = level[at]
        level = node.children
    return node
