"""A small HTML tree builder: one regular-expression scan, implied end tags, no dependencies.

It runs inside Arrow Python functions, so it is written for throughput: one compiled scanner, a
node class with slots, attributes parsed only when somebody asks for them.
"""
from __future__ import annotations

import re
from html import unescape

#: One alternative per markup construct; the scanner splits a page into text and these in one call.
#: Quoted attribute values may hold ">"; a tag with an unbalanced quote falls back to ending at the
#: next ">". Elements whose content is raw text are one token with that content.
_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|(script|style|title|textarea|xmp|iframe|noembed|noframes)\b([^>]*+)(?:>|\Z)(.*?)(?:</\1[^>]*>|\Z)"
    r"|(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^<>\"']*+(?:\"[^\"]*+\"|'[^']*+'))*+[^<>\"']*+>|[^>]*+(?:>|\Z))"
    r"|[!?/][^>]*+(?:>|\Z))",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# fixed values: HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont frame".split())
BLOCKISH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open element of the second set, unless a barrier of the third lies between.
_CLOSES = {t: (frozenset(["p"]), frozenset("button object applet marquee td th caption table".split())) for t in BLOCKISH}
_CLOSES |= {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: A closing tag never closes an element beyond these, unless it names one of them.
_SCOPE = frozenset("table td th".split())
_SCOPED = frozenset("table tr td th tbody thead tfoot body html".split())
_ROWS = frozenset("tr thead tbody tfoot".split())


class Node:
    """An element. ``children`` mixes nodes and unescaped strings; ``order`` numbers opening tags from 0."""

    __slots__ = ("tag", "raw", "parent", "children", "order", "_attrs", "nodes")

    def __init__(self, tag: str, raw: str, parent: "Node | None", order: int):
        self.tag, self.raw, self.parent, self.order = tag, raw, parent, order
        self.children: list = []
        self._attrs = None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            a: dict[str, str] = {}
            if len(self.raw) > 1:
                for k, x, y, z in _ATTR.findall(self.raw[:-1] if self.raw.endswith(">") else self.raw):
                    v = x or y or z
                    a.setdefault(k.lower(), unescape(v) if "&" in v else v)
            self._attrs = a
        return self._attrs

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default) if len(self.raw) > 1 else default

    def walk(self):
        """This node and all elements below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if c.__class__ is Node)

    def find_all(self, *tags: str) -> list["Node"]:
        want = set(tags)
        return [n for n in self.walk() if n.tag in want]

    def texts(self):
        """Text pieces below this node in document order; scripts and styles are skipped."""
        stack = [self]
        while stack:
            n = stack.pop()
            if n.__class__ is str:
                yield n
            elif n.tag != "script" and n.tag != "style":
                stack.extend(reversed(n.children))

    def text(self, sep: str = "") -> str:
        return sep.join(self.texts())


def parse_html(html: str | None) -> Node:
    """The root (tag ``#root``) of the tree of a page; null and empty pages give an empty root.

    Unclosed ``p``, ``li``, ``dt``, ``dd``, table parts and ``option`` are closed where the HTML
    standard implies it; stray closing tags are ignored; truncated pages keep what is there.
    ``root.nodes`` lists all elements in the order of their opening tags.
    """
    root = Node("#root", "", None, -1)
    root.nodes = nodes = []
    if not html:
        return root
    cur, order = root, 0
    parts = _TOKEN.split(html)
    if parts[0]:
        cur.children.append(unescape(parts[0]) if "&" in parts[0] else parts[0])
    i, n_parts = 1, len(parts)
    while i < n_parts:
        raw, raw_attrs, raw_text, slash, tag, rest, t = parts[i : i + 7]
        i += 7
        if tag:
            tag = tag.lower()
            if slash:
                n = cur
                while n is not root and n.tag != tag:
                    if n.tag in _SCOPE and tag not in _SCOPED:
                        n = root
                        break
                    n = n.parent
                if n is not root:
                    cur = n.parent
            else:
                rule = _CLOSES.get(tag)
                if rule is not None:
                    ends, barrier = rule
                    n = cur
                    while n is not root:
                        if n.tag in ends:
                            cur = n.parent
                            if tag not in _ROWS:
                                break
                        elif n.tag in barrier:
                            break
                        n = n.parent
                node = Node(tag, rest, cur, order)
                nodes.append(node)
                order += 1
                cur.children.append(node)
                if tag not in VOID and not (rest[-2:] == "/>" and tag not in BLOCKISH):
                    cur = node
        elif raw:
            node = Node(raw.lower(), raw_attrs + ">", cur, order)
            nodes.append(node)
            order += 1
            cur.children.append(node)
            if raw_text:
                node.children.append(unescape(raw_text) if "&" in raw_text and node.tag in ("title", "textarea") else raw_text)
        if t:
            cur.children.append(unescape(t) if "&" in t else t)
    return root
