"""Rendering a tree as plain text the way a page is laid out.

Blocks are parted as on screen, list items keep bullets or numbers and their nesting, preformatted
text keeps its spacing, and the cells of a table are padded to columns.
"""
from __future__ import annotations

from skeinlake.html.tree import Node

# fixed values: element classes by layout
SKIP = frozenset("script style template head iframe svg object select textarea noembed noframes noscript xmp".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table article section header footer main nav aside figure hr fieldset".split())
LINE = frozenset("div li dt dd tr address center form details summary figcaption caption body html option legend menu dir".split())


# fixed values: elements that are numbered as blocks of a page
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd".split())


def _table(node: Node, skip, shown) -> str:
    rows: list[list[str]] = []
    todo = [node]
    while todo:
        n = todo.pop()
        for c in reversed(n.children) if n.tag != "tr" else ():
            if c.__class__ is Node and c.order not in skip and c.tag in ("thead", "tbody", "tfoot", "tr"):
                todo.append(c)
        if n.tag == "tr":
            rows.append([" ".join(render(c, skip, shown=shown).split()) for c in n.children if c.__class__ is Node and c.tag in ("td", "th") and c.order not in skip])
    width = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
    return "\n".join("  ".join(x.ljust(width[i]) for i, x in enumerate(r)).rstrip() for r in rows)


def is_data_table(node: Node) -> bool:
    """A table whose rows have at least two cells, none of which holds block layout of its own."""
    cells = 0
    for n in node.walk():
        if n.tag == "tr":
            cells = max(cells, sum(c.__class__ is Node and c.tag in ("td", "th") for c in n.children))
        elif n is not node and n.tag in ("table", "p", "ul", "ol", "h1", "h2", "h3", "pre", "article", "div"):
            return False
    return cells >= 2


def render(root: Node, skip=frozenset(), headings: bool = False, shown: set | None = None) -> str:
    """Visible text below a node; ``skip`` holds orders of elements to leave out, ``headings`` marks them with ``#``.

    The orders of the ``BLOCKS`` elements of which some text is laid out are added to ``shown``.
    """
    out: list[str] = []
    texts = 0
    lists: list[list] = []

    def gap(n: int):
        if out:
            have = 0
            for x in reversed(out):
                if x.strip("\n"):
                    break
                have += x.count("\n")
            else:
                return
            if have < n:
                out.append("\n" * (n - have))

    pre = 0
    todo: list = [root]
    while todo:
        x = todo.pop()
        if x.__class__ is str:
            if pre:
                out.append(x)
                if not x.isspace():
                    texts += 1
            else:
                t = " ".join(x.split())
                if t:
                    texts += 1
                    if out and x[0].isspace() and not out[-1].endswith(("\n", " ")):
                        out.append(" ")
                    out.append(t)
                    if x[-1].isspace():
                        out.append(" ")
                elif out and not out[-1].endswith(("\n", " ")):
                    out.append(" ")
            continue
        if x.__class__ is tuple:
            tag = x[0]
            if shown is not None and tag in BLOCKS and texts > x[2]:
                shown.add(x[1])
            if tag == "pre":
                pre -= 1
                gap(1)
                if headings:
                    out.append("```")
            elif tag in ("ul", "ol"):
                lists.pop()
            elif tag == "code" and headings and not pre:
                out.append("`")
            gap(2 if tag in PARAGRAPH and not (tag in ("ul", "ol") and lists) else 1 if tag in LINE else 0)
            continue
        tag = x.tag
        if tag in SKIP or x.order in skip:
            continue
        if tag == "br":
            out.append("\n")
            continue
        if tag == "table" and is_data_table(x):
            gap(2)
            t = _table(x, skip, shown)
            texts += bool(t)
            out.append(t)
            gap(2)
            continue
        if tag in PARAGRAPH:
            gap(1 if lists else 2)
        elif tag in LINE:
            gap(1)
        if tag in ("ul", "ol"):
            lists.append([tag, 0])
        elif tag == "li":
            depth = max(0, len(lists) - 1)
            if lists and lists[-1][0] == "ol":
                lists[-1][1] += 1
                out.append("  " * depth + f"{lists[-1][1]}. ")
            else:
                out.append("  " * depth + "- ")
        elif tag == "pre":
            pre += 1
            if headings:
                out.append("```\n")
        elif tag == "code" and headings and not pre:
            out.append("`")
        elif headings and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            out.append("#" * int(tag[1]) + " ")
        todo.append((tag, x.order, texts))
        todo.extend(reversed(x.children))
    text = "".join(out)
    return "\n".join(line.rstrip() for line in text.split("\n")).strip("\n")
