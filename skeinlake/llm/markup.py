"""Problem 6: markup residue in text documents.

Method: site style tree. The pages of one host are merged into one tree of styled branches (path of
elements with their classes); each branch gets an importance from two entropies over the pages that
have it: of its presentation (the kinds of its children) and of its content. Branches below
``MIN_IMPORTANCE`` - navigation, notices, footers that every page repeats - are removed from each
page; what remains is searched for markup and converted to clean text that keeps headings, lists,
code and formulas. Plain-text records have no tree: the whole record is one branch, always kept.

Defined results: null, empty and blank records have no markup and empty text; code samples of a
page, text in fences, and placeholders of problem 3 are no markup; a branch seen on one page only
has importance 1; repeated rows of one key count once.
"""
from __future__ import annotations

import re
from html import unescape
from html.entities import html5

import xxhash
from pyspark.sql import DataFrame, functions as F

from skeinlake.html.layout import render
from skeinlake.html.tree import HEADINGS, Node, parse_html
from skeinlake.llm.common import map_arrow, salted_join, written

MIN_IMPORTANCE = 0.3
#: Weight of a branch's presentation against its content.
PRESENTATION = 0.3
KINDS = ("html", "markdown", "wiki", "latex")

# fixed values: names of the markup languages
HTML_TAGS = (
    "a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol "
    "optgroup option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
LATEX_COMMANDS = (
    "begin end documentclass usepackage section subsection subsubsection paragraph chapter part title author date maketitle tableofcontents emph textbf textit texttt textsc underline cite citep citet "
    "ref eqref pageref label footnote item caption includegraphics bibliography bibliographystyle input include frac dfrac tfrac sqrt sum prod int mathbb mathcal mathrm mathbf left right href url newcommand renewcommand "
    "hline centering vspace hspace noindent bibitem appendix abstract overline hat bar vec operatorname text"
).split()
MAGIC_WORDS = "TOC NOTOC FORCETOC NOEDITSECTION NOINDEX INDEX NEWSECTIONLINK NOGALLERY HIDDENCAT DISAMBIG STATICREDIRECT".split()

_HTML = re.compile(
    r"<(?:/?(?:" + "|".join(t for t in HTML_TAGS if len(t) > 1) + r")(?:\s+[^<>]*|\s*/)?>|!--.*?-->|!DOCTYPE\b)"
    r"|(?<![\w<])</?(?:a|b|i|p|q|s|u)(?:\s+[^<>]*|\s*/)?>|(?<=\w)</(?:a|b|i|p|q|s|u)>|(?<=[^\W\d_])<p>",
    re.I | re.S,
)
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n]*\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_INLINE_CODE = re.compile(r"(?<![`\\])(`+)(?!`)([^`\n]+)\1(?!`)")
_MARKDOWN = re.compile(
    r"^[ ]{0,3}#{1,6}[ \t]+\S"  # heading
    r"|^[^\s>|=\-][^\n]*\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$"  # underlined heading
    r"|^[ ]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$"  # table rule
    r"|^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]"  # task list
    r"|^[ ]{0,3}\[(?:\^?[\w.-]+)\]:[ \t]+\S"  # link or footnote definition
    r"|!?\[[^\[\]\n]*\]\((?!\s)[^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)"  # link, image
    r"|\[[^\[\]\n]+\]\[[\w .-]*\](?!\[)|\[\^[\w-]+\]"  # reference link, footnote mark
    r"|(?<![\w*\\])\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*(?![\w*])|(?<![\w~])~~(?=\S)[^~\n]+(?<=\S)~~(?!~)"
    r"|(?<![\w_\\])__(?=[^\s_])(?![A-Z_]+__)[^_\n]+(?<=[^\s_])__(?![\w_])"
    r"|(?<![\w*\\])\*(?=[^\s*])[^*\n]*[^\W\d_][^*\n]*(?<=[^\s*])\*(?![\w*])"
    r"|^[ ]{0,3}>[ \t]+\S",
    re.M,
)
_LIST = re.compile(r"^[ ]{0,3}(?:[-*+]|\d{1,3}[.)])[ \t]+\S[^\n]*\n(?:[ \t]+[^\n]*\n)*[ ]{0,3}(?:[-*+]|\d{1,3}[.)])[ \t]+\S", re.M)
_ARRAY_INDEX = re.compile(r"\w\[[^\[\]\n]+\]\[[^\[\]\n]*\]")
_WIKI = re.compile(
    r"^[ ]?={2,6}[ \t]*[^=\s][^=\n]*?[ \t]*={2,6}[ \t]*$"  # heading
    r"|(?<!')'{2,5}(?=[^'\s])[^'\n]+(?:'[^'\n]+)*?(?<=[^\s'])'{2,5}(?!')"  # bold, italics
    r"|\[\[(?![A-Z]+_[A-Z_]*\]\])[^\[\]\n{}]+\]\]|\[\[(?:File|Image|Datei|Fichier|Archivo):"  # links
    r"|(?<!\w)\[(?:https?|ftp):?//[^\s\]]+(?:[ \t]+[^\]\n]+)?\](?!\()"  # external link
    r"|^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-+[ \t]*$"  # table
    r"|__(?:" + "|".join(MAGIC_WORDS) + r")__|^\#(?:REDIRECT|WEITERLEITUNG|REDIRECTION|REDIRECCIÓN)\b"
    r"|<ref\b[^<>]*>|\{\{[A-Za-z][^{}|\n]*\|[^{}]*\}\}|~~~~",
    re.M | re.I,
)
#: Formulas may be of any length but hold no blank line; inline ones end on their line.
_LATEX = re.compile(
    r"\\(?:" + "|".join(LATEX_COMMANDS) + r")\b\*?[ \t]*(?:\[[^\]\n]*\][ \t]*)?\{"
    r"|^[ \t]*\\(?:item|maketitle|tableofcontents|hline|noindent|centering|appendix)\b"
    r"|\\\[[^\n]*?[^\n\\]\s*\\\]|\\\[\s(?:(?!\n[ \t]*\n)(?!\\[\[\]])[\s\S])+?\s\\\]|\\\((?=\s*\S)[^\n]*?\\\)"
    r"|\$\$(?!\$)(?:[^$\n]|\n(?![ \t]*\n))+\$\$"
    r"|(?<![\\$\w])\$(?![\s{$(])[^$\n]*?(?:\\[a-zA-Z]+|[\^_][{\w]|[=<>+])[^$\n]*(?<![\s\\])\$(?![\d$])",
    re.M,
)
_MATH_SIGN = re.compile(r"\\[a-zA-Z]+|\^|_|[=<>+]")


def has_entity(text: str) -> bool:
    for m in _ENTITY.finditer(text):
        x = m.group(1)
        if x[0] == "#" or x + ";" in html5:
            return True
    return False


def markup_kinds(text: str, html: bool = True) -> list[str]:
    """The markup languages of which a text has at least one construct; ``html`` False leaves HTML out."""
    if not text or not text.strip():
        return []
    out = []
    fenced = False
    if "```" in text or "~~~" in text:
        plain = _FENCE.sub("\n", text)
        fenced = plain != text
        text = plain
    inline = False
    if "`" in text:
        plain = _INLINE_CODE.sub(" ", text)
        inline = plain != text
    else:
        plain = text
    if html and ("<" in plain and _HTML.search(plain) or "&" in plain and has_entity(plain)):
        out.append("html")
    if "[" in plain and "][" in plain:
        plain = _ARRAY_INDEX.sub(" ", plain)
    if fenced or inline or _MARKDOWN.search(plain) or _LIST.search(plain):
        out.append("markdown")
    if ("[" in plain or "'" in plain or "=" in plain or "{|" in plain or "__" in plain or "#" in plain or "{{" in plain or "~~~~" in plain or "<ref" in plain) and _WIKI.search(plain):
        out.append("wiki")
    if ("\\" in plain or "$" in plain) and _LATEX.search(plain):
        out.append("latex")
    return out


# ---- conversion -------------------------------------------------------------------------------


def _from_latex(t: str) -> str:
    t = re.sub(r"\\(?:documentclass|usepackage|label|bibliographystyle|bibliography|newcommand|renewcommand|vspace|hspace)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})+|\\(?:maketitle|tableofcontents|noindent|centering|appendix|hline)\b", "", t)
    for level, name in enumerate(("chapter", "section", "subsection", "subsubsection", "paragraph"), 1):
        t = re.sub(r"\\" + name + r"\*?\{([^{}]*)\}", lambda m, n=level: "\n" + "#" * n + " " + m.group(1) + "\n", t)
    t = re.sub(r"\\(?:emph|textbf|textit|texttt|textsc|underline|text|caption)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
    t = re.sub(r"\\(?:cite[pt]?|(?:eq|page)?ref)\{([^{}]*)\}", r"[\1]", t)
    t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\begin\{(?:equation|align|gather|displaymath|math)\*?\}\s*([\s\S]*?)\s*\\end\{(?:equation|align|gather|displaymath|math)\*?\}", r"$$ \1 $$", t)
    t = re.sub(r"\\\[\s*([\s\S]*?)\s*\\\]", r"$$ \1 $$", t)
    t = re.sub(r"\\\((.*?)\\\)", r"$\1$", t)
    t = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}([\s\S]*?)\\end\{(?:verbatim|lstlisting)\}", r"```\1```", t)
    t = re.sub(r"^[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", "- ", t, flags=re.M)
    t = re.sub(r"^[ \t]*\\(?:begin|end)\{[^{}]*\}[ \t]*\n?", "", t, flags=re.M)
    return re.sub(r"(?<=\w)~(?=\w)|(?<=\})~", " ", t)


def _from_wiki(t: str) -> str:
    t = re.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), t, flags=re.M)
    t = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", "", t, flags=re.S)
    t = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría):[^\[\]]*\]\]\n?", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo):[^\[\]|]*(?:\|[^\[\]|]*)*?\|([^\[\]|]*)\]\]", r"\1", t, flags=re.I)
    t = re.sub(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]|\[\[([^\[\]|]*)\]\]", lambda m: m.group(1) or m.group(2) or "", t)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"__(?:" + "|".join(MAGIC_WORDS) + r")__", "", t)
    t = re.sub(r"^#(REDIRECT|WEITERLEITUNG|REDIRECTION)[ \t:]*", "→ ", t, flags=re.M | re.I)
    t = re.sub(r"'{2,5}(?=\S)(.+?)(?<=\S)'{2,5}", r"\1", t)

    def table(m):
        rows, row = [], []
        for line in m.group(1).split("\n"):
            if line.startswith("|-"):
                rows.append(row)
                row = []
            elif line[:1] in "|!" and line.strip():
                row += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
        rows.append(row)
        return "\n".join("  ".join(r) for r in rows if r)

    return re.sub(r"^\{\|[^\n]*\n(.*?)^\|\}[ \t]*$", table, t, flags=re.M | re.S)


def _from_markdown(t: str) -> str:
    t = re.sub(r"^([^\s#>|\-=][^\n]*)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1), t, flags=re.M)
    t = re.sub(r"^[ ]{0,3}\[\^?[\w.-]+\]:[ \t]+(?:https?://\S+[ \t]*$\n?)?", "", t, flags=re.M)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)", r"\1", t)
    t = re.sub(r"(?<!\w)\[([^\[\]\n]+)\]\[[\w .-]*\]", r"\1", t)
    t = re.sub(r"\[\^[\w-]+\]", "", t)
    t = re.sub(r"(?<![\w*])\*\*(\S[^*\n]*?)\*\*|(?<!\w)__(?![A-Z_]+__)([^_\n]+)__(?!\w)|~~([^~\n]+)~~", lambda m: m.group(1) or m.group(2) or m.group(3), t)
    t = re.sub(r"^[ ]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\n?", "", t, flags=re.M)
    t = re.sub(r"^[ ]{0,3}\|(.*)\|[ \t]*$", lambda m: "  ".join(c.strip() for c in m.group(1).split("|")), t, flags=re.M)
    t = re.sub(r"^([ \t]*[-*+][ \t]+)\[[ xX]\][ \t]", r"\1", t, flags=re.M)
    return re.sub(r"^[ ]{0,3}>[ \t]?", "", t, flags=re.M)


def clean_text(text: str | None) -> str:
    """A text without markup: headings stay as ``#`` lines, lists as ``-``, code in fences, formulas in ``$``."""
    if not text or not text.strip():
        return ""
    kept: list[str] = []

    def keep(m):
        kept.append(m.group(0))
        return f"\x02{len(kept) - 1}\x02"

    kinds = markup_kinds(text)
    if "markdown" in kinds:
        text = _FENCE.sub(lambda m: keep(m) + "\n", text)
        text = _INLINE_CODE.sub(keep, text)
    if "latex" in kinds:
        text = _from_latex(text)
        text = re.sub(r"\$\$[^$]+\$\$|(?<![\\$\w])\$(?=\S)[^$\n]*[\\^_=<>+][^$\n]*\$(?!\d)", keep, text)
    if "wiki" in kinds:
        text = _from_wiki(text)
    if "html" in kinds:
        text = re.sub(r"^(?=[^\s<])", "", text)
        if _HTML.search(text):
            text = render(parse_html(re.sub(r"\n[ \t]*\n", "\n<p>", text).replace("\n", "<br>") if not re.search(r"<(?:p|div|ul|ol|table|body)\b", text, re.I) else text), headings=True)
        else:
            text = unescape(text)
        if "&" in text and has_entity(text):
            text = unescape(text)
        if _HTML.search(text):  # escaped tags
            text = _HTML.sub("", text)
    if "markdown" in kinds:
        text = _from_markdown(text)
    for i in range(len(kept) - 1, -1, -1):
        text = text.replace(f"\x02{i}\x02", kept[i])
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# ---- site style tree --------------------------------------------------------------------------

_INLINE = frozenset("a b i u s em strong span code kbd samp small big sub sup font tt q cite abbr mark label time img br input del ins strike var wbr bdi bdo acronym".split())
_CODE = frozenset("pre code samp kbd".split())
_SKIP = frozenset("script style template head iframe svg object textarea noscript".split())
_DIGITS = re.compile(r"\d+")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _plain(tree: Node) -> bool:
    """Whether a source has no page structure: no ``html``, ``head`` or ``body``, or text or code samples before the first of them."""
    first = next((n for n in tree.nodes if n.tag in ("html", "body", "head")), None)
    if first is None:
        return True
    up = first
    while up.parent is not tree:
        up = up.parent
        if up.tag in _CODE:
            return True
    for c in tree.children:
        if c is up:
            return False
        if c.__class__ is str and c.strip():
            return True
    return False


def _paths(tree: Node) -> tuple[list[str | None], dict[str, list[str]], list[bool]]:
    """The path of each element by its order (the root's last), the kinds of children of each path, and what is code."""
    nodes = tree.nodes
    n = len(nodes)
    path: list = [None] * (n + 1)
    path[-1] = "/"
    kinds: dict[str, list[str]] = {}
    code = [False] * (n + 1)
    for i, x in enumerate(nodes):
        up = path[x.parent.order]
        tag = x.tag
        if up is None or tag in _SKIP:
            continue
        if tag in _INLINE:
            path[i] = up
            if tag in _CODE:
                code[i] = True
        elif tag == "html" or tag == "body":
            path[i] = "/"
        else:
            name = x.get("class") or x.get("id") if len(x.raw) > 1 else ""
            path[i] = f"{up}{tag}.{_DIGITS.sub('', name)}/" if name else f"{up}{tag}/"
            kinds.setdefault(up, []).append(tag)
            code[i] = tag == "pre"
        if code[x.parent.order]:
            code[i] = True
    return path, kinds, code


def branches(html: str | None) -> list[tuple[int, int, int, str]]:
    """The styled branches of a page: path, presentation and content hash, and the text outside code samples.

    Elements of one path form one branch; inline elements belong to the branch they stand in. A
    source without page structure is one branch of path 0.
    """
    tree = parse_html(html)
    if _plain(tree):
        text = html or ""
        return [(0, 0, _signed(xxhash.xxh3_64_intdigest(text)), text)] if text.strip() else []
    path, kinds, code = _paths(tree)
    texts: dict[str, list[str]] = {}
    # text in document order, by path
    todo: list = [tree]
    while todo:
        x = todo.pop()
        if x.__class__ is tuple:
            texts.setdefault(x[0], []).append(x[1])
            continue
        p = path[x.order]
        if p is None:
            continue
        block = x.tag not in _INLINE
        if block or x.tag == "br":
            texts.setdefault(p, []).append("\n")
        if code[x.order]:
            texts.setdefault(p, []).append(" ")
            continue
        for c in reversed(x.children):
            todo.append((p, c) if c.__class__ is str else c)
    digest = xxhash.xxh3_64_intdigest
    out = []
    for p, pieces in texts.items():
        t = "".join(pieces)
        if t.strip():
            out.append((_signed(digest(p)), _signed(digest(" ".join(sorted(set(kinds.get(p, ())))))), _signed(digest(" ".join(t.split()))), t))
    return out


_MARKED = re.compile(r"\x03(\d+)\x04+")


def clean_page(html: str | None, dropped=frozenset()) -> str:
    """Clean text of a page in document order, without the text of the dropped branches; code samples stay as they are."""
    tree = parse_html(html)
    if _plain(tree):
        return clean_text(html)
    path, _, code = _paths(tree)
    gone = {p for p in set(path) if p is not None and _signed(xxhash.xxh3_64_intdigest(p)) in dropped} if dropped else ()
    kept: list[str] = []
    filled = [False] * (len(tree.nodes) + 1)
    for x in [*reversed(tree.nodes), tree]:  # elements after those below them
        if path[x.order] in gone:
            x.children = [c for c in x.children if c.__class__ is Node]
        if code[x.order] and not code[x.parent.order]:
            block = x.tag == "pre"
            text = render(x).strip("\n") if block else " ".join(render(x).split())
            x.children = []
            if text:
                if block or x.tag == "code":
                    mark = "```" if block else "`"
                    while mark in text:
                        mark += "`"
                    text = f"{mark}\n{text}\n{mark}" if block else f"{mark}{text}{mark}"
                x.children = [f"\x03{len(kept)}\x04".ljust(0 if block else len(text), "\x04")]
                kept.append(text)
            x.tag = "p" if block else "span"
        filled[x.order] = filled[x.order] or any(c.__class__ is str and c.strip() for c in x.children)
        if filled[x.order] and x is not tree and path[x.order] is not None:
            filled[x.parent.order] = True
    empty = {x.order for x in tree.nodes if not filled[x.order] and (x.tag == "li" or x.tag in HEADINGS)}
    text = clean_text(render(tree, empty, headings=True))
    return _MARKED.sub(lambda m: kept[int(m.group(1))], text) if kept else text


BRANCH = "fetch_id long, host string, path long, presentation long, content long, kinds array<string>"


def page_branches(fetched: DataFrame, search: bool = True) -> DataFrame:
    """One row per page and branch with the markup found in it, if wanted."""

    def rows(b):
        out = {k.split()[0]: [] for k in BRANCH.split(", ")}
        for f, host, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            for path, shape, content, t in branches(h):
                for k, v in zip(out, (f, host, path, shape, content, markup_kinds(t, html=False) if search else None)):
                    out[k].append(v)
        return out

    return map_arrow(fetched.select("fetch_id", "host", "html"), rows, BRANCH)


def _entropy(rows: DataFrame, by: str) -> DataFrame:
    """Entropy of ``by`` per branch over its pages, to the base of their number; 1 where there is one page."""
    counts = rows.groupBy("host", "path", by).count()
    m, s = F.sum("count"), F.sum(F.col("count") * F.log("count"))
    return counts.groupBy("host", "path").agg(F.when(m > 1, (F.log(m) - s / m) / F.log(m)).otherwise(F.lit(1.0)).alias(f"h_{by}"), m.alias("pages"))


def style_tree(rows: DataFrame) -> DataFrame:
    """``host, path, pages, importance`` of every branch of the merged pages of each host."""
    once = rows.groupBy("fetch_id", "path").agg(F.min(F.struct("host", "presentation", "content")).alias("x"))  # repeated rows of a fetch
    rows = once.select("fetch_id", "path", "x.*")
    a, b = _entropy(rows, "presentation"), _entropy(rows, "content").drop("pages")
    return a.join(b, ["host", "path"]).select("host", "path", "pages", (PRESENTATION * F.col("h_presentation") + (1 - PRESENTATION) * F.col("h_content")).alias("importance"))


def _kept(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the wanted rows those whose branch is important in the tree built from all rows."""
    tree = style_tree(rows).filter((F.col("importance") >= MIN_IMPORTANCE) & F.col("host").isNotNull())
    key = F.xxhash64("host", "path")
    important = tree.select(key.alias("branch")).distinct()
    known = salted_join(wanted.filter(F.col("host").isNotNull()).withColumn("branch", key), important, "branch").drop("branch")
    return known.unionByName(wanted.filter(F.col("host").isNull()))


def page_markup(fetched: DataFrame) -> DataFrame:
    """``fetch_id, markup``: markup shown in the important branches of pages, and in sources that are no HTML."""
    rows = written(page_branches(fetched))
    wanted = rows.filter(F.size("kinds") > 0).select("fetch_id", "host", "path", "kinds")
    plain = wanted.filter("path = 0")
    return _kept(rows, wanted.filter("path <> 0")).unionByName(plain).select("fetch_id", F.explode("kinds").alias("markup")).distinct()


def clean_pages(fetched: DataFrame) -> DataFrame:
    """``fetch_id, text``: the clean text of the important branches of each page in document order, one row per fetch."""
    rows = written(page_branches(fetched, search=False).drop("kinds"))
    key = F.xxhash64("host", "path")
    low = style_tree(rows).filter((F.col("importance") < MIN_IMPORTANCE) & F.col("host").isNotNull()).select(key.alias("branch")).distinct()
    found = rows.filter("path <> 0 AND host IS NOT NULL").select("fetch_id", "path", key.alias("branch"))
    dropped = salted_join(found, low, "branch").groupBy("fetch_id").agg(F.collect_set("path").alias("dropped"))
    pages = fetched.select("fetch_id", "html", F.lit(None).cast("array<long>").alias("dropped")).unionByName(dropped.withColumn("html", F.lit(None).cast("string")))
    pages = pages.groupBy("fetch_id").agg(F.min("html").alias("html"), F.flatten(F.collect_list("dropped")).alias("dropped"))

    def texts(b):
        return {"fetch_id": b.column(0), "text": [clean_page(h, frozenset(d or ())) for h, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]}

    return map_arrow(pages, texts, "fetch_id long, text string")


def document_markup(indexed: DataFrame) -> DataFrame:
    """``document_id, markup`` of documents whose text has markup."""

    def rows(b):
        out = {"document_id": [], "markup": []}
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for k in markup_kinds(t or ""):
                out["document_id"].append(d)
                out["markup"].append(k)
        return out

    return map_arrow(indexed.select("document_id", "text"), rows, "document_id string, markup string").distinct()


def clean_documents(indexed: DataFrame) -> DataFrame:
    """``document_id, text``: documents converted to clean text, one row per document."""

    def rows(b):
        return {"document_id": b.column(0), "text": [clean_text(t) for t in b.column(1).to_pylist()]}

    return map_arrow(indexed.select("document_id", "text"), rows, "document_id string, text string").dropDuplicates(["document_id"])
