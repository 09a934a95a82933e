"""What a page says, from its tree: metadata, links, images, headings, JSON-LD, main content, clean HTML, Markdown.

All functions take a tree and give plain values; malformed pages give empty values and warnings,
never an exception.
"""
from __future__ import annotations

import json
import re
from html import escape
from urllib.parse import urljoin, urlsplit

from skeinlake.html.tree import Node, parse_html

# fixed values: scoring terms and element lists of the content rules
POSITIVE_TERMS = "article content post entry story main body text blog detail page readable".split()
NEGATIVE_TERMS = (
    "nav navigation menu footer header sidebar aside advert advertisement ads ad- cookie banner popup modal related comments comment social share widget promo breadcrumb disclaimer signup newsletter"
).split()
TAG_BONUS = {"article": 35.0, "main": 30.0, "section": 15.0, "div": 5.0}
STRIPPED = frozenset("script style noscript iframe canvas svg form input button select textarea option template head meta link dialog object embed applet".split())
PRESERVED = frozenset(
    (
        "html body main article section header footer nav aside h1 h2 h3 h4 h5 h6 p div span blockquote pre code b strong i em u s del strike mark sub sup small a img picture figure figcaption "
        "ul ol li dl dt dd table thead tbody tfoot tr th td caption hr br"
    ).split()
)
#: A title that stands outside a head is dropped as well.
DROPPED = STRIPPED | {"title"}
KEPT_ATTRIBUTES = {"a": ("href", "title", "rel"), "img": ("src", "alt", "title", "width", "height"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan"), "code": ("class",), "pre": ("class",)}
_SCHEMES = re.compile(r"\s*(?:javascript|mailto|tel|data|sms|callto|fax|magnet):", re.I)


def resolve(base: str | None, href: str) -> str | None:
    """Absolute web address of an href without its default port, or None."""
    h = href.strip()
    if not h or h == "#" or _SCHEMES.match(h):
        return None
    try:
        u = urlsplit(urljoin(base or "", h))
        if u.scheme not in ("http", "https") or not u.hostname:
            return None
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return None
    host = f"[{u.hostname}]" if ":" in u.hostname else u.hostname
    return f"{u.scheme}://{host}{port}{u.path or '/'}" + (f"?{u.query}" if u.query else "") + (f"#{u.fragment}" if u.fragment else "")


def _first(root: Node, tag: str) -> Node | None:
    return next((n for n in root.nodes if n.tag == tag), None)


def _text(n: Node) -> str:
    return " ".join(t for t in (x.strip() for x in n.texts()) if t)


def metadata(root: Node, url: str | None = None) -> dict:
    """Title, description and the other head facts; plain metas keep the first value, og and twitter the last."""
    html, title = _first(root, "html"), _first(root, "title")
    plain: dict[str, str] = {}
    social: dict[str, str] = {}
    for m in (n for n in root.nodes if n.tag == "meta"):
        name = (m.get("property") or m.get("name")).strip().lower()
        value = m.get("content").strip()
        if m.get("charset"):
            plain.setdefault("charset", m.get("charset").strip())
        if m.get("http-equiv").lower() == "content-type" and "charset=" in value.lower():
            plain.setdefault("charset", value.lower().split("charset=")[1].split(";")[0].strip())
        if name and value:
            (social if name.startswith(("og:", "twitter:")) else plain)[name] = value if name.startswith(("og:", "twitter:")) else plain.get(name, value)
    links = {}
    for n in root.nodes:
        if n.tag == "link":
            for rel in n.get("rel").lower().split():
                links.setdefault(rel, n.get("href"))
    h1 = _first(root, "h1")
    pick = lambda *xs: next((x for x in xs if x), None)
    return {
        "title": pick(title and title.text().strip(), social.get("og:title"), social.get("twitter:title"), h1 and _text(h1)),
        "description": pick(plain.get("description"), social.get("og:description"), social.get("twitter:description")),
        "language": pick(html and html.get("lang").strip(), html and html.get("xml:lang").strip()),
        "canonical_url": resolve(url, links["canonical"]) if links.get("canonical") else None,
        "charset": plain.get("charset"),
        "favicon": resolve(url, links.get("icon") or links.get("shortcut") or "") if links.get("icon") or links.get("shortcut") else None,
        "author": pick(plain.get("author"), plain.get("article:author")),
        "robots": plain.get("robots"),
        "published_time": pick(plain.get("article:published_time"), plain.get("date"), plain.get("pubdate")),
        "generator": plain.get("generator"),
        "theme_color": plain.get("theme-color"),
        "open_graph": {k[3:]: v for k, v in social.items() if k.startswith("og:")},
        "twitter": {k[8:]: v for k, v in social.items() if k.startswith("twitter:")},
    }


def links(root: Node, url: str | None = None) -> list[dict]:
    """Distinct links in order of first sight with their text, rel and whether they leave the host."""
    base = next((n.get("href") for n in root.nodes if n.tag == "base" and n.get("href")), None)
    base = urljoin(url or "", base) if base else url
    host = (urlsplit(url).hostname or "").lower() if url else ""
    out: dict[str, dict] = {}
    for n in root.nodes:
        if n.tag == "a" and "href" in n.attrs:
            target = resolve(base, n.get("href"))
            if target and target not in out:
                out[target] = {"url": target, "text": _text(n), "rel": n.get("rel").split(), "is_external": (urlsplit(target).hostname or "").lower() != host}
    return list(out.values())


def images(root: Node, url: str | None = None) -> list[dict]:
    out = []
    for n in root.nodes:
        if n.tag == "img":
            src = resolve(url, n.get("src") or n.get("data-src") or n.get("data-original") or "")
            if src:
                size = lambda k, n=n: int(n.get(k)) if n.get(k).isdigit() else None
                out.append({"url": src, "alt": n.get("alt") or None, "title": n.get("title") or None, "width": size("width"), "height": size("height"), "srcset": n.get("srcset") or None, "loading": n.get("loading") or None})
    return out


def headings(root: Node) -> list[dict]:
    return [{"level": int(n.tag[1]), "text": t, "id": n.get("id") or n.get("name") or None} for n in root.nodes if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1] in "123456" and (t := _text(n))]


def json_ld(root: Node) -> tuple[list, list[str]]:
    """JSON-LD values, arrays flattened and the members of a ``@graph`` behind it, with warnings for what is no JSON."""
    out, warnings = [], []

    def add(v):
        if isinstance(v, list):
            for x in v:
                add(x)
        elif v not in out:
            out.append(v)
            if isinstance(v, dict) and isinstance(v.get("@graph"), list):
                for x in v["@graph"]:
                    add(x)

    for n in root.nodes:
        if n.tag == "script" and n.get("type").strip().lower() == "application/ld+json":
            try:
                add(json.loads(n.text() or "".join(c for c in n.children if c.__class__ is str)))
            except ValueError as e:
                warnings.append(f"invalid_json_ld: {e.__class__.__name__}")
    return out, warnings


def table_pairs(root: Node) -> list[tuple[str, str]]:
    """Name and value of the rows of two cells, in order; rows with an empty name give none."""
    out = []
    for row in root.find_all("tr"):
        cells = [" ".join(c.text(" ").split()) for c in row.children if c.__class__ is Node and c.tag in ("td", "th")]
        if len(cells) == 2 and cells[0]:
            out.append((cells[0].rstrip(": "), cells[1]))
    return out


def definitions(root: Node) -> list[tuple[str, str]]:
    """Terms and descriptions of definition lists."""
    out, term = [], ""
    for n in root.nodes:
        if n.tag == "dt":
            term = _text(n)
        elif n.tag == "dd" and term:
            out.append((term, _text(n)))
    return out


def _bytes(n: Node) -> int:
    return len("".join(n.texts()).strip().encode())


def score(n: Node) -> float:
    """Readability of a container: element and class terms, text, paragraphs and headings, less its link density."""
    text = _bytes(n)
    names = f"{n.get('class')} {n.get('id')}".lower()
    s = TAG_BONUS.get(n.tag, 0.0) + 25.0 * sum(t in names for t in POSITIVE_TERMS) - 30.0 * sum(t in names for t in NEGATIVE_TERMS)
    inside = list(n.walk())[1:]
    s += text / 80.0 + 12.0 * sum(x.tag == "p" for x in inside) + 6.0 * sum(x.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for x in inside)
    density = sum(_bytes(x) for x in inside if x.tag == "a") / text if text else 1.0
    return s * (1.0 - density) if density > 0.5 else s


def main_content(root: Node) -> tuple[Node, list[str]]:
    """The node of the main content: an article, a main element, the best container, else the body with a warning."""
    articles = [n for n in root.nodes if n.tag == "article"]
    if len(articles) == 1 and _bytes(articles[0]) >= 150:
        return articles[0], []
    if len(articles) > 1:
        best = max(articles, key=score)
        if score(best) > 30:
            return best, []
    main = _first(root, "main")
    if main is not None and _bytes(main) >= 100:
        return main, []
    candidates = [n for n in root.nodes if n.tag in ("article", "main", "section", "div")]
    if candidates:
        best = max(candidates, key=score)
        if score(best) > 15:
            return best, []
    return _first(root, "body") or root, ["missing_main_content"]


def _hidden(n: Node) -> bool:
    a = n.attrs
    style = a.get("style", "").lower().replace(" ", "")
    pixel = n.tag == "img" and a.get("width", "").strip() in ("0", "1") and a.get("height", "").strip() in ("0", "1")
    return "display:none" in style or "visibility:hidden" in style or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or pixel


def clean_html(n: Node) -> str:
    """HTML of a subtree without scripts, forms, hidden parts and pixels; unknown elements are unwrapped."""
    out: list[str] = []

    def emit(x, pre: bool):
        if x.__class__ is str:
            if pre:
                out.append(escape(x, quote=False))
            else:
                t = re.sub(r"\s+", " ", x)
                if out and out[-1][-1:] in " \n>" or not out:
                    t = t.lstrip()
                if t:
                    out.append(escape(t, quote=False))
            return
        if x.tag in DROPPED or len(x.raw) > 1 and _hidden(x):
            return
        keep = x.tag in PRESERVED
        if keep:
            attrs = "".join(f' {k}="{escape(x.get(k))}"' for k in KEPT_ATTRIBUTES.get(x.tag, ()) if k in x.attrs)
            out.append(f"<{x.tag}{attrs}>")
        for c in x.children:
            emit(c, pre or x.tag == "pre")
        if keep and x.tag not in ("img", "br", "hr"):
            out.append(f"</{x.tag}>")

    emit(n, False)
    return "".join(out).strip()


def markdown(n: Node) -> str:
    """Markdown of a subtree: headings, emphasis, code, links, images, nested lists, quotes, tables."""

    def inline(x) -> str:
        if x.__class__ is str:
            return re.sub(r"\s+", " ", x)
        if x.tag in DROPPED:
            return ""
        t = x.tag
        if t == "br":
            return "  \n"
        if t == "img":
            return f"![{x.get('alt')}]({x.get('src')})" if x.get("src") else ""
        body = "".join(map(inline, x.children))
        s = body.strip()
        if not s:
            return " " if body else ""
        lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
        if t in ("b", "strong"):
            return f"{lead}**{s}**{tail}"
        if t in ("i", "em"):
            return f"{lead}*{s}*{tail}"
        if t in ("s", "del", "strike"):
            return f"{lead}~~{s}~~{tail}"
        if t == "code":
            return f"{lead}`{s}`{tail}"
        if t == "a" and x.get("href"):
            return f"{lead}[{s}]({x.get('href')}){tail}"
        return body

    def table(x) -> str:
        rows = [[re.sub(r"\s+", " ", inline(c)).strip().replace("|", "\\|") for c in r.children if c.__class__ is Node and c.tag in ("td", "th")] for r in x.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])

    def items(x, depth: int) -> str:
        out, no = [], 0
        for c in x.children:
            if c.__class__ is not Node or c.tag != "li":
                continue
            no += 1
            own = "".join(inline(k) for k in c.children if not (k.__class__ is Node and k.tag in ("ul", "ol"))).strip()
            out.append("  " * depth + (f"{no}. " if x.tag == "ol" else "- ") + re.sub(r"\s*\n\s*", " ", own))
            out += [items(k, depth + 1) for k in c.children if k.__class__ is Node and k.tag in ("ul", "ol")]
        return "\n".join(o for o in out if o)

    def blocks(x) -> list[str]:
        out: list[str] = []
        line: list[str] = []

        def flush():
            s = re.sub(r" *\n *", "\n", "".join(line)).strip()
            if s:
                out.append(s)
            line.clear()

        for c in x.children:
            if c.__class__ is str or c.tag in ("a", "b", "strong", "i", "em", "u", "s", "del", "strike", "code", "span", "img", "br", "sub", "sup", "small", "mark", "kbd", "abbr", "time", "label", "font"):
                line.append(inline(c))
                continue
            if c.tag in DROPPED:
                continue
            flush()
            t = c.tag
            if len(t) == 2 and t[0] == "h" and t[1] in "123456":
                s = re.sub(r"\s+", " ", "".join(map(inline, c.children))).strip()
                if s:
                    out.append("#" * int(t[1]) + " " + s)
            elif t == "pre":
                code = next((k for k in c.walk() if k.tag == "code"), c)
                lang = re.search(r"(?:language|lang)-([\w+#.-]+)", code.get("class") + " " + c.get("class"))
                out.append(f"```{lang.group(1) if lang else ''}\n" + "".join(code.texts()).strip("\n") + "\n```")
            elif t in ("ul", "ol"):
                s = items(c, 0)
                if s:
                    out.append(s)
            elif t == "blockquote":
                s = "\n\n".join(blocks(c))
                if s:
                    out.append("\n".join("> " + x if x else ">" for x in s.split("\n")))
            elif t == "table":
                s = table(c)
                if s:
                    out.append(s)
            elif t == "hr":
                out.append("---")
            elif t == "p":
                s = re.sub(r" *\n *", "  \n", re.sub(r"[ \t]+", " ", "".join(map(inline, c.children)))).strip()
                if s:
                    out.append(s)
            else:
                out += blocks(c)
        flush()
        return out

    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(blocks(n))).strip()


def lightweight(root: Node, url: str | None, most: int = 10_000) -> dict:
    """Title, description and links with short anchors: what site discovery needs of a page."""
    m = metadata(root, url)
    return {"title": m["title"], "description": m["description"], "links": [{"url": x["url"], "anchor": x["text"][:512]} for x in links(root, url)[:most]]}


# fixed values: marks of pages that need a browser
_ROOTS = ("root", "app", "__next", "main-content")
_JS_NOTICES = ("please enable javascript", "enable javascript to run", "you need to enable javascript", "javascript is required", "javascript is disabled")
_FRAMEWORKS = {"nextjs": ("__next_data__", "/_next/static/"), "nuxt": ("__nuxt__", "/_nuxt/"), "react": ("data-reactroot", "react-dom"), "vue": ("data-v-app", "vue.runtime"), "angular": ("ng-version", "ng-app"), "svelte": ("svelte-", "__sveltekit")}
_PLACEHOLDERS = ("skeleton", "loading-spinner", "lazy-placeholder", "shimmer")


def render_facts(html: str, main_length: int) -> dict:
    """Counts and signs from which to decide whether a page needs a browser, with their score; browser from 5."""
    root = parse_html(html)
    low = html.lower()
    body = _first(root, "body")
    seen = []
    if body is not None:
        todo: list = [body]
        while todo:
            n = todo.pop()
            if n.__class__ is str:
                seen.append(n)
            elif n.tag not in ("script", "style", "noscript", "template"):
                todo.extend(reversed(n.children))
    text = len(" ".join(seen).strip().encode())
    paragraphs, scripts = sum(n.tag == "p" for n in root.nodes), sum(n.tag == "script" for n in root.nodes)
    empty_root = any(len(" ".join(n.texts()).strip()) < 80 for n in root.nodes if n.get("id") in _ROOTS or "data-reactroot" in n.attrs)
    notice = any(x in low for x in _JS_NOTICES)
    frameworks = sorted(k for k, v in _FRAMEWORKS.items() if any(x in low for x in v))
    placeholder = any(x in low for x in _PLACEHOLDERS)
    s = 3 * (text < 200) + 3 * (text == 0) + 3 * empty_root + 5 * notice + 2 * (scripts >= 5 and text < 500) + 2 * placeholder + 2 * (bool(frameworks) and text < 300)
    s -= 5 * (main_length >= 500) + 4 * (text > 3000) + 3 * (paragraphs >= 4)
    return {"paragraphs": paragraphs, "scripts": scripts, "links": sum(n.tag == "a" and "href" in n.attrs for n in root.nodes), "visible_text": text, "empty_root": empty_root, "js_notice": notice, "frameworks": frameworks, "placeholder": placeholder, "score": s, "browser": s >= 5}
