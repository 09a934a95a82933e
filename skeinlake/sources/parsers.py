"""Parsers of page bodies other than HTML: JSON, XML, feeds, sitemaps, delimited tables, plain text, DOCX.

Each gives a dict of one shape (see ``DOCUMENT``); what cannot be read gives empty values and a
warning. Sizes are guarded before anything is parsed.
"""
from __future__ import annotations

import csv
import gzip
import io
import json
import re
import zipfile
from xml.etree import ElementTree
from xml.parsers import expat

DOCUMENT = "title string, text string, markdown string, json string, tables array<struct<name:string,headers:array<string>,rows:array<array<string>>>>, links array<string>, warnings array<string>"
MAX_JSON, MAX_DEPTH, MAX_ROWS, MAX_COLUMNS = 10_000_000, 64, 100_000, 1_000
MAX_ENTRIES, MAX_UNPACKED, MAX_RATIO = 10_000, 100_000_000, 100
_URL = re.compile(r"https?://[^\s\"'<>\\)\]]+")


def _empty(**some) -> dict:
    return {"title": None, "text": "", "markdown": "", "json": None, "tables": [], "links": [], "warnings": []} | some


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def json_depth(v) -> int:
    """Nesting of a JSON value; scalars have 0."""
    depth, level = 0, [v]
    while True:
        level = [x for y in level if isinstance(y, (dict, list)) for x in (y.values() if isinstance(y, dict) else y)] if any(isinstance(y, (dict, list)) for y in level) else None
        if level is None:
            return depth
        depth += 1


def json_path(value, path: str):
    """Values matched by ``$.a.b[0]``, ``[*]``, ``..name`` and ``[?(@.k==v)]`` paths."""
    steps = re.findall(r"\.\.([\w-]+)|\.([\w-]+|\*)|\[(\d+)\]|\[\*\]|\['([^']*)'\]|\[\?\(@\.([\w-]+)\s*(==|!=|>=|<=|>|<)\s*('[^']*'|\"[^\"]*\"|[-\w.]+)\)\]", path.lstrip("$"))
    now = [value]
    for deep, key, index, quoted, field, op, want in steps:
        out = []
        for v in now:
            if deep:
                todo = [v]
                while todo:
                    x = todo.pop(0)
                    if isinstance(x, dict):
                        out += [x[deep]] if deep in x else []
                        todo += list(x.values())
                    elif isinstance(x, list):
                        todo += x
            elif field:
                try:
                    w = json.loads(want.replace("'", '"'))
                except ValueError:
                    w = want
                for x in v if isinstance(v, list) else []:
                    y = x.get(field) if isinstance(x, dict) else None
                    try:
                        ok = {"==": y == w, "!=": y != w, ">": y is not None and y > w, "<": y is not None and y < w, ">=": y is not None and y >= w, "<=": y is not None and y <= w}[op] if op in ("==", "!=") or isinstance(y, type(w)) or isinstance(y, (int, float)) and isinstance(w, (int, float)) else False
                    except TypeError:
                        ok = False
                    if ok:
                        out.append(x)
            elif index:
                if isinstance(v, list) and int(index) < len(v):
                    out.append(v[int(index)])
            elif (key or quoted) and key != "*":
                if isinstance(v, dict) and (key or quoted) in v:
                    out.append(v[key or quoted])
            else:
                out += list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
        now = out
    return now


def parse_json(text: str, path: str | None = None) -> dict:
    if len(text.encode()) > MAX_JSON:
        return _empty(warnings=["json_too_large"])
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return _empty(text=text, warnings=["invalid_json"])
    if json_depth(v) > MAX_DEPTH:
        return _empty(warnings=["json_too_deep"])
    if path:
        found = json_path(v, path)
        v = found[0] if len(found) == 1 else found

    def outline(x, depth=0) -> list[str]:
        pad = "  " * depth
        if isinstance(x, dict):
            return [line for k, y in x.items() for line in ([f"{pad}- **{k}**: {json.dumps(y, ensure_ascii=False)}"] if not isinstance(y, (dict, list)) else [f"{pad}- **{k}**:", *outline(y, depth + 1)])]
        if isinstance(x, list):
            return [line for y in x for line in ([f"{pad}- {json.dumps(y, ensure_ascii=False)}"] if not isinstance(y, (dict, list)) else [f"{pad}-", *outline(y, depth + 1)])]
        return [pad + json.dumps(x, ensure_ascii=False)]

    canonical = json.dumps(v, ensure_ascii=False)
    title = v.get("title") or v.get("name") if isinstance(v, dict) else None
    return _empty(title=title if isinstance(title, str) else None, text=canonical, markdown="\n".join(outline(v)), json=canonical, links=list(dict.fromkeys(_URL.findall(canonical))))


def parse_xml(text: str) -> dict:
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return _empty(text=text, warnings=["invalid_xml"])
    pieces, links, lines, last = [], [], [], {}
    todo = [(root, 0)]
    while todo:
        n, depth = todo.pop()
        if depth > MAX_DEPTH:
            return _empty(warnings=["xml_too_deep"])
        t = (n.text or "").strip()
        lines.append("  " * depth + f"- {_name(n.tag)}" + (f": {t}" if t else ""))
        if t:
            pieces.append(t)
            last[_name(n.tag)] = t
            links += _URL.findall(t)
        links += [v for k, v in n.attrib.items() if _name(k) in ("href", "src")]
        todo += [(c, depth + 1) for c in reversed(n)]
    return _empty(title=last.get("title"), text=" ".join(pieces), markdown="\n".join(lines), json=json.dumps(last, ensure_ascii=False), links=list(dict.fromkeys(links)))


def parse_feed(text: str) -> dict:
    """RSS and Atom: entries as JSON with title, url, published, author, summary, guid and categories."""
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return _empty(text=text, warnings=["invalid_feed"])
    get = lambda n, *names: next(((c.text or "").strip() for c in n if _name(c.tag) in names and (c.text or "").strip()), None)

    def link(n):
        for c in n:
            if _name(c.tag) == "link":
                if (c.text or "").strip():
                    return c.text.strip()
                if c.get("href") and c.get("rel", "alternate") == "alternate":
                    return c.get("href")
        return None

    def author(n):
        a = next((c for c in n if _name(c.tag) in ("author", "creator")), None)
        return None if a is None else (get(a, "name") or (a.text or "").strip() or None)

    channel = next((c for c in root if _name(c.tag) == "channel"), root)
    entries = [
        {"title": get(e, "title"), "url": link(e), "published": get(e, "pubDate", "published", "updated", "date"), "author": author(e), "summary": get(e, "description", "summary", "content", "encoded"), "guid": get(e, "guid", "id"), "categories": [c.get("term") or (c.text or "").strip() for c in e if _name(c.tag) == "category"]}
        for e in root.iter()
        if _name(e.tag) in ("item", "entry")
    ]
    md = [f"# {get(channel, 'title') or ''}".rstrip(), get(channel, "description", "subtitle") or ""] + [f"## [{e['title'] or ''}]({e['url'] or ''})\n\n{e['summary'] or ''}".rstrip() for e in entries]
    return _empty(title=get(channel, "title"), text="\n".join(f"{e['title'] or ''} {e['summary'] or ''}".strip() for e in entries), markdown="\n\n".join(x for x in md if x), json=json.dumps(entries, ensure_ascii=False), links=[e["url"] for e in entries if e["url"]])


def parse_sitemap(data: bytes | str) -> list[dict]:
    """``kind, loc, lastmod, changefreq, priority`` of a sitemap or an index of sitemaps, gzip or not; entries before an error stay."""
    raw = data.encode() if isinstance(data, str) else data or b""
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.GzipFile(fileobj=io.BytesIO(raw)).read(MAX_UNPACKED)
        except (OSError, EOFError):
            return []
    out: list[dict] = []
    stack: list[str] = []
    now: dict = {}
    buffer: list[str] = []

    def start(tag, _):
        name = tag.rsplit(":", 1)[-1]
        stack.append(name)
        buffer.clear()
        if name in ("url", "sitemap"):
            now.clear()

    def end(tag):
        name = stack.pop()
        value = "".join(buffer).strip()
        if name in ("loc", "lastmod", "changefreq", "priority") and value and "url" in stack + ["url"]:
            if stack and stack[-1] in ("url", "sitemap") or name == "loc" and now.get("loc") is None:
                now[name] = value
        elif name in ("url", "sitemap") and now.get("loc"):
            try:
                priority = float(now["priority"]) if now.get("priority") else None
            except ValueError:
                priority = None
            out.append({"kind": name, "loc": now["loc"], "lastmod": now.get("lastmod"), "changefreq": now.get("changefreq"), "priority": priority})
        buffer.clear()

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, buffer.append
    try:
        p.Parse(raw, True)
    except (expat.ExpatError, IndexError):
        pass
    return out


def sniff_delimiter(line: str) -> str:
    """The delimiter that the first line holds most of; ties give a comma."""
    counts = {d: line.count(d) for d in (",", "\t", ";", "|")}
    top = max(counts.values())
    best = [d for d, n in counts.items() if n == top]
    return best[0] if top and len(best) == 1 else ","


def parse_delimited(text: str, delimiter: str | None = None) -> dict:
    lines = text.lstrip("﻿").splitlines()
    if not lines:
        return _empty(warnings=["empty_table"])
    d = delimiter or sniff_delimiter(lines[0])
    try:
        rows = [[c.strip() for c in r[:MAX_COLUMNS]] for _, r in zip(range(MAX_ROWS + 1), csv.reader(io.StringIO("\n".join(lines)), delimiter=d)) if any(c.strip() for c in r)]
    except csv.Error:
        return _empty(text=text, warnings=["invalid_table"])
    head, body = rows[0], rows[1:]
    records = [{h: (r[i] if i < len(r) else "") for i, h in enumerate(head)} for r in body]
    md = ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"] + ["| " + " | ".join((r + [""] * len(head))[: len(head)]) + " |" for r in body[:100]]
    return _empty(text=text, markdown="\n".join(md), json=json.dumps(records, ensure_ascii=False), tables=[{"name": "table", "headers": head, "rows": body}])


def parse_text(text: str, is_markdown: bool = False) -> dict:
    t = text.replace("\r\n", "\n")
    return _empty(text=t, markdown=t if is_markdown else f"```text\n{t}\n```", links=list(dict.fromkeys(w.strip(".,;:!?)]}\"'") for w in t.split() if w.startswith(("http://", "https://")))))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def parse_docx(data: bytes) -> dict:
    """Headings 1 to 3, emphasis, links and tables of a DOCX file, guarded against archives made to explode."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        infos = z.infolist()
        if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_UNPACKED or any(i.file_size > MAX_RATIO * max(1, i.compress_size) for i in infos) or any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in infos):
            return _empty(warnings=["unsafe_archive"])
        document = ElementTree.fromstring(z.read("word/document.xml"))
        names = set(z.namelist())
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))} if "word/_rels/document.xml.rels" in names else {}
        title = next((e.text for e in ElementTree.fromstring(z.read("docProps/core.xml")) if _name(e.tag) == "title" and e.text), None) if "docProps/core.xml" in names else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError):
        return _empty(warnings=["invalid_docx"])
    links, tables, out, plain = [], [], [], []

    def runs(p) -> str:
        s = ""
        for c in p:
            if c.tag == f"{_W}hyperlink":
                target = rels.get(c.get(f"{_R}id"))
                t = "".join(x.text or "" for x in c.iter(f"{_W}t"))
                if target:
                    links.append(target)
                s += f"[{t}]({target})" if target else t
            elif c.tag == f"{_W}r":
                t = "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in c)
                style = c.find(f"{_W}rPr")
                on = lambda k, style=style: style is not None and (e := style.find(_W + k)) is not None and e.get(f"{_W}val") not in ("0", "false")
                if t.strip():
                    t = f"**{t}**" if on("b") else t
                    t = f"*{t}*" if on("i") else t
                s += t
        return s

    body = document.find(f"{_W}body")
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            s = runs(e).strip()
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"[Hh]eading\s*([1-3])", style.get(f"{_W}val") or "") if style is not None else None
            if s:
                out.append("#" * int(m.group(1)) + " " + s if m else s)
                plain.append("".join(x.text or "" for x in e.iter(f"{_W}t")))
        elif e.tag == f"{_W}tbl":
            rows = [[" ".join("".join(x.text or "" for x in p.iter(f"{_W}t")) for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if rows:
                tables.append({"name": f"table_{len(tables) + 1}", "headers": rows[0], "rows": rows[1:]})
                out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |"] + ["| " + " | ".join(r) + " |" for r in rows[1:]]))
    return _empty(title=title, text="\n".join(plain), markdown="\n\n".join(out), tables=tables, links=list(dict.fromkeys(links)))


def parse_pdf_pages(pages: list[str]) -> dict:
    """A document from page texts that some PDF reader gave; almost no text hints at scanned pages."""
    text = "\n\n".join(pages)
    return _empty(text=text, markdown="\n\n".join(f"## Page {i}\n\n{p.strip()}" for i, p in enumerate(pages, 1)), warnings=["scanned_pdf"] if len(text.strip()) < 50 else [])


def parse(kind: str, body: bytes | str) -> dict:
    """A body by its document type; HTML is read through the tree, PDF needs a reader and gives a warning."""
    from skeinlake.sources.detect import decode

    if kind == "docx":
        return parse_docx(body if isinstance(body, bytes) else body.encode("latin-1", "replace"))
    text = decode(body)[0] if isinstance(body, bytes) else body or ""
    if kind == "json":
        return parse_json(text)
    if kind == "xml":
        return parse_xml(text)
    if kind in ("rss", "atom"):
        return parse_feed(text)
    if kind in ("csv", "tsv"):
        return parse_delimited(text, "\t" if kind == "tsv" else None)
    if kind == "html":
        from skeinlake.html import extract, parse_html

        root = parse_html(text)
        node, warnings = extract.main_content(root)
        meta = extract.metadata(root)
        return _empty(title=meta["title"], text=" ".join(node.text(" ").split()), markdown=extract.markdown(node), links=[x["url"] for x in extract.links(root)], warnings=warnings)
    if kind == "pdf":
        return _empty(warnings=["no_pdf_reader"])
    return parse_text(text)
