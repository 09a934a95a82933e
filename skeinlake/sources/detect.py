"""Content type of a body by its first bytes, the header, the address and, last, whether it is printable."""
from __future__ import annotations

import json
import re

# fixed values: media types and extensions of document types
DEFAULT_MIME = {
    "html": "text/html", "json": "application/json", "xml": "application/xml", "rss": "application/rss+xml", "atom": "application/atom+xml", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "plain_text": "text/plain", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "unknown": "application/octet-stream",
}
MIME_TYPES = {v: k for k, v in DEFAULT_MIME.items() if k != "unknown"} | {
    "application/ld+json": "json", "text/json": "json", "text/xml": "xml", "application/rss": "rss", "application/atom": "atom", "application/csv": "csv", "text/tsv": "tsv",
    "text/markdown": "plain_text", "text/x-markdown": "plain_text", "application/xhtml+xml": "html",
}
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "json": "json", "jsonld": "json", "xml": "xml", "rss": "rss", "atom": "atom", "csv": "csv", "tsv": "tsv", "txt": "plain_text", "text": "plain_text", "md": "plain_text", "markdown": "plain_text", "html": "html", "htm": "html", "xhtml": "html"}
PREFIX = 8192
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


def extension_of(url: str | None) -> str | None:
    if not url:
        return None
    m = re.search(r"\.([A-Za-z0-9]{1,8})$", re.sub(r"[?#].*$", "", url))
    return m.group(1).lower() if m and "/" in url else None


def header_parts(header: str | None) -> tuple[str | None, str | None]:
    """Media type and charset of a Content-Type header, in lower case."""
    if not header or not header.strip():
        return None, None
    mime, *rest = [p.strip() for p in header.split(";")]
    charset = next((p.split("=", 1)[1].strip(" \"'").lower() for p in rest if p.lower().startswith("charset=")), None)
    return mime.lower() or None, charset or None


def _delimited(text: str, ext: str | None) -> str | None:
    lines = [x for x in text.splitlines()[:10] if x.strip()]
    if len(lines) < 2:
        return None
    for mark, kind in (("\t", "tsv"), (",", "csv"), (";", "csv"), ("|", "csv")):
        counts = {x.count(mark) for x in lines}
        if len(counts) == 1 and counts.pop() > 0 and (ext in ("csv", "tsv", None) or kind == "tsv"):
            return kind
    return None


def detect(url: str | None, content_type: str | None, body: bytes | str | None) -> dict:
    """``document_type, mime, charset, confidence, reason``; null and empty bodies are told by header and address."""
    data = body.encode("utf-8", "surrogatepass") if isinstance(body, str) else (body or b"")
    mime, charset = header_parts(content_type)
    ext = extension_of(url)

    def result(kind, confidence, reason, own=None):
        return {"document_type": kind, "mime": own or mime or DEFAULT_MIME[kind], "charset": charset, "confidence": confidence, "reason": reason}

    if b"%PDF-" in data[:1024]:
        return result("pdf", 1.0, "magic_pdf", DEFAULT_MIME["pdf"])
    if data[:4] == b"PK\x03\x04" and (b"word/" in data or ext == "docx" or mime == DEFAULT_MIME["docx"]):
        return result("docx", 0.95, "magic_docx", DEFAULT_MIME["docx"])
    for bom, name in BOMS:
        if data.startswith(bom):
            data, charset = data[len(bom) :], charset or name
            break
    head = data[:PREFIX]
    text = head.decode("utf-8", "replace").lstrip()
    low = text.lower()
    if text[:1] in ("{", "["):
        try:
            json.loads(data.decode("utf-8", "replace"))
            return result("json", 0.95, "body_json")
        except (ValueError, RecursionError):
            pass
    if "<rss" in low or "<rdf:rdf" in low:
        return result("rss", 0.95, "body_rss")
    if "<feed" in low and "http://www.w3.org/2005/atom" in low:
        return result("atom", 0.95, "body_atom")
    if low.startswith(("<!doctype html", "<html")) or re.search(r"<(?:html|head|body)[\s>]", low):
        return result("html", 0.95, "body_html")
    if low.startswith("<?xml"):
        return result("xml", 0.9, "body_xml_declaration")
    kind = _delimited(text, ext)
    if kind:
        return result(kind, 0.85, "body_delimited_table")
    if mime:
        kind = MIME_TYPES.get(mime) or ("json" if mime.endswith("+json") else "xml" if mime.endswith("+xml") else None)
        if kind:
            return result(kind, 0.8, "header_content_type")
    if ext in EXTENSIONS:
        return result(EXTENSIONS[ext], 0.7, "url_extension")
    odd = sum(c < 32 and c not in (9, 10, 12, 13) for c in head)
    if odd * 20 < max(1, len(head)):
        return result("plain_text", 0.5, "text_heuristics_fallback")
    return result("unknown", 0.3, "unknown_binary")


def decode(body: bytes, content_type: str | None = None) -> tuple[str, list[str]]:
    """Text of a body by header charset, byte-order mark, UTF-8, else Windows-1252 with a warning."""
    _, charset = header_parts(content_type)
    for bom, name in BOMS:
        if body.startswith(bom):
            return body[len(bom) :].decode(name, "replace"), []
    for name in (charset, "utf-8"):
        if name:
            try:
                return body.decode(name), []
            except (LookupError, UnicodeDecodeError):
                pass
    return body.decode("windows-1252", "replace"), ["charset_fallback"]
