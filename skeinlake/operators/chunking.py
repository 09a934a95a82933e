"""Structure-aware chunking of Markdown, JSON and page texts, and the blocks and sentences it is made of."""
from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, functions as F

TARGET, MOST, LEAST = 400, 800, 100
_HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)[ \t]*([^\s`]*)")
_ITEM = re.compile(r"[ \t]{0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+")


def tokens(text: str) -> int:
    """``(ceil(chars / 4) + ceil(words * 4 / 3)) div 2``; 0 for empty texts, 1 where there is no word."""
    if not text:
        return 0
    words = len(text.split())
    return ((len(text) + 3) // 4 + (words * 4 + 2) // 3) // 2 if words else 1


def chunk_hash(text: str) -> str:
    return hashlib.sha256(" ".join(text.split()).encode("utf-8", "surrogatepass")).hexdigest()


def blocks(markdown: str) -> list[tuple[str, int, str, str]]:
    """``kind, level, language, text`` of headings, code, tables, lists and paragraphs; an open fence runs to the end."""
    out: list[tuple[str, int, str, str]] = []
    lines = markdown.split("\n")
    i, n = 0, len(lines)
    paragraph: list[str] = []

    def flush():
        if paragraph:
            out.append(("paragraph", 0, "", " ".join(x.strip() for x in paragraph)))
            paragraph.clear()

    while i < n:
        line = lines[i]
        fence, heading = _FENCE.match(line), _HEADING.match(line)
        if fence:
            flush()
            mark, code = fence.group(1), []
            i += 1
            while i < n and not lines[i].lstrip().startswith(mark[:3]):
                code.append(lines[i])
                i += 1
            out.append(("code", 0, fence.group(2), "\n".join(code)))
        elif heading and heading.group(2):
            flush()
            out.append(("heading", len(heading.group(1)), "", heading.group(2).strip()))
        elif line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1:
            flush()
            rows = []
            while i < n and lines[i].strip().startswith("|") and lines[i].strip().endswith("|"):
                rows.append(lines[i].strip())
                i += 1
            out.append(("table", 0, "", "\n".join(rows)))
            continue
        elif _ITEM.match(line):
            flush()
            items = []
            while i < n and (_ITEM.match(lines[i]) or lines[i].startswith("  ") and lines[i].strip()):
                items.append(lines[i].rstrip())
                i += 1
            out.append(("list", 0, "", "\n".join(items)))
            continue
        elif not line.strip():
            flush()
        else:
            paragraph.append(line)
        i += 1
    flush()
    return out


def split_sentences(text: str, target: int = TARGET) -> list[str]:
    """Sentences packed up to a target size; a longer sentence stands alone."""
    out, now, size = [], "", 0
    for s in re.findall(r"[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$", text):
        n = tokens(s)
        if now and size + n > target:
            out.append(now.strip())
            now, size = "", 0
        now += s
        size += n
    if now.strip():
        out.append(now.strip())
    return out or [text]


def split_code(code: str, target: int = TARGET) -> list[str]:
    """Lines of code packed up to a target size."""
    out, now, size = [], [], 0
    for line in code.split("\n"):
        n = tokens(line)
        if now and size + n > target:
            out.append("\n".join(now))
            now, size = [], 0
        now.append(line)
        size += n
    if now:
        out.append("\n".join(now))
    return out


def chunk_markdown(document_id: str, markdown: str | None, target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[dict]:
    """Chunks of a document: headings flush and set the path, oversized paragraphs and code are split, the rest is packed greedily.

    Paragraphs close a chunk at the target once it has the least size; code, tables and lists at the
    most. Null and empty documents have no chunk.
    """
    out: list[dict] = []
    path: list[str] = []
    group: list[tuple[str, str, str]] = []
    size = 0

    def emit(text: str, lang: str | None):
        h = chunk_hash(text)
        out.append({"chunk_id": f"chk_{document_id}_{len(out)}_{h[:8]}", "position": len(out), "heading_path": list(path), "text": text, "token_count": tokens(text), "content_hash": h, "code_lang": lang})

    def flush():
        nonlocal size
        if group:
            shown = [f"```{lang}\n{t}\n```" if kind == "code" else t for kind, lang, t in group]
            emit("\n\n".join(shown), next((lang for kind, lang, _ in group if kind == "code" and lang), None))
            group.clear()
        size = 0

    for kind, level, lang, text in blocks(markdown or ""):
        if kind == "heading":
            flush()
            del path[level - 1 :]
            path.append(text)
            continue
        n = tokens(text)
        if n > most and kind in ("paragraph", "code"):
            flush()
            for piece in split_sentences(text, target) if kind == "paragraph" else split_code(text, target):
                emit(piece, lang or None if kind == "code" else None)
            continue
        if group and (size + n > most if kind != "paragraph" else size + n > target and size >= least):
            flush()
        group.append((kind, lang, text))
        size += n
    flush()
    return out


def chunk_json(document_id: str, text: str | None, target: int = TARGET) -> list[dict]:
    """Array items or object members of a JSON text packed up to a target size, with the path each chunk covers."""
    try:
        v = json.loads(text or "")
    except (ValueError, RecursionError):
        return []
    dump = lambda x: json.dumps(x, ensure_ascii=False, indent=2)
    units = [(f"// Item [{i}]\n{dump(x)}", f"$[{i}]") for i, x in enumerate(v)] if isinstance(v, list) else [(f'"{k}": {dump(x)}', f"$.{k}") for k, x in v.items()] if isinstance(v, dict) else [(dump(v), "$")]
    out: list[dict] = []
    now: list[tuple[str, str]] = []

    def flush():
        if now:
            body = "\n".join(t for t, _ in now)
            h = chunk_hash(body)
            out.append({"chunk_id": f"chk_{document_id}_{len(out)}_{h[:8]}", "position": len(out), "text": body, "token_count": sum(tokens(t) for t, _ in now), "json_path": now[0][1] if len(now) == 1 else f"{now[0][1]}..{now[-1][1]}"})
            now.clear()

    for t, p in units:
        if now and sum(tokens(x) for x, _ in now) + tokens(t) > target:
            flush()
        now.append((t, p))
    flush()
    return out


def context_chunks(markdown: str, json_ld: list | None = None, tables: list[dict] | None = None) -> list[dict]:
    """Chunks from which to extract facts: structured data, tables, sections under headings 1 to 3, paragraphs above 30 bytes."""
    out = [{"content_type": "json", "heading_path": [], "content": json.dumps(x, ensure_ascii=False)} for x in json_ld or []]
    out += [{"content_type": "table", "heading_path": [t.get("name") or "table"], "content": "\n".join([" | ".join(t["headers"])] + [" | ".join(r) for r in t["rows"]])} for t in tables or []]
    head, section = "", []

    def flush():
        body = "\n\n".join(section).strip()
        if body and head:
            out.append({"content_type": "section", "heading_path": [head], "content": body})
        elif body:
            out.extend({"content_type": "paragraph", "heading_path": [], "content": p} for p in section if len(p.encode()) > 30)
        section.clear()

    for kind, level, _, text in blocks(markdown or ""):
        if kind == "heading" and level <= 3:
            flush()
            head = text
        else:
            section.append(text)
    flush()
    return out


CHUNKS = "document_id string, chunk_id string, position int, heading_path array<string>, text string, token_count int, content_hash string, code_lang string"


def chunk_documents(docs: DataFrame, document_id: str, text: str, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Structural chunks of every document, in one pass without a shuffle."""
    from skeinlake.functions.arrow import map_rows

    def one(d, t):
        return [{"document_id": d, **c} for c in chunk_markdown(d, t, target, most, least)]

    return map_rows(docs.select(F.col(document_id).cast("string").alias("document_id"), F.col(text).alias("text")), one, CHUNKS)


def evidence(docs: DataFrame, key: str, text: str, least: int = 40, most: int = 2000) -> DataFrame:
    """``key, position, excerpt, hash``: paragraphs of bounded size, equal ones of all documents once (least key first)."""
    from pyspark.sql import Window

    from skeinlake.functions import text as T

    parts = docs.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("position", "raw"))
    kept = parts.select(key, "position", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("excerpt")).filter(F.octet_length("excerpt").between(least, most)).withColumn("hash", T.chunk_hash(F.col("excerpt")))
    return kept.withColumn("_rn", F.row_number().over(Window.partitionBy("hash").orderBy(key, "position"))).filter("_rn = 1").drop("_rn")
