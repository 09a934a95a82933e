"""Problem 2: lines repeated across one site's documents.

Method: content-defined chunking with a rolling hash. The letters of a whole text are one stream, line
breaks aside; a chunk ends where the hash of the last ``WINDOW`` letters has ``CUT_BITS`` zero bits, so
equal passages give equal chunks wherever they stand and however they are broken into lines. Distinct
documents are counted per chunk and site; a chunk in at least ``MIN_DOCUMENTS`` documents of its site is
excessive. Excessive chunks are mapped back to lines: a line whose chunk is excessive is cut, once an
exact check has counted the documents that have its very letters. Of several own chunks the
longest speaks for its line, which keeps the way back at one row a line; the counts are over all.

A line's own chunks are those that begin at least ``WINDOW`` letters into it and end in it at a cut: no
letter outside the line decides them, so the same line has the same own chunks in every text and none
is lost. Lines too short for a chunk of their own go to the exact check directly; chunks that straddle
lines lie in no line and are not counted. The exact check compares 128-bit digests of the letters.

Defined results: rows without ``source_url`` and null texts give no case; lines without letters
(category L of Unicode) never count; a fence opens with a line that starts with three backticks and runs
to the next such line, or to the end of the text where there is none; a document counts once per site
however often it repeats a line, and rows with a null document count as one document; repeated rows of
one chunk give the same cases once; extra columns are never read.
"""
from __future__ import annotations

import re
import sys

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm.common import map_arrow, salted_join, written

#: Letters that decide a cut, a power of two, and zero bits of a cut.
WINDOW, CUT_BITS = 4, 4
MIN_DOCUMENTS = 4
#: Rows whose letters are hashed in one go.
ROWS = 400
_NOT_LETTERS = re.compile(r"[^\w\n]+|[\d_]+")
_numerals = None
_HOST = re.compile(r"(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", re.I)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _without_numerals(text: str) -> str:
    """Drops the numerals that count as word characters but are neither digits nor letters, such as ``½`` and ``①``."""
    global _numerals
    if _numerals is None:
        _numerals = dict.fromkeys(i for i in range(0xB2, sys.maxunicode + 1) if chr(i).isalnum() and not chr(i).isalpha())
    return text.translate(_numerals)


def site_of(url: str | None) -> str | None:
    """Host in lower case without a leading ``www.``; null for nulls and addresses without a host."""
    if url is None:
        return None
    url = url.strip()
    m = _HOST.match(url)
    host = m.group(1) if m else re.split(r"[/?#:]", url, maxsplit=1)[0]
    host = host.lower()
    return (host[4:] if host.startswith("www.") else host) or None


def line_letters(text: str) -> list[str]:
    """The letters of each line in lower case; empty for lines in and around fences."""
    letters = _NOT_LETTERS.sub("", text.lower())
    lines = (letters if letters.isascii() else _without_numerals(letters)).split("\n")
    if "```" in text:
        fenced = False
        for i, raw in enumerate(text.split("\n")):
            mark = raw.startswith("```")
            if mark or fenced:
                lines[i] = ""
            if mark:
                fenced = not fenced
    return lines


def own_chunks(lines: list[str], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chunks that lie in one line by its own letters, longest first, and how many each line has.

    ``texts`` numbers the text of each line, in ascending order; the lines of one text are one stream
    of letters, and its rolling hash runs across line breaks.
    """
    size = np.array([len(x) for x in lines], dtype=np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points)
    with np.errstate(over="ignore"):
        value = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0x94D049BB133111EB)
        value ^= value >> np.uint64(32)
        # rolling hash of the last WINDOW letters, by doubling
        roll, width = value.astype(np.uint32), 1
        while width < WINDOW:
            shifted = np.zeros_like(roll)
            shifted[width:] = roll[:-width] if n > width else 0
            roll = roll + shifted * np.uint32(pow(0x01000193, width, 1 << 32))
            width *= 2
        begin_of_line = np.cumsum(size) - size
        first = np.flatnonzero(np.diff(texts, prepend=texts[:1] - 1)) if len(texts) else np.zeros(0, np.int64)
        begin_of_text = np.repeat(begin_of_line[first], np.diff(np.append(begin_of_line[first], n)))
        at = np.arange(n)
        stop = np.flatnonzero(((roll * np.uint32(0x9E3779B1)) >> np.uint32(32 - CUT_BITS) == 0) & (at - begin_of_text >= WINDOW - 1)) + 1
        line = np.repeat(np.arange(len(lines)), size)
        begin, end = stop[:-1], stop[1:]
        owner = line[end - 1]
        own = begin >= begin_of_line[owner] + WINDOW  # the cut before it and the chunk itself stand in the line that holds its end
        begin, end, owner = begin[own], end[own], owner[own]
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _P)]))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(value * power[:n], dtype=np.uint64)])
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _P_INVERSE)]))
        h = (prefix[end] - prefix[begin]) * inverse[begin]
        h ^= (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    order = np.lexsort((h, begin - end, owner))
    return h[order].view(np.int64), np.bincount(owner, minlength=len(lines))


def _hash(*parts: str) -> int:
    h = xxhash.xxh3_64_intdigest("\x00".join(parts))
    return h - (1 << 64) if h >> 63 else h


LINES = "chunk_id string, line_no int, document long, line long, line2 long, pieces array<long>"


def site_chunks(vectors: DataFrame) -> DataFrame:
    """One row per line with letters outside fences: its place, document, digest, and own chunks; digest and chunks are mixed with the site."""

    def rows(b):
        out = {k.split()[0]: [] for k in LINES.split(", ")}
        columns = [c.to_pylist() for c in b.columns]
        for first in range(0, b.num_rows, ROWS):
            letters, texts, sites, digests = [], [], [], []
            for no, (chunk, doc, url, text) in enumerate(zip(*[c[first : first + ROWS] for c in columns])):
                site = site_of(url) if text else None
                if site is None:
                    continue
                s, d, salt = _hash(site), _hash(doc or "", "d"), site + "\n"
                for line_no, x in enumerate(line_letters(text), 1):
                    if x:
                        letters.append(x)
                        texts.append(no)
                        sites.append(s)
                        digests.append(xxhash.xxh3_128_digest((salt + x).encode("utf-8", "surrogatepass")))
                        out["chunk_id"].append(chunk)
                        out["line_no"].append(line_no)
                        out["document"].append(d)
            if not letters:
                continue
            chunks, n = own_chunks(letters, np.array(texts, dtype=np.int64))
            with np.errstate(over="ignore"):
                chunks = (chunks ^ np.repeat(np.array(sites, dtype=np.int64), n)) * np.int64(-7046029254386353131)
            ends = np.cumsum(n).tolist()
            chunks = chunks.tolist()
            out["pieces"] += [chunks[a:e] for a, e in zip([0, *ends], ends)]
            keys = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            out["line"] += keys[:, 0].tolist()
            out["line2"] += keys[:, 1].tolist()
        return out

    return map_arrow(vectors.select("chunk_id", "document_id", "source_url", "text").filter(F.col("source_url").isNotNull() & F.col("text").isNotNull()), rows, LINES)


def excessive_chunks(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``piece`` of the chunks that stand in at least ``min_documents`` documents of their site, from rows of ``site_chunks``."""
    # the chunk hashes carry the site, so a chunk of a hot site is as spread as any other
    pieces = lines.select(F.explode("pieces").alias("piece"), "document").distinct()
    return pieces.groupBy("piece").count().filter(F.col("count") >= min_documents).select("piece")


def repeated_lines(vectors: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``chunk_id, line_no`` of the lines that stand in at least ``min_documents`` documents of their site."""
    lines = written(site_chunks(vectors))
    return lines_of_chunks(lines, excessive_chunks(lines, min_documents), min_documents)


def lines_of_chunks(lines: DataFrame, excessive: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``chunk_id, line_no``: the lines whose chunk is excessive, or that hold none of their own, checked exactly."""
    key = ["line", "line2"]
    once = lines.select(*key, "document", F.get("pieces", F.lit(0)).alias("piece")).dropDuplicates([*key, "document"])
    short = once.filter(F.col("piece").isNull()).select(*key, "document")
    cut = salted_join(once.filter(F.col("piece").isNotNull()), excessive, "piece").select(*key, "document")
    exact = cut.unionByName(short).groupBy(*key).count().filter(F.col("count") >= min_documents).select(F.struct(*key).alias("key"))
    return salted_join(lines.select("chunk_id", "line_no", F.struct(*key).alias("key")), exact, "key").select("chunk_id", "line_no").distinct()


def without_repeated_lines(vectors: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``chunk_id, text``: each text without the lines that its site repeats."""
    cut = repeated_lines(vectors, min_documents).groupBy("chunk_id").agg(F.collect_set("line_no").alias("cut"))
    texts = vectors.select("chunk_id", "text").dropDuplicates(["chunk_id"])
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("cut", i + 1)), "\n")
    return texts.join(cut, "chunk_id", "left").select("chunk_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"))
