"""Text functions as column expressions: tokens, sizes, hashes, fingerprints, snippets, relevance.

Nulls give nulls, empty texts give empty arrays or zero, unless a docstring says otherwise.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: words that carry no relevance in link ranking and in query expansion
RANK_STOPWORDS = "the to in of on at by an as is it or and for that this with from are was com org net html php http https www".split()
FILE_EXTENSIONS = "html htm php asp aspx jsp pdf json".split()
QUESTION_WORDS = "how what where when why do does i can the a is".split()
SPACE = r"[\s\p{Z}]+"


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def approx_tokens(text: Column) -> Column:
    """``(ceil(chars / 4) + ceil(words * 4 / 3)) div 2``; 0 for empty texts, 1 where there is no word."""
    n = word_count(text)
    size = F.floor((F.ceil(F.char_length(text) / 4) + F.ceil(n * 4 / 3)) / 2)
    return F.when(text == "", F.lit(0)).when(n == 0, F.lit(1)).otherwise(size).cast("long")


def word_tokens(text: Column) -> Column:
    """Words plus a third of the ASCII punctuation signs."""
    return (word_count(text) + F.floor(F.char_length(F.regexp_replace(text, r"[^!-/:-@\[-`{-~]", "")) / 3)).cast("long")


def index_tokens(text: Column) -> Column:
    """Search tokens: compounds of letters, digits, ``_ - .`` in lower case, each followed by its parts of more than one byte."""
    raw = F.transform(F.split(text, r"[^\p{L}\p{N}_.\-]+"), lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    kept = F.filter(raw, lambda t: t != "")

    def with_parts(t):
        parts = F.filter(F.split(t, r"[_.\-]"), lambda p: F.octet_length(p) > 1)
        return F.when(t.rlike(r"[_.\-]"), F.concat(F.array(t), parts)).otherwise(F.array(t))

    return F.flatten(F.transform(kept, with_parts))


def token_count(text: Column) -> Column:
    """Number of ``index_tokens`` without building them; only compounds are taken apart. Nulls count 0."""
    sign, inner = r"[\p{L}\p{N}]", r"[\p{L}\p{N}_.\-]*"
    plain = F.regexp_count(text, F.lit(f"{inner}{sign}{inner}"))
    compounds = F.regexp_extract_all(text, F.lit(rf"({sign}{inner}[_.\-]{inner}{sign})"), F.lit(1))
    parts = F.aggregate(compounds, F.lit(0), lambda n, t: n + F.size(F.filter(F.split(t, r"[_.\-]"), lambda p: F.octet_length(p) > 1)))
    return F.coalesce(plain + F.when(text.rlike(r"[_.\-]"), parts).otherwise(F.lit(0)), F.lit(0))


def rank_tokens(text: Column) -> Column:
    """Tokens of a link's title or of a query: letters and digits, at least two bytes, no stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*RANK_STOPWORDS))


def path_tokens(path: Column) -> Column:
    """Tokens of a URL path without file extensions."""
    return F.filter(F.split(F.lower(path), r"[/\-_.]"), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*RANK_STOPWORDS) & ~w.isin(*FILE_EXTENSIONS))


def collapse(text: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), SPACE, " ")


def chunk_hash(text: Column) -> Column:
    """SHA-256 of the collapsed text: equal for texts that differ in white space alone."""
    return F.sha2(collapse(text), 256)


def page_hash(text: Column) -> Column:
    """SHA-256 of the trimmed lines that are not blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")
    return F.sha2(F.array_join(lines, "\n"), 256)


def fold(text: Column) -> Column:
    """Lower case of one character for each, whatever stands around it."""
    return F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))


def simhash(docs: DataFrame, key: str, text: str, bits: int = 60) -> DataFrame:
    """``key, fingerprint`` from words (weight 2) and adjacent word pairs (weight 1); similar texts differ in few bits.

    Texts without words have fingerprint 0, nulls have no row. A feature's hash is the first 60 bits of
    its SHA-256. The votes of all features of an Arrow batch are summed as one matrix: in column
    expressions 60 sums a feature outgrow what the JVM compiles.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    source = docs.filter(F.col(text).isNotNull()).select(key, words(fold(F.col(text))).alias("w"))
    kind = dict(source.dtypes)[key]

    def run(batches):
        place = np.arange(bits, dtype=np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                hashes, weights, ends, seen = [], [], [], {}
                for ws in part.column(1).to_pylist():
                    for feature, weight in (*((w, 2) for w in ws), *((f"{x} {y}", 1) for x, y in zip(ws, ws[1:]))):
                        h = seen.get(feature)
                        if h is None:
                            h = seen[feature] = int.from_bytes(hashlib.sha256(feature.encode("utf-8", "surrogatepass")).digest()[:8], "big") >> 4
                        hashes.append(h)
                        weights.append(weight)
                    ends.append(len(hashes))
                votes = np.zeros((len(ends) + 1, bits), dtype=np.int64)
                doc = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
                h, w = np.array(hashes, dtype=np.int64), np.array(weights, dtype=np.int64)
                for i in place:
                    votes[:-1, i] = np.bincount(doc, weights=np.where(h >> i & 1, w, -w), minlength=len(ends)) if len(h) else 0
                prints = ((votes[:-1] > 0).astype(np.int64) << place).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], names=[key, "fingerprint"])

    return source.mapInArrow(run, f"{key} {kind}, fingerprint long")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def sanitize(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, marked where cut, with closing prompt tags made harmless."""
    cut = F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("... [truncated]"))).otherwise(text)
    for tag in ("untrusted_content", "system", "instructions"):
        cut = F.replace(cut, F.lit(f"</{tag}>"), F.lit(f"&lt;/{tag}&gt;"))
    return cut


def snippet(text: Column, tokens: list[str]) -> Column:
    """Text around the first query token that occurs, 40 characters before and 80 behind; else the first 150."""
    low = F.lower(text)
    at = F.lit(0)
    for t in reversed(tokens):
        at = F.when(F.instr(low, t.lower()) > 0, F.instr(low, t.lower())).otherwise(at)
    start = F.greatest(at - 40, F.lit(1))
    end = F.least(at + 80, F.char_length(text) + 1)
    window = F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.substring(text, start, end - start), F.when(end <= F.char_length(text), F.lit("...")).otherwise(F.lit("")))
    head = F.when(F.char_length(text) > 150, F.concat(F.substring(text, 1, 150), F.lit("..."))).otherwise(text)
    return F.when(at > 0, window).otherwise(head)


def link_score(query: list[str], title: Column, url_path: Column, description: Column) -> Column:
    """Relevance of a link to query tokens, .01 to .99: title, then path, then description, exact before partial."""
    if not query:
        return F.lit(0.5)
    none = F.array().cast("array<string>")
    facts = F.struct(F.coalesce(rank_tokens(title), none).alias("t"), F.coalesce(path_tokens(url_path), none).alias("p"), F.coalesce(rank_tokens(description), none).alias("d"))

    def score(x):
        total = F.lit(0.0)
        for q in query:
            w = F.lit(q)
            total = total + F.when(F.array_contains(x["t"], w), 4.0).when(F.exists(x["t"], _either(q)), 2.0).otherwise(0.0)
            total = total + F.when(F.array_contains(x["p"], w), 2.5).when(F.exists(x["p"], _holds(q)), 1.2).otherwise(0.0)
            total = total + F.when(F.array_contains(x["d"], w), 1.0).when(F.exists(x["d"], _holds(q)), 0.5).otherwise(0.0)
        return total

    total = F.element_at(F.transform(F.array(facts), score), 1)
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), total / (7.5 * len(query)))), 2)


def _holds(q: str):
    return lambda v: F.contains(v, F.lit(q))


def _either(q: str):
    return lambda v: F.contains(v, F.lit(q)) | F.contains(F.lit(q), v)


def expand_query(query: str, most: int = 3) -> list[str]:
    """The query, and for more than three words its form without question words."""
    parts = query.split()
    out = [query]
    if len(parts) > 3:
        kept = [w for w in parts if w.lower() not in QUESTION_WORDS]
        if kept and len(kept) != len(parts):
            out.append(" ".join(kept))
    return out[: 1 + most]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length, null where dimensions differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def parse_scalar(text: Column) -> Column:
    """Kind of a raw value: ``integer``, ``number``, ``boolean``, ``null`` or ``string``."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        F.when(text.isNull() | (F.lower(t) == "null"), F.lit("null"))
        .when(t.rlike(r"^[+-]?\d{1,18}$"), F.lit("integer"))
        .when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.lit("number"))
        .when(F.lower(t).isin("true", "false"), F.lit("boolean"))
        .otherwise(F.lit("string"))
    )
