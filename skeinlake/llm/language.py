"""Problem 10: missing or wrong document language labels.

Method: prediction by partial matching. One variable-order byte context tree per language (orders
0 to ``ORDER``, escape method C, no exclusion) is fitted on a bounded sample of labelled documents
and frozen. The exact code length of a paragraph under each tree decides its language. The trees
are flattened into one table per order - n-gram to its cost in every language, escapes already
added - so that a paragraph costs one lookup a byte for all languages together.

Fitting is the only place with a bound: at most about ``SAMPLE`` documents a language, chosen by hash, of
each at most ``PARAGRAPHS`` counted paragraphs, spread evenly over it, of each at most ``PARAGRAPH_BYTES``.
Only labels of two letters name a language to be fitted, as results are two-letter codes; others, such
as ``eng``, are never trained on and never match, so their documents are cases.
Since labels may be wrong, the sample is scored by its first fit, paragraphs move to the language
that codes them shortest, and the trees are fitted again.

A language written in another script than Latin is considered only where at least ``SCRIPT_SHARE``
of the letters are of its script, and the language that codes a whole document shortest has an
advantage of ``PRIOR`` bits in each of its paragraphs, which decides headings of a few words.

Defined results: null, empty and blank texts, and texts without a paragraph of ``MIN_LETTERS``
letters, have no segments; fenced code is left out; equal code lengths give the language that comes
first by name; repeated rows of one document count once in ``mislabelled``.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from skeinlake.llm.common import map_arrow
from skeinlake.llm.hashing import HashIndex

ORDER = 4
SAMPLE = 240
PARAGRAPHS, PARAGRAPH_BYTES = 8, 4096
#: Labels with fewer sampled documents make no language.
MIN_DOCUMENTS = 3
MIN_LETTERS = 40
#: Bytes scored at once.
BLOCK = 1 << 20
#: Bits of code length that halve the doubt about a segment.
DOUBT = 8.0
SCRIPT_SHARE = 0.1
PRIOR = 12.0
# fixed values: labels that name no language
NO_LANGUAGE = ("", "und", "unknown")

_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_FENCE = re.compile(r"^```[^\n]*\n(?:.*?\n)??```[^\n]*$|^```.*\Z", re.M | re.S)
_SCRIPTS = {
    "cyrillic": re.compile("[\u0400-\u052f]+"), "han": re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+"), "greek": re.compile("[\u0370-\u03ff]+"),
    "arabic": re.compile("[\u0600-\u06ff]+"), "hebrew": re.compile("[\u0590-\u05ff]+"), "hangul": re.compile("[\uac00-\ud7af]+"), "thai": re.compile("[\u0e00-\u0e7f]+"), "indic": re.compile("[\u0900-\u0dff]+"),
}
_OTHER = re.compile(r"[\W\d_]+")


def label(col: Column) -> Column:
    """The primary subtag of a language label, lower case; null where it names no language."""
    x = F.lower(F.trim(F.regexp_replace(col, "[-_].*$", "")))
    return F.when(x.isin(*NO_LANGUAGE), F.lit(None)).otherwise(x)


def paragraphs(text: str | None) -> list[tuple[int, int, bytes, int]]:
    """Start, end, folded bytes and letters of each counted paragraph."""
    if not text or len(text) < MIN_LETTERS:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text:
        text = _FENCE.sub(lambda m: "\n" * 2 + " " * max(0, len(m.group(0)) - 4) + "\n" * 2, text)
    out, start = [], 0
    for m in (*_PARAGRAPH.finditer(text), None):
        end = m.start() if m else len(text)
        if end - start >= MIN_LETTERS:
            folded = _OTHER.sub(" ", text[start:end].lower()).strip()
            letters = len(folded) - folded.count(" ")
            if letters >= MIN_LETTERS:
                out.append((start, end, folded.encode("utf-8", "surrogatepass"), letters))
        start = m.end() if m else end
    return out


def scripts(folded: bytes) -> dict[str, float]:
    """Share of the letters in each script other than Latin; none for plain ASCII and Latin text."""
    if max(folded, default=0) < 0xCD:  # no lead byte beyond Latin
        return {}
    text = folded.decode("utf-8", "replace")
    n = len(text) - text.count(" ") or 1
    return {k: x / n for k, p in _SCRIPTS.items() if (x := sum(map(len, p.findall(text))))}


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Keys of the k-grams that end at each position from k - 1 on; the first byte of the key is 1, so lengths differ."""
    n = len(data) - k + 1
    key = np.ones(n, dtype=np.uint64)
    for i in range(k):
        key = (key << np.uint64(8)) | data[i : i + n].astype(np.uint64)
    return key


class LanguageModel:
    """Frozen trees of all languages: per order an index of n-grams with costs, and of contexts with escape costs."""

    def __init__(self, samples: dict[str, bytes], order: int = ORDER):
        self.languages = sorted(samples)
        self.order = order
        n = len(self.languages)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        data = [np.frombuffer(b"    " + samples[x], dtype=np.uint8) for x in self.languages]
        below_keys, below = None, None
        for k in range(order + 1):
            seen = [np.unique(_grams(d, k + 1)[order - k :], return_counts=True) for d in data]
            keys = np.unique(np.concatenate([s[0] for s in seen]))
            contexts = np.unique((keys >> np.uint64(8)))
            cost, escape = np.zeros((len(keys), n)), np.zeros((len(contexts), n))
            if k == 0:
                lower = np.full((len(keys), n), 8.0)
            else:
                mask = np.uint64((1 << (8 * k)) - 1)
                suffix = (keys & mask) | np.uint64(1 << (8 * k))
                at = np.searchsorted(below_keys, suffix)
                lower = below[np.minimum(at, len(below_keys) - 1)]
            for j, (g, c) in enumerate(seen):
                ctx, start = np.unique(g >> np.uint64(8), return_index=True)
                total = np.add.reduceat(c, start)
                distinct = np.diff(np.append(start, len(g)))
                e = np.log2((total + distinct) / distinct)
                escape[np.searchsorted(contexts, ctx), j] = e
                cost[:, j] = lower[:, j] + escape[np.searchsorted(contexts, keys >> np.uint64(8)), j]
                inside = np.searchsorted(ctx, g >> np.uint64(8))
                cost[np.searchsorted(keys, g), j] = np.log2((total + distinct)[inside] / c)
            self.grams.append((keys, cost.astype(np.float32)))
            self.escapes.append((contexts, escape.astype(np.float32)))
            below_keys, below = keys, cost
        self._index = None
        self.scripts = []
        for x in self.languages:
            share = scripts(samples[x])
            top = max(share, key=share.get, default="")
            self.scripts.append(top if top and share[top] > 0.4 else "")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"} | {"_index": None}

    def index(self):
        if self._index is None:
            self._index = [(HashIndex(g[0]), HashIndex(e[0])) for g, e in zip(self.grams, self.escapes)]
        return self._index

    def _costs(self, data: np.ndarray) -> np.ndarray:
        """Code length of each byte from position ``order`` on, by language."""
        index = self.index()
        k = self.order
        keys = _grams(data, k + 1)
        at = index[k][0].find(keys)
        out = self.grams[k][1][at]
        todo = np.flatnonzero(at < 0)
        if len(todo):
            out[todo] = 0
        while len(todo):
            context = index[k][1].find(keys[todo] >> np.uint64(8))
            known = context >= 0
            out[todo[known]] += self.escapes[k][1][context[known]]
            if k == 0:
                out[todo] += 8.0
                break
            k -= 1
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            keys[todo] = (keys[todo] & mask) | np.uint64(1 << (8 * (k + 1)))
            at = index[k][0].find(keys[todo])
            hit = at >= 0
            out[todo[hit]] += self.grams[k][1][at[hit]]
            todo = todo[~hit]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length in bits of each text by language."""
        n = len(self.languages)
        out = np.zeros((len(texts), n))
        if not texts:
            return out
        pad = b" " * self.order
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                size += len(texts[j])
                j += 1
            if j == i + 1 and size > BLOCK:  # one very long text, in pieces that overlap by the context
                t = pad + texts[i]
                for s in range(0, len(t) - self.order, BLOCK):
                    out[i] += self._costs(np.frombuffer(t[s : s + BLOCK + self.order], dtype=np.uint8)).sum(axis=0, dtype=np.float64)
            else:
                data = np.frombuffer(pad + pad.join(texts[i:j]), dtype=np.uint8)
                costs = self._costs(data)
                length = np.array([len(t) for t in texts[i:j]])
                start = np.concatenate([[0], np.cumsum(length[:-1] + self.order)])
                bounds = np.stack([start, start + length], axis=1).ravel()
                costs = np.concatenate([costs, np.zeros((1, n), dtype=np.float32)])
                out[i:j] = np.add.reduceat(costs, bounds, axis=0, dtype=np.float64)[::2] if length.min() > 0 else np.array([costs[a:b].sum(axis=0, dtype=np.float64) for a, b in bounds.reshape(-1, 2)])
            i = j
        return out

    def decide(self, texts: list[bytes], documents: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Language number and confidence of each text; ``documents`` numbers the document of each, in ascending order."""
        bits = self.code_lengths(texts)
        if any(self.scripts):
            for i, t in enumerate(texts):
                share = scripts(t)
                for j, s in enumerate(self.scripts):
                    if s and share.get(s, 0.0) < SCRIPT_SHARE:
                        bits[i, j] += 1e6
        if documents is not None and len(texts):
            first = np.flatnonzero(np.diff(documents, prepend=documents[0] - 1))
            whole = np.add.reduceat(bits, first, axis=0).argmin(axis=1)
            bits[np.arange(len(bits)), np.repeat(whole, np.diff(np.append(first, len(bits))))] -= PRIOR
        best = bits.argmin(axis=1)
        gap = bits - bits[np.arange(len(bits)), best][:, None]
        return best, 1.0 / np.exp2(-np.minimum(gap, 400.0) / DOUBT).sum(axis=1)


def fit(documents: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Trees from at most ``sample`` labelled documents a language, refitted once on their own decisions."""
    known = documents.select("doc_id", "text", label(F.col("lang")).alias("label")).filter(F.col("label").rlike("^[a-z]{2}$") & F.col("text").isNotNull())
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    counts = {k: v for k, v in counts.items() if v >= MIN_DOCUMENTS}
    if not counts:
        return LanguageModel({"und": b" "})
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limit = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, int(min(1.0, sample / v) * (1 << 20)) + 1)])
    chosen = known.filter(place < limit[F.col("label")]).select("doc_id", "label", place.alias("place"), "text")

    def sampled(b):
        out = {"label": [], "place": [], "doc_id": [], "texts": []}
        for d, x, at, t in zip(*[c.to_pylist() for c in b.columns]):
            p = [q[2][:PARAGRAPH_BYTES] for q in paragraphs(t)]
            if p:
                pick = sorted({i * len(p) // PARAGRAPHS for i in range(PARAGRAPHS)}) if len(p) > PARAGRAPHS else range(len(p))
                for k, v in zip(out, (x, at, d, [p[i] for i in pick])):
                    out[k].append(v)
        return out

    rows = map_arrow(chosen, sampled, "label string, place long, doc_id long, texts array<binary>").collect()
    by: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["place"], r["doc_id"])):
        by.setdefault(r["label"], []).extend(bytes(t) for t in r["texts"])
    by = {k: v for k, v in by.items() if v}
    if not by:
        return LanguageModel({"und": b" "})
    model = LanguageModel({k: b"    ".join(v) for k, v in by.items()})
    texts = [t for v in by.values() for t in v]
    best, sure = model.decide(texts)
    moved: dict[str, list[bytes]] = {}
    for t, b, c in zip(texts, best, sure):
        if c > 0.9:
            moved.setdefault(model.languages[b], []).append(t)
    return LanguageModel({k: b"    ".join(v) for k, v in moved.items()}) if moved else model


SEGMENTS = "doc_id long, segment int, start int, end int, letters int, lang string, confidence double"


def segments(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Language and confidence of every counted paragraph."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(b):
        m = shared.value
        ids, places, spans, texts = [], [], [], []
        for place, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            for i, (start, end, folded, letters) in enumerate(paragraphs(t)):
                ids.append(d)
                places.append(place)
                spans.append((i, start, end, letters))
                texts.append(folded)
        if not ids:
            return None
        best, sure = m.decide(texts, np.array(places))
        i, start, end, letters = zip(*spans)
        return {"doc_id": ids, "segment": i, "start": start, "end": end, "letters": letters, "lang": [m.languages[x] for x in best], "confidence": sure.tolist()}

    return map_arrow(documents.select("doc_id", "text"), rows, SEGMENTS)


def document_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang, confidence, languages``: the language of most letters, and all languages of the counted paragraphs."""
    by = segments(documents, model).groupBy("doc_id", "lang").agg(F.sum("letters").alias("n"), F.sum(F.col("letters") * F.col("confidence")).alias("c"))
    return by.groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), (F.max_by("c", F.struct("n", "lang")) / F.sum("n")).alias("confidence"), F.array_sort(F.collect_set("lang")).alias("languages"))


def mislabelled(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang``: the languages of documents whose label is missing, names none of them, or that mix several."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(b):
        m = shared.value
        ids, labels, count, texts = [], [], [], []
        for d, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            p = paragraphs(t)
            if p:
                ids.append(d)
                labels.append(x)
                count.append(len(p))
                texts += [q[2] for q in p]
        best, _ = m.decide(texts, np.repeat(np.arange(len(count)), count)) if texts else ([], None)
        out = {"doc_id": [], "lang": []}
        at = 0
        for d, x, n in zip(ids, labels, count):
            found = {m.languages[k] for k in best[at : at + n]}
            at += n
            if x is None or x not in found or len(found) > 1:
                for lang in sorted(found):
                    out["doc_id"].append(d)
                    out["lang"].append(lang)
        return out

    return map_arrow(documents.select("doc_id", "text", label(F.col("lang")).alias("label")), rows, "doc_id long, lang string").distinct()
