"""Problem 9: evaluation texts leaking into training text.

Method: n-gram seeds join documents to test items, then Smith-Waterman alignment scores each
candidate pair, so that paraphrased or edited copies are found as well as whole ones. Seeds are runs
of five words (all words of an item that has fewer). Every seed of an item counts, however frequent
it is: a choice by rarity would lose the edited copies that share other seeds only. The cost of frequent
seeds is bounded by a test that loses nothing: a pair is aligned only if its exact run can be long
enough, or the longest common subsequence, which no alignment exceeds, has the words wanted. A copy
edited so closely that no five words in a row are left has no seed and is not found.

The items are the stated query set: they are taken in blocks of at most ``BLOCK_WORDS`` words, which
bounds what is broadcast; all documents are scanned for every block.

Defined results: null, empty and wordless documents and items give no pair; words are runs of
letters or digits, compared in lower case; repeated rows of a document or item count once.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm.common import map_arrow
from skeinlake.llm.hashing import HashIndex, hash_words, word_runs as runs

SEED, RUN = 5, 12
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
#: Aligned pairs with at least this share of the item's words matched are reported even without an exact run.
IDENTITY = 0.6
_WORDS = re.compile(r"[^\W_]+")


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word of a text, in order."""
    return hash_words(_WORDS.findall(text.lower())) if text else np.zeros(0, dtype=np.uint64)


class Items:
    """One block of test items with their seeds and the items that have each."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.words = [word_hashes(r[1]) for r in rows]
        self.lengths = sorted({min(SEED, len(w)) for w in self.words if len(w)})
        owners: dict[int, set[int]] = {}
        for i, w in enumerate(self.words):
            for x in runs(w, min(SEED, len(w))).tolist() if len(w) else ():
                owners.setdefault(x, set()).add(i)
        self.seeds = np.array(sorted(owners), dtype=np.uint64)
        self.owners = [sorted(owners[int(x)]) for x in self.seeds]
        self._index, self._bits = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_index": None, "_bits": {}}

    def index(self) -> HashIndex:
        if self._index is None:
            self._index = HashIndex(self.seeds)
        return self._index

    def common(self, i: int, doc: np.ndarray) -> int:
        """Length of the longest common subsequence of an item and some words, bit-parallel over the item."""
        bits = self._bits.get(i)
        if bits is None:
            bits = self._bits[i] = {}
            for j, w in enumerate(self.words[i].tolist()):
                bits[w] = bits.get(w, 0) | 1 << j
        n = len(self.words[i])
        full = free = (1 << n) - 1
        for w in doc.tolist():
            if w in bits:
                u = free & bits[w]
                free = ((free + u) | (free - u)) & full
        return n - free.bit_count()


def _scan(texts: list, items: Items):
    """Words of all texts in a row, the bounds of each, and (position, seed number) of every seed found."""
    parts = [word_hashes(t) for t in texts]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    words = np.concatenate([*parts, np.zeros(0, np.uint64)])
    ends = np.cumsum(size)
    hits = []
    doc = np.repeat(np.arange(len(parts)), size)
    for k in items.lengths:
        h = runs(words, k)
        if not len(h):
            continue
        at = items.index().find(h)
        pos = np.flatnonzero(at >= 0)
        pos = pos[doc[pos] == doc[pos + k - 1]]  # runs do not cross texts
        hits.append(np.stack([pos, at[pos], doc[pos]], axis=1))
    return words, ends - size, ends, np.concatenate([*hits, np.zeros((0, 3), np.int64)]).astype(np.int64)


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score, words matched by it, and the longest exact run of two word sequences."""
    n, m = len(doc), len(item)
    if not n or not m:
        return 0, 0, 0
    score, matched = np.zeros(m + 1, dtype=np.int32), np.zeros(m + 1, dtype=np.int32)
    run = np.zeros(m + 1, dtype=np.int32)
    step = np.arange(m + 1, dtype=np.int32) * GAP
    best = best_matched = longest = 0
    for w in doc:
        same = item == w
        diagonal = score[:-1] + np.where(same, MATCH, MISMATCH)
        new, via = score - GAP, matched.copy()
        take = diagonal >= new[1:]
        new[1:] = np.where(take, diagonal, new[1:])
        via[1:] = np.where(take, matched[:-1] + same, matched[1:])
        dead = new < 0
        new[dead] = 0
        via[dead] = 0
        # gaps along the item: prefix maximum of the score plus its distance, matches carried along
        key = np.maximum.accumulate((new + step).astype(np.int64) << 32 | via)
        score = (key >> 32).astype(np.int32) - step
        matched = key.astype(np.int32)
        np.maximum(score, 0, out=score)
        run[1:] = np.where(same, run[:-1] + 1, 0)
        j = int(score.argmax())
        if score[j] > best:
            best, best_matched = int(score[j]), int(matched[j])
        if (r := int(run.max())) > longest:
            longest = r
    return best, best_matched, longest


def _has_run(at: list[int], k: int) -> bool:
    """Whether sorted positions hold k in a row."""
    return any(at[i + k - 1] - at[i] == k - 1 for i in range(len(at) - k + 1))


def _blocks(items: DataFrame):
    """The distinct items in blocks of bounded size."""
    block, words = [], 0
    for r in items.select("item_id", "text").filter(F.col("text").isNotNull()).dropDuplicates(["item_id"]).orderBy("item_id").toLocalIterator():
        n = len(_WORDS.findall(r["text"]))
        if block and words + n > BLOCK_WORDS:
            yield Items(block)
            block, words = [], 0
        if n:
            block.append((r["item_id"], r["text"]))
            words += n
    if block:
        yield Items(block)


PAIRS = "doc_id long, item_id long, score int, matched int, item_words int, longest_run int"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, matched, item_words, longest_run`` of documents that align with an item.

    A pair is reported if its alignment scores as high as a run of ``RUN`` words, or as all words of a shorter
    item, and holds such a run, or if it matches at least ``IDENTITY`` of the item's words.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    out = None
    for block in _blocks(items):
        seeds = spark.sparkContext.broadcast(block)

        def pairs(b, seeds=seeds):
            it = seeds.value
            ids = b.column(0).to_pylist()
            words, start, end, hits = _scan(b.column(1).to_pylist(), it)
            by: dict[tuple[int, int], list[int]] = {}
            for pos, seed, doc in hits.tolist():
                for i in it.owners[seed]:
                    by.setdefault((doc, i), []).append(pos)
            rows = {k.split()[0]: [] for k in PAIRS.split(", ")}
            for (doc, i), at in by.items():
                item = it.words[i]
                n = len(item)
                at.sort()
                parts = []
                k = 0
                while k < len(at):  # one alignment for each cluster of seeds
                    j = k
                    while j + 1 < len(at) and at[j + 1] - at[j] <= 2 * n:
                        j += 1
                    parts.append(words[max(start[doc], at[k] - n - 5) : min(end[doc], at[j] + n + 5)])
                    k = j + 1
                if not _has_run(at, RUN - SEED + 1) and all(it.common(i, p) < IDENTITY * n for p in parts):
                    continue  # neither a run of RUN words nor enough words in order; shorter items with all words pass
                best = (0, 0, 0)
                longest = 0
                for p in parts:
                    a = align(p, item)
                    best, longest = max(best, a), max(longest, a[2])
                if best[0] >= MATCH * min(RUN, n) and longest >= min(RUN, n) or best[1] >= IDENTITY * n and best[1] >= SEED:
                    for c, v in zip(rows, (ids[doc], it.ids[i], best[0], best[1], n, longest)):
                        rows[c].append(v)
            return rows

        found = map_arrow(docs, pairs, PAIRS)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], PAIRS)
    return out.dropDuplicates(["doc_id", "item_id"])


def exact(pairs: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of the pairs that share ``RUN`` consecutive words, or all words of a shorter item."""
    return pairs.filter(F.col("longest_run") >= F.least(F.lit(RUN), "item_words")).select("doc_id", "item_id")
