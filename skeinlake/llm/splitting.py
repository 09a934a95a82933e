"""Problem 5: splitting oversized items at natural boundaries.

Method: lexical-cohesion segmentation. The text is cut into atoms (paragraphs, rows, sentences; words
where a sentence alone is too large). At every gap between atoms the words of a block before and a
block after it are compared; a valley of that similarity marks a topic boundary. Within the window of
ends that keep a piece under the limit, the gap with the deepest valley, weighed by its kind of
boundary, ends the piece. The next piece starts with about ``OVERLAP`` size units of the piece before.

Size is ``(ceil(chars / 4) + ceil(words * 4 / 3)) div 2`` with chars in code points and words as runs
without white space.

Defined results: null, empty and blank items and items within the limit stay whole (one piece,
nulls give an empty one); a single word above the limit is cut by code points; equal valleys give the
later gap; repeated rows of one item give its pieces once.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from skeinlake.llm.common import map_arrow

LIMIT, OVERLAP = 800, 80
#: Atoms on either side of a gap whose words are compared.
SIDE = 6
#: A piece should use at least this share of the limit.
FILL = 0.55
#: No text of fewer characters exceeds a limit L: size <= (chars / 4 + (chars + 1) / 2 * 4 / 3 + 2) / 2.
_BOUNDARY = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\n|(?<=[.!?…])[\"'»”’)\]]*[^\S\n]+|(?<=[。！？])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]{3,}|[一-鿿]")


def size(text: str | None) -> int:
    if not text:
        return 0
    return ((len(text) + 3) // 4 + (len(text.split()) * 4 + 2) // 3) // 2


def least_chars(limit: int) -> int:
    """Texts with fewer characters are never above the limit."""
    return max(0, int((2 * limit - 3) / (1 / 4 + 2 / 3)) - 2)


class _Measure:
    """Sizes of spans of one text in logarithmic time."""

    def __init__(self, text: str):
        self.starts, self.ends = [], []
        for m in re.finditer(r"\S+", text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def size(self, a: int, b: int) -> int:
        words = bisect_left(self.starts, b) - bisect_right(self.ends, a)
        return ((b - a + 3) // 4 + (max(0, words) * 4 + 2) // 3) // 2


def _gaps(text: str) -> list[tuple[int, int]]:
    """Ends of atoms with the kind of boundary: 3 paragraph, 2 row, 1 sentence; the end of the text is 4."""
    out = []
    for m in _BOUNDARY.finditer(text):
        s = m.group(0)
        n = s.count("\n")
        end = m.end()
        if 0 < end < len(text) and (not out or out[-1][0] < end):
            out.append((end, 3 if n > 1 else 2 if n else 1))
    out.append((len(text), 4))
    return out


def _depths(text: str, gaps: list[tuple[int, int]]) -> list[float]:
    """Depth of the similarity valley at each gap."""
    atoms, start = [], 0
    for end, _ in gaps:
        c: dict[str, int] = {}
        for w in _WORD.findall(text[start:end].lower()):
            c[w] = c.get(w, 0) + 1
        atoms.append(c)
        start = end
    n = len(atoms)
    sims = []
    left: dict[str, int] = {}
    right: dict[str, int] = {}

    def add(d, c, sign):
        for w, k in c.items():
            v = d.get(w, 0) + sign * k
            if v:
                d[w] = v
            else:
                del d[w]

    for i in range(min(SIDE, n)):
        add(right, atoms[i], 1)
    for i in range(n - 1):
        add(right, atoms[i], -1)
        if i + SIDE < n:
            add(right, atoms[i + SIDE], 1)
        add(left, atoms[i], 1)
        if i >= SIDE:
            add(left, atoms[i - SIDE], -1)
        dot = sum(k * right[w] for w, k in left.items() if w in right)
        norm = sqrt(sum(k * k for k in left.values()) * sum(k * k for k in right.values()))
        sims.append(dot / norm if norm else 0.0)
    up, down = list(sims), list(sims)  # the peak reached by climbing to the left, to the right
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            up[i] = up[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            down[i] = down[i + 1]
    return [a + b - 2 * s for a, b, s in zip(up, down, sims)] + [2.0]


# fixed values: weight of each kind of boundary against the depth of a valley
_WEIGHT = {1: 0.0, 2: 0.15, 3: 0.4, 4: 9.0}


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start of the overlap, start, end) in code points; together they cover the text."""
    if not text or size(text) <= limit:
        return [(0, 0, len(text or ""))]
    measure = _Measure(text)
    gaps = _gaps(text)
    depths = _depths(text, gaps)
    ends = [g[0] for g in gaps]
    pieces = []
    start = back = 0
    n = len(text)
    while start < n:
        first = bisect_right(ends, start)
        # last gap that keeps the piece within the limit
        lo, hi = first, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            if measure.size(back, ends[mid]) <= limit:
                lo = mid + 1
            else:
                hi = mid
        best = None
        for i in range(first, lo):
            if ends[i] == n or measure.size(back, ends[i]) >= FILL * limit:
                value = depths[i] + _WEIGHT[gaps[i][1]]
                if best is None or value >= best[0]:
                    best = (value, ends[i])
        if best is None and lo > first:
            best = (0.0, ends[lo - 1])
        if best is None and back < start and measure.size(start, ends[first]) <= limit:
            back = start  # the next atom fits, but not with the overlap: shorten the overlap to whole words
            for i in range(bisect_left(measure.starts, start) - 1, -1, -1):
                if measure.size(measure.starts[i], ends[first]) > limit:
                    break
                back = measure.starts[i]
                if measure.size(back, start) >= overlap:
                    break
            continue
        if best is not None:
            end = best[1]
        else:  # one atom is too large: cut at its last word that fits, or inside the word
            i = bisect_right(measure.ends, start)
            lo, hi = i, len(measure.ends)
            while lo < hi:
                mid = (lo + hi) // 2
                if measure.size(back, measure.ends[mid]) <= limit:
                    lo = mid + 1
                else:
                    hi = mid
            end = measure.ends[lo - 1] if lo > i else 0
            if end > start:
                rest = _SPACE.match(text, end)
                if rest and measure.size(back, rest.end()) <= limit:
                    end = rest.end()
            else:
                end = start + 1
                step = n - start
                while step:
                    if end + step <= n and measure.size(back, end + step) <= limit:
                        end += step
                    else:
                        step //= 2
        pieces.append((back, start, end))
        start = end
        # the overlap: whole words of the piece just cut, about `overlap` size units
        back = start
        i = bisect_left(measure.starts, start) - 1
        low = pieces[-1][1]
        while i >= 0 and measure.starts[i] > low:
            if measure.size(measure.starts[i], start) > overlap:
                break
            back = measure.starts[i]
            i -= 1
        if back == start and overlap:  # a long word: part of it
            back = max(low, start - 4 * overlap // 2)
    return pieces


PIECES = "item_id string, piece_no int, pieces int, heading_path array<string>, text string, size int, overlap int"


def split_items(items: DataFrame, item_id: str, text: str, heading_path: str, limit: int = LIMIT, overlap: int = OVERLAP, only_split: bool = False) -> DataFrame:
    """Numbered pieces of every item; with ``only_split`` those of oversized items alone, filtered before Python."""
    rows_in = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"), F.col(heading_path).alias("heading_path"))
    large = F.char_length("text") >= least_chars(limit)

    def rows(b):
        out = {k.split()[0]: [] for k in PIECES.split(", ")}
        for i, t, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            pieces = split_text(t, limit, overlap)
            if only_split and len(pieces) == 1:
                continue
            for no, (back, start, end) in enumerate(pieces, 1):
                piece = t[back:end]
                for k, v in zip(out, (i, no, len(pieces), path, piece, size(piece), size(t[back:start]))):
                    out[k].append(v)
        return out

    split = map_arrow(rows_in.filter(large), rows, PIECES)
    if not only_split:
        words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
        whole = rows_in.filter(~F.coalesce(large, F.lit(False))).select(
            "item_id", F.lit(1).alias("piece_no"), F.lit(1).alias("pieces"), "heading_path", F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.floor((F.ceil(F.char_length("text") / 4) + F.ceil(words * 4 / 3)) / 2), F.lit(0)).cast("int").alias("size"), F.lit(0).alias("overlap"),
        )
        split = split.unionByName(whole)
    return split.dropDuplicates(["item_id", "piece_no"])
