"""Problem 8: encoding the corpus with a public byte-level BPE vocabulary.

Method: texts are cut into pre-tokens; distinct pre-tokens are encoded together in length-bucketed
padded matrices. Each round every row merges its leftmost pair of least rank, found through a hashed
pair table, and is closed up; finished rows leave the matrix. Pre-tokens longer than ``LONG`` bytes
use a heap over a linked list, which gives the same ids in n log n.

Defined results: null and empty texts give an empty list; names of special tokens are ordinary
text; every row of the input gives one row.
"""
from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; never copied into the repository.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Pre-tokens above this many bytes are encoded one by one.
LONG = 256
#: Distinct pre-tokens a worker remembers.
REMEMBERED = 400_000
#: Rows of one matrix.
ROWS = 20_000
# fixed value: the pre-token pattern of the vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
NONE = np.int32(2**31 - 1)


class Ranks:
    """A vocabulary as arrays: ids of single bytes and an open-addressed table from pairs of ids to the merged id."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(PATTERN)
        ranks = self.ranks
        self.n = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    values.append(rank)
        keys, values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)
        self.bits = max(10, int(np.ceil(np.log2(len(keys) * 3))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int32)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # linear probing, all keys at once; the first key that wants a slot gets it
            free = self.keys[at[left]] == -1
            want = left[free]
            slots, first = np.unique(at[want], return_index=True)
            self.keys[slots], self.values[slots] = keys[want[first]], values[want[first]]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged id, which is also the rank, of each pair; NONE where the pair does not merge or b is padding."""
        keys = a.astype(np.int64) * self.n + b
        keys[b < 0] = -2
        flat = keys.ravel()
        at = self._slot(flat)
        found = self.keys[at]
        out = np.where(found == flat, self.values[at], NONE)
        todo = np.flatnonzero((found != flat) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out.reshape(a.shape)

    def matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Encodes the rows of a padded (-1) matrix of byte ids."""
        n = len(ids)
        out: list = [None] * n
        rows = np.arange(n)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((n, 1), NONE, dtype=np.int32)
        while len(rows):
            pos = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), pos]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    r = ids[i]
                    out[rows[i]] = r[r >= 0]
                keep = ~done
                rows, ids, ranks, pos, best = rows[keep], ids[keep], ranks[keep], pos[keep], best[keep]
                if not len(rows):
                    break
                width = int((ids >= 0).sum(axis=1).max())
                ids, ranks = ids[:, :width], ranks[:, : max(1, width - 1)]
            m, width = ids.shape
            here = np.arange(m)
            # close up: columns behind the merged pair move one to the left
            col = np.arange(width - 1)[None, :]
            moved = np.where(col > pos[:, None], ids[:, 1:], ids[:, :-1])
            moved[here, pos] = best
            ids = moved
            if width == 2:
                for i in range(m):
                    out[rows[i]] = ids[i]
                break
            pc = np.arange(width - 2)[None, :]
            ranks = np.where(pc > pos[:, None] - 1, ranks[:, 1:], ranks[:, :-1])
            for d in (-1, 0):  # only the pairs beside the merge change
                p = pos + d
                ok = (p >= 0) & (p < width - 2)
                if ok.any():
                    r = here[ok]
                    ranks[r, p[ok]] = self.pair_ranks(ids[r, p[ok]], ids[r, p[ok] + 1])
        return out

    def long(self, word: bytes) -> np.ndarray:
        """The same merges for one long pre-token with a heap over a linked list."""
        ids = self.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pair_ranks(np.array(ids[:-1], dtype=np.int32), np.array(ids[1:], dtype=np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def rank(a, b):
            return int(self.pair_ranks(np.array([a], dtype=np.int32), np.array([b], dtype=np.int32))[0])

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or not alive[i] or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = rank(r, ids[k])
                if x != NONE:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            h = before[i]
            if h >= 0:
                x = rank(ids[h], r)
                if x != NONE:
                    heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x, ok in zip(ids, alive) if ok], dtype=np.int32)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(raw)
        length = np.array([len(w) for w in raw], dtype=np.int64)
        for i in np.flatnonzero(length > LONG):
            out[i] = self.long(raw[i])
        low = 0
        for high in (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONG):
            bucket = np.flatnonzero((length > low) & (length <= high))
            low = high
            for start in range(0, len(bucket), ROWS):
                part = bucket[start : start + ROWS]
                flat = self.bytes[np.frombuffer(b"".join(raw[i] for i in part), dtype=np.uint8)]
                width = length[part]
                ids = np.full((len(part), max(2, int(width.max()))), -1, dtype=np.int32)
                ids[np.arange(ids.shape[1])[None, :] < width[:, None]] = flat
                for i, x in zip(part, self.matrix(ids)):
                    out[i] = x
        return out


class _Words(dict):
    """Numbers pre-tokens in the order they are first seen."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self._reset()

    def _reset(self):
        self.words = _Words()
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offset of each text."""
        if len(self.words) > REMEMBERED:
            self._reset()
        find, number = self.ranks.pattern.findall, self.words.__getitem__
        seen: list[int] = []
        bounds = [0]
        for t in texts:
            if t:
                seen.extend(map(number, find(t)))
            bounds.append(len(seen))
        if self.words.fresh:
            coded = self.ranks.encode_words(self.words.fresh)
            size = np.array([len(x) for x in coded], dtype=np.int64)
            start = len(self.flat) + np.concatenate([[0], np.cumsum(size)[:-1]])
            self.flat, self.start, self.size = np.concatenate([self.flat, *coded]), np.concatenate([self.start, start]), np.concatenate([self.size, size])
            self.words.fresh = []
        word = np.array(seen, dtype=np.int64)
        size = self.size[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[word] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[at], ends[np.array(bounds)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(Ranks(path))
    return _encoders[path]


def token_ids(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids`` for every row: the ids of ``text`` by the vocabulary, without special tokens."""
    path = f"{folder}/{vocabulary}.tiktoken"
    source = df.select(key, text)
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([source.schema[0], StructField("ids", ArrayType(IntegerType(), False))])

    def run(batches):
        e = encoder(path)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                flat, offsets = e.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return source.mapInArrow(run, schema)
