"""Interfaces to services that give embeddings, answers and search hits, with deterministic stand-ins."""
from __future__ import annotations

import hashlib
import hmac
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, functions as F


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class MockEmbedder:
    """Unit vectors from hashes: a component of the whole text plus small parts of each word."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def _noise(self, text: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "big")
        return np.random.default_rng(seed).uniform(-1, 1, self.dimensions)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = self._noise(t) + 0.2 * sum((self._noise(w) for w in t.lower().split()), np.zeros(self.dimensions))
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def embed(chunks: DataFrame, key: str, text: str, embedder: Embedder, cache: DataFrame | None = None) -> DataFrame:
    """``key, hash, embedding``: texts of one hash are embedded once, those in the cache (``hash, embedding``) not at all."""
    from skeinlake.functions.text import chunk_hash

    x = chunks.select(key, F.col(text).alias("text"), chunk_hash(F.col(text)).alias("hash")).filter(F.col("text").isNotNull())
    fresh = x.groupBy("hash").agg(F.min("text").alias("text"))
    if cache is not None:
        fresh = fresh.join(cache.select("hash"), "hash", "left_anti")
    done = fresh.mapInArrow(_embed_batches(embedder), "hash string, embedding array<float>")
    if cache is not None:
        done = done.unionByName(cache.select("hash", "embedding"))
    return x.join(done, "hash").select(key, "hash", "embedding")


def _embed_batches(embedder: Embedder, most: int = 32, budget: int = 20_000):
    """One request of the embedder for up to ``most`` texts or about ``budget`` tokens, whichever is reached first."""

    def run(rows):
        import pyarrow as pa

        for b in rows:
            texts, vectors, start, size = b.column(1).to_pylist(), [], 0, 0
            for i, t in enumerate([*texts, None]):
                n = len(t or "") // 4 + 1
                if i > start and (t is None or i - start >= most or size + n > budget):
                    vectors += embedder.embed(texts[start:i])
                    start, size = i, 0
                size += n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["hash", "embedding"])

    return run


def signature(secret: str, timestamp: int, payload: str) -> str:
    """HMAC-SHA256 of ``{timestamp}.{payload}`` in hex."""
    return hmac.new(secret.encode(), f"{timestamp}.{payload}".encode(), hashlib.sha256).hexdigest()


class MockSearch:
    """Canned hits by query, else one hit at 0.8."""

    def __init__(self, canned: dict[str, list[dict]] | None = None):
        self.canned = canned or {}

    def search(self, query: str, limit: int = 10) -> list[dict]:
        return self.canned.get(query, [{"url": "https://example.com/search", "title": query, "description": "", "score": 0.8}])[: max(1, min(limit, 100))]


def batches(chunks: DataFrame, key: str, tokens: str, group: str, most: int = 32, budget: int = 20_000) -> DataFrame:
    """``group, key, batch``: chunks of each group in key order, a new batch when the count or the tokens would exceed the bounds.

    The running sum resets at each batch, which no window can say, so each group is folded in key order.
    """
    from pyspark.sql import functions as G

    items = chunks.groupBy(group).agg(G.array_sort(G.collect_list(G.struct(G.col(key).alias("k"), G.col(tokens).cast("long").alias("t")))).alias("x"))
    start = G.struct(G.lit(0).alias("b"), G.lit(0).alias("n"), G.lit(0).cast("long").alias("s"), G.array().cast("array<int>").alias("out"))

    def step(acc, x):
        full = (acc["n"] > 0) & ((acc["n"] >= most) | (acc["s"] + x["t"] > budget))
        b = G.when(full, acc["b"] + 1).otherwise(acc["b"])
        return G.struct(b.alias("b"), G.when(full, G.lit(1)).otherwise(acc["n"] + 1).alias("n"), G.when(full, x["t"]).otherwise(acc["s"] + x["t"]).alias("s"), G.concat(acc["out"], G.array(b)).alias("out"))

    numbered = items.select(group, "x", G.aggregate("x", start, step, lambda a: a["out"]).alias("b"))
    return numbered.select(group, G.explode(G.arrays_zip("x", "b")).alias("z")).select(group, G.col("z.x.k").alias(key), G.col("z.b").alias("batch"))
