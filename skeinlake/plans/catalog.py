"""All queries of the core, by name, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinlake.plans import search, stores, texts, urls

MODULES = (urls, texts, search, stores)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval: BM25 and vectors, fused, diversified and packed."""
    return search.hybrid(spark, sf)
