"""Snapshot comparison: how each page changed between two crawls."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def change_type(in_new: Column, in_old: Column, status: Column, same_address: Column, same_hash: Column) -> Column:
    """``new``, ``deleted``, ``unchanged``, ``unknown``, ``redirected`` or ``changed``; the first rule that applies."""
    return (
        F.when(~in_new, F.lit("deleted"))
        .when(~in_old, F.lit("new"))
        .when(status == 304, F.lit("unchanged"))
        .when(status.isin(404, 410), F.lit("deleted"))
        .when(status >= 400, F.lit("unknown"))
        .when(~same_address, F.lit("redirected"))
        .when(same_hash, F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )


def diff(current: DataFrame, baseline: DataFrame, key: str = "url") -> DataFrame:
    """``key, change`` over a full outer join of two snapshots ``key, status, final_url, raw_hash, norm_hash``.

    Each key may stand once on either side. A page is the same if its raw or its normalised hash is;
    two null hashes are no match.
    """
    a = current.select(key, F.lit(True).alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("status", "final_url", "raw_hash", "norm_hash")])
    b = baseline.select(key, F.lit(True).alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("final_url", "raw_hash", "norm_hash")])
    x = a.join(b, key, "full")
    same_hash = F.coalesce(F.col("a_raw_hash") == F.col("b_raw_hash"), F.lit(False)) | F.coalesce(F.col("a_norm_hash") == F.col("b_norm_hash"), F.lit(False))
    kind = change_type(F.col("a").isNotNull(), F.col("b").isNotNull(), F.col("a_status"), F.col("a_final_url").eqNullSafe(F.col("b_final_url")), same_hash)
    return x.select(key, kind.alias("change"))


def summary(changes: DataFrame) -> DataFrame:
    """Pages of each kind of change."""
    return changes.groupBy("change").agg(F.count("*").alias("pages"))
