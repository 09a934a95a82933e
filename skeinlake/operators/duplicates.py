"""Exact and near duplicates by hashes and fingerprints."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from skeinlake.functions import text as T
from skeinlake.operators.storage import cut

#: Fingerprint bits, blocks they are cut into, and bits in which near duplicates may differ.
BITS, BLOCKS, DISTANCE = 60, 6, 3


def exact_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class_id, copies`` of documents with a text; texts that differ in white space alone are one class, named by its least key."""
    x = docs.select(key, T.chunk_hash(F.col(text)).alias("h")).filter(F.col("h").isNotNull())
    # pre-aggregated per hash before the join, so that a class with a third of all rows is one row on its side
    classes = x.groupBy("h").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    return x.join(classes, "h").select(key, "class_id", "copies")


def near_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b, bits`` of all pairs of distinct fingerprints that differ in at most ``distance`` bits.

    With ``BLOCKS`` blocks at least ``BLOCKS - distance`` of them are equal in such a pair, so one of
    the keys made of that many blocks joins it: an equi-join finds every pair, none is scored twice.
    """
    width = BITS // BLOCKS
    block = lambda i: F.shiftright("print", i * width).bitwiseAND((1 << width) - 1)
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64(*[block(i) for i in c]).alias("k")) for n, c in enumerate(combinations(range(BLOCKS), BLOCKS - distance))])
    x = prints.select(F.col("fingerprint").alias("print")).distinct().select("print", F.explode(keys).alias("key"))
    pairs = x.alias("x").join(x.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.print") < F.col("y.print")))
    bits = T.hamming(F.col("x.print"), F.col("y.print"))
    return pairs.select(F.col("x.print").alias("a"), F.col("y.print").alias("b"), bits.alias("bits")).filter(F.col("bits") <= distance).distinct()


def near_classes(docs: DataFrame, key: str, text: str, distance: int = DISTANCE) -> DataFrame:
    """``key, class_id, links``: documents of one fingerprint form a class named by its least key; links counts other classes within the distance."""
    x = cut(T.simhash(docs.select(key, text), key, text))  # read three times
    classes = x.groupBy("fingerprint").agg(F.min(key).alias("class_id"))
    pairs = near_pairs(classes, distance)
    links = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("links"))
    return x.join(classes, "fingerprint").join(links, "fingerprint", "left").select(key, "class_id", F.coalesce("links", F.lit(0)).alias("links"))
