"""Evidence for research: a store without doubles, the best pieces, coverage gaps, a report; and what a cache would have answered."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinlake.functions import text as T, url as U


def store(pieces: DataFrame, text: str, url: str, relevance: str, order: list[str]) -> DataFrame:
    """Pieces with a text, equal ones (white space aside) once, the first by ``order``; adds ``hash``, ``class`` and ``weighted``, relevance by the weight of the source."""
    x = pieces.withColumn("hash", T.chunk_hash(F.col(text))).filter(F.col("hash").isNotNull() & (T.collapse(F.col(text)) != ""))
    once = x.withColumn("_rn", F.row_number().over(Window.partitionBy("hash").orderBy(*order))).filter("_rn = 1").drop("_rn")
    c = once.withColumn("class", U.source_class(F.col(url)))
    return c.withColumn("weighted", F.round(F.coalesce(F.col(relevance).cast("double"), F.lit(0.0)) * U.source_weight(F.col("class")), 6))


def top(evidence: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The pieces of most weighted relevance, ties by key."""
    return evidence.orderBy(F.desc("weighted"), key).limit(limit)


def gaps(evidence: DataFrame, topic: str, url: str, fields: Column, required: list[str], least_sources: int = 2) -> DataFrame:
    """``topic, sources, missing, diverse, complete``: hosts of each topic's evidence and the required fields that no piece of it gives.

    ``fields`` is an array of the fields a piece gives, null for none.
    """
    empty = F.array().cast("array<string>")
    x = evidence.select(topic, U.host(F.col(url)).alias("host"), F.array_intersect(F.coalesce(fields, empty), F.array(*[F.lit(r) for r in required])).alias("fields"))
    have = x.groupBy(topic).agg(F.count_distinct("host").alias("sources"), F.array_distinct(F.flatten(F.collect_set("fields"))).alias("have"))  # at most the required ones
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.col("have")))
    diverse = F.col("sources") >= least_sources
    return have.select(topic, "sources", missing.alias("missing"), diverse.alias("diverse"), (diverse & (F.size(missing) == 0)).alias("complete"))


def report(evidence: DataFrame, topic: str, title: str, key: str, most: int = 5) -> DataFrame:
    """``topic, report, claims, confidence``: the best pieces of each topic as a list with marks ``[E1]``; sure from three pieces on."""
    w = Window.partitionBy(topic).orderBy(F.desc("weighted"), key)
    best = evidence.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= most)
    line = F.struct("no", F.concat(F.lit("- "), F.coalesce(F.col(title), F.lit("untitled")), F.lit(" [E"), F.col("no"), F.lit("]")).alias("line"))
    x = best.groupBy(topic).agg(F.array_sort(F.collect_list(line)).alias("x"))
    return x.select(topic, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("report"), F.size("x").cast("long").alias("claims"), F.when(F.size("x") >= 3, 0.85).otherwise(0.5).alias("confidence"))


def pack_bytes(chunks: DataFrame, group: str, score: str, key: str, text: str, budget: int = 20_000, most: int = 20) -> DataFrame:
    """Best chunks of each group within a budget of bytes, adding ``position`` and ``used``; a first chunk above it is cut to it, packing stops at the first that does not fit."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), key)
    n = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    x = chunks.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)
    x = x.withColumn("_end", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.filter((F.col("_end") <= budget) | (F.col("position") == 1)).withColumn("used", F.least(F.col("_end"), F.lit(budget))).withColumn("position", F.col("position").cast("long")).drop("_end")


def cache_outcomes(requests: DataFrame, key: str, url: str, time: str, ttl_seconds: int) -> DataFrame:
    """``key, outcome``: whether a cache of some lifetime would have answered each request: ``miss`` (first of its address), ``hit``, or ``expired``.

    An entry lives from the request that filled it; a lifetime of 0 never ends. Requests of one moment
    are ordered by key. Each address is folded on its own, as an expired entry is filled anew.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = requests.filter(F.col(url).isNotNull() & F.col(time).isNotNull()).groupBy(url).agg(F.array_sort(F.collect_list(F.struct(t.alias("t"), F.col(key).alias("k")))).alias("x"))
    none = F.array().cast(f"array<struct<k:{dict(requests.dtypes)[key]},o:string>>")

    def step(acc, r):
        fresh = acc["since"].isNull()
        dead = F.lit(ttl_seconds > 0) & (r["t"] - acc["since"] >= ttl_seconds * 1_000_000)
        outcome = F.when(fresh, F.lit("miss")).when(dead, F.lit("expired")).otherwise(F.lit("hit"))
        return F.struct(F.when(fresh | dead, r["t"]).otherwise(acc["since"]).alias("since"), F.concat(acc["out"], F.array(F.struct(r["k"].alias("k"), outcome.alias("o")))).alias("out"))

    folded = rows.select(F.aggregate("x", F.struct(F.lit(None).cast("long").alias("since"), none.alias("out")), step, lambda a: a["out"]).alias("o"))
    return folded.select(F.explode("o").alias("o")).select(F.col("o.k").alias(key), F.col("o.o").alias("outcome"))
