"""Frontier operators: de-duplication, filter reasons, level-synchronous crawling of a page table, link ranking."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skeinlake.functions import robots, text, url as U
from skeinlake.operators.storage import cut


def dedupe(pages: DataFrame, url: str, order: list, ignore_query: bool = False) -> DataFrame:
    """First row of each normalised address, in the given order; malformed addresses are dropped."""
    x = pages.withColumn("normalized", U.normalize(F.col(url), ignore_query)).filter(F.col("normalized").isNotNull())
    return x.withColumn("_rn", F.row_number().over(Window.partitionBy("normalized").orderBy(*order))).filter("_rn = 1").drop("_rn")


def decide(frontier: DataFrame, url: str, depth: str, seed: str, order: list[str], **options) -> DataFrame:
    """Adds ``reason`` (why a row is left out, ``duplicate`` last) and ``normalized``; reason null means it may be fetched.

    Equal rows are one row; of rows with one address the first by ``order`` is kept. The first rows are found by
    a limit that works before the shuffle and joined back by address and row, so an address that a third
    of all links point to is no hot key.
    """
    reason = U.filter_reason(F.col(url), F.col(depth), F.col(seed), **options)
    x = frontier.distinct().withColumn("_reason", reason).withColumn("normalized", U.normalize(F.col(url))).withColumn("_row", F.xxhash64(*frontier.columns))
    w = Window.partitionBy("normalized").orderBy(*order, "_row")
    first = x.filter(F.col("_reason").isNull()).select("normalized", "_row", *order).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("normalized", "_row", F.lit(True).alias("_first"))
    x = x.join(first, ["normalized", "_row"], "left")
    return x.withColumn("reason", F.coalesce("_reason", F.when(F.col("_first").isNull(), F.lit("duplicate")))).drop("_reason", "_row", "_first")


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int = 3, limit: int | None = None) -> DataFrame:
    """Breadth-first crawl over tables: ``pages(url)``, ``links(url, target)``, ``seeds(url)``, all normalised.

    Returns ``url, depth, parent, found``: the level at which each address is first reached, its least
    parent, and whether its page exists. Every level is one join, one pre-aggregation and one anti-join;
    the visited set is cut to shared storage after each level, so that lineage does not grow. ``limit``
    stops before the level after which that many pages were fetched; the level itself stays whole.
    """
    known = cut(pages.select("url").distinct())
    visited = cut(seeds.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).dropDuplicates(["url"]))
    edges = cut(links.select("url", "target").filter(F.col("target").isNotNull()).distinct())
    for depth in range(max_depth):
        level = visited.filter(F.col("depth") == depth).select("url").join(known, "url", "left_semi")
        found = level.join(edges, "url").groupBy(F.col("target").alias("url")).agg(F.min(F.col("url")).alias("parent"))
        fresh = cut(found.join(visited.select("url"), "url", "left_anti").select("url", F.lit(depth + 1).alias("depth"), "parent"))
        if fresh.isEmpty():
            break
        visited = cut(visited.unionByName(fresh))
        if limit is not None and visited.join(known, "url", "left_semi").count() >= limit:
            break
    return visited.join(known.withColumn("found", F.lit(True)), "url", "left").select("url", "depth", "parent", F.coalesce("found", F.lit(False)).alias("found"))


def admitted(urls: DataFrame, url: str, rules: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed`` and ``delay_ms`` by the robots rules ``origin, rules`` of each address; origins without rules allow."""
    x = urls.withColumn("origin", U.origin(F.col(url)))
    joined = x.join(rules.select("origin", "rules"), "origin", "left")
    ok = F.when(F.col("rules").isNull(), F.lit(True)).otherwise(robots.allowed(F.col("rules"), U.path(F.col(url)), agent))
    return joined.withColumn("allowed", ok).withColumn("delay_ms", robots.delay_ms(F.col("rules"), agent)).drop("rules", "origin")


def rank_links(links: DataFrame, query: str, url: str, title: str, description: str) -> DataFrame:
    """Adds ``score``, the relevance of each link to a query; higher is better."""
    tokens = [t for t in _query_tokens(query)]
    return links.withColumn("score", text.link_score(tokens, F.col(title), U.path(F.col(url)), F.col(description)))


def _query_tokens(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^\w]+|_", query.lower()) if len(w.encode()) >= 2 and w not in text.RANK_STOPWORDS]


def retry(status, attempt, base_ms: int = 500, retry_after=None):
    """Struct of whether a status is worth another attempt, and after how many milliseconds."""
    again = status.isin(408, 425, 429, 500, 502, 503, 504)
    wait = F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(5))).cast("long")
    if retry_after is not None:
        wait = F.when(retry_after.between(1, 30), retry_after * 1000).otherwise(wait)
    return F.struct(again.alias("retryable"), wait.cast("long").alias("delay_ms"))
