"""Discovery of a site's pages: sitemaps level by level, site maps ranked for a query, follow rules, crawl counters, search with filters."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinlake.functions import text as T, url as U
from skeinlake.operators.frontier import _query_tokens
from skeinlake.operators.pages import sitemap_entries
from skeinlake.operators.storage import cut


def sitemaps(seeds: DataFrame, documents: DataFrame, levels: int = 3, limit: int | None = None) -> DataFrame:
    """``seed, url, level``: addresses listed by the sitemaps of each seed, index files followed for some levels.

    ``seeds(seed, sitemap)`` names the sitemaps to begin with; a seed whose sitemap is null begins at
    ``/sitemap.xml``. ``documents(url, status, xml)`` holds fetched sitemaps; those missing or not of
    status 2xx list nothing, and a file that several index files name is read once for each seed. Each
    level is one join, so cycles end with the levels. ``limit`` keeps the least addresses of each seed.
    """
    default = F.concat(U.origin(F.col("seed")), F.lit("/sitemap.xml"))
    open_ = seeds.select("seed", F.coalesce("sitemap", default).alias("map")).filter(F.col("map").isNotNull()).distinct()
    good = documents.filter(F.col("status").between(200, 299)).groupBy("url").agg(F.min("xml").alias("xml"))
    entries = cut(sitemap_entries(good, "url", "xml").filter(F.lower("loc").rlike("^https?://")).select(F.col("url").alias("map"), F.col("kind"), F.col("loc")))
    found, visited = [], open_
    for level in range(1, levels + 1):
        rows = cut(open_.join(entries, "map"))
        found.append(rows.filter("kind = 'url'").select("seed", F.col("loc").alias("url"), F.lit(level).alias("level")))
        open_ = rows.filter("kind <> 'url'").select("seed", F.col("loc").alias("map")).distinct().join(visited, ["seed", "map"], "left_anti")
        if open_.isEmpty():
            break
        open_ = cut(open_)
        visited = visited.unionByName(open_)
    out = reduce(DataFrame.unionByName, found).groupBy("seed", "url").agg(F.min("level").alias("level"))
    if limit is not None:
        out = out.withColumn("_rn", F.row_number().over(Window.partitionBy("seed").orderBy("level", "url"))).filter(F.col("_rn") <= limit).drop("_rn")
    return out


def map_host(base: Column, target: Column, strict: bool = True) -> Column:
    """Whether an address belongs to the mapped site: its host, or one below it; not ``strict`` takes any host that ends with the base."""
    h = U.host(target)
    return F.coalesce((h == base) | h.endswith(F.concat(F.lit("."), base)) if strict else h.endswith(base), F.lit(False))


def site_map(links: DataFrame, titles: DataFrame, base: str, query: str = "", includes: list[str] = (), excludes: list[str] = (), limit: int = 100) -> DataFrame:
    """``url, title, score``: addresses of one site, each once, with the title of its page or else of the best anchor.

    ``links(url, title)`` are found links, ``titles(url, title, description)`` fetched pages. Ties in the
    score are ordered by address; the limit is kept between 1 and 5000.
    """
    x = links.select(U.normalize(F.col("url")).alias("url"), "title").filter(F.col("url").isNotNull() & map_host(F.lit(base), F.col("url")) & ~U.is_static_asset(F.col("url")) & U.path_allowed(U.path(F.col("url")), includes, excludes))
    once = x.groupBy("url").agg(F.min("title").alias("anchor"))
    known = titles.select(U.normalize(F.col("url")).alias("url"), "title", "description").filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("title").alias("title"), F.min("description").alias("description"))
    named = once.join(known, "url", "left").select("url", F.coalesce("title", "anchor").alias("title"), "description")
    scored = named.select("url", "title", T.link_score(_query_tokens(query), F.col("title"), U.path(F.col("url")), F.col("description")).alias("score"))
    return scored.orderBy(F.desc("score"), "url").limit(max(1, min(limit, 5000)))


def follows(document_type: Column, feeds: bool = False, documents: bool = False) -> Column:
    """Whether the links of a fetched document are followed: those of HTML, of feeds or of any document where wanted."""
    return F.coalesce(document_type.isin("html", "xhtml"), F.lit(False)) | (F.coalesce(document_type.isin("rss", "atom", "feed"), F.lit(False)) & F.lit(feeds)) | F.lit(documents)


def crawl_counters(pages: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a crawl for each group over ``status, initial_url, final_url, content_type, content_length, fetch_time_ms, warnings``."""
    ok = F.col("status").between(200, 299)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return pages.groupBy(*by).agg(
        F.count("*").alias("pages"), n(ok).alias("completed"), n(~ok).alias("failed"), n(F.col("status") == 403).alias("blocked"), n(F.col("status").isin(404, 410)).alias("missing"), n(F.col("status") == 429).alias("limited"),
        n(F.col("status") >= 500).alias("server_errors"), n(~F.col("initial_url").eqNullSafe(F.col("final_url"))).alias("redirected"), n(F.lower("content_type").contains("html")).alias("html"), n(F.col("content_type").isNull()).alias("untyped"),
        n(F.size("warnings") > 0).alias("warned"), F.coalesce(F.sum("content_length"), F.lit(0)).alias("bytes"), F.max("fetch_time_ms").alias("slowest_ms"), F.count_distinct("final_url").alias("addresses"),
    )


# fixed values: hosts of trackers, matched anywhere in an address, and kinds of page resources by the name of their block
TRACKERS = "google-analytics.com googletagmanager.com doubleclick.net googleadservices.com facebook.net connect.facebook.net clarity.ms hotjar.com segment.io segment.com mixpanel.com amplitude.com criteo.net adroll.com scorecardresearch.com quantserve.com matomo.cloud sentry.io browser.sentry-cdn.com".split()
RESOURCES = {"font": ["font"], "media": ["media", "audio", "video"], "image": ["image"], "stylesheet": ["stylesheet"]}


def is_tracker(url: Column) -> Column:
    """Whether an address names a known tracker anywhere."""
    return F.coalesce(F.lower(url).rlike("|".join(t.replace(".", r"\.") for t in TRACKERS)), F.lit(False))


def blocks_request(url: Column, resource: Column, blocked: list[str] = ()) -> Column:
    """Whether a browser must not make a request: trackers, addresses within the own network, and unwanted kinds of resources."""
    kinds = [k for b in blocked for k in RESOURCES.get(b.lower(), [])]
    kind = F.lower(F.coalesce(resource, F.lit("")))
    fonts = kind.contains("font") if "font" in kinds else F.lit(False)
    return is_tracker(url) | U.blocked_host(U.host(url)) | F.coalesce(U.syntax_error(url).isNotNull(), F.lit(True)) | kind.isin(*kinds or [""]) & (kind != "") | fonts


def search_results(hits: DataFrame, url: str, score: str, key: str, domain: str | None = None, exclude: list[str] = (), limit: int = 10) -> DataFrame:
    """Hits of a search, each normalised address once (the best, ties by key), within a domain and without others; hosts match by containing."""
    host = F.coalesce(U.host(F.col(url)), F.lit(""))
    ok = F.contains(host, F.lit(domain.lower())) if domain else F.lit(True)
    for d in exclude:
        ok = ok & ~F.contains(host, F.lit(d.lower()))
    x = hits.withColumn("normalized", U.normalize(F.col(url))).filter(ok & F.col("normalized").isNotNull())
    w = Window.partitionBy("normalized").orderBy(F.desc(score), key)
    return x.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").orderBy(F.desc(score), key).limit(max(1, min(limit, 100)))
