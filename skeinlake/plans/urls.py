"""Queries of the URL, robots, frontier and snapshot operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.functions import robots, url as U
from skeinlake.operators import frontier, pages, snapshots

INCLUDES, EXCLUDES = ["/docs/**", "/guide/**", "/blog/*"], ["/blog/k*", "/help/**"]
ROBOTS = """# sample rules
User-agent: *
Disallow: /ref/
Allow: /ref/r
Crawl-delay: 2.5

User-agent: skeinbot
Disallow: /blog/
Allow: /blog/k
Sitemap: https://example.org/sitemap.xml
"""
OTHER_ROBOTS = """User-agent: *
Disallow: /

User-agent: SkeinBot
User-agent: otherbot
Disallow: /guide
Allow: /guide
Disallow: /docs/
Allow: /docs/b   # longer than the rule above
"""
AGENT = "skeinbot/1.0"
QUERY = "retry policy of the host limiter"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fetched(spark, sf):
    return _t(spark, sf, "fetched_documents").select("fetch_id", "initial_url", "final_url", "host", "status", "content_length", "fetched_at").distinct()


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _fetched(spark, sf).select("fetch_id", U.normalize(F.col("initial_url")).alias("normalized"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("source_url")
    return _t(spark, sf, "chunk_vectors").select("source_url").distinct().select("source_url", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.extension(u).alias("extension"), U.syntax_error(u).alias("error"))


def url_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.dedupe(_fetched(spark, sf), "initial_url", ["fetch_id"]).select("normalized", "fetch_id")


def host_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a crawl by host."""
    x = _fetched(spark, sf).withColumn("h", U.host(F.col("initial_url")))
    return x.groupBy(F.col("h").alias("host")).agg(F.count("*").alias("pages"), F.count_if(F.col("status") < 400).alias("ok"), F.count_if(F.col("status") >= 400).alias("failed"), F.coalesce(F.sum("content_length"), F.lit(0)).alias("bytes"))


def _links(spark, sf):
    s = _t(spark, sf, "page_summaries").select("fetch_id", "page_url", "links").distinct()
    return s.select("fetch_id", "page_url", F.posexplode("links").alias("ordinal", "x")).select("fetch_id", "page_url", "ordinal", F.col("x.url").alias("url"), F.col("x.anchor").alias("anchor"))


def frontier_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all pages by the reason that keeps them out of a crawl; ``fetch`` where none does."""
    x = _links(spark, sf).withColumn("depth", F.col("ordinal") % 5)
    decided = frontier.decide(x, "url", "depth", "page_url", ["fetch_id", "ordinal"], subdomains=True, excludes=EXCLUDES)
    return decided.groupBy(F.coalesce("reason", F.lit("fetch")).alias("reason")).agg(F.count("*").alias("links"))


def path_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _fetched(spark, sf).select("fetch_id", U.path_allowed(U.path(F.col("initial_url")), INCLUDES, EXCLUDES).alias("allowed"))


def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Every page by the rules of its own host: one file for hosts of documentation, another for the rest, none for those below ``test``."""
    x = _fetched(spark, sf)
    origins = x.select(U.origin(F.col("initial_url")).alias("origin"), U.host(F.col("initial_url")).alias("h")).distinct().filter(~F.col("h").endswith(".test"))
    rules = origins.select("origin", robots.parse(F.when(F.col("h").startswith("docs."), F.lit(ROBOTS)).otherwise(F.lit(OTHER_ROBOTS))).alias("rules"))
    return frontier.admitted(x.select("fetch_id", "initial_url"), "initial_url", rules, AGENT).select("fetch_id", "allowed")


def source_class(spark: SparkSession, sf: str) -> DataFrame:
    name = U.source_class(F.col("source_url"))
    x = _t(spark, sf, "indexed_documents").select("document_id", "source_url").distinct()
    return x.select(name.alias("class"), U.source_weight(name).alias("weight")).groupBy("class", "weight").agg(F.count("*").alias("documents"))


def link_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Links within and beyond the host of their page."""
    ext = U.is_external(F.col("page_url"), F.col("url"))
    return _links(spark, sf).groupBy(ext.alias("is_external"), U.is_ignorable(F.col("url")).alias("is_ignorable")).agg(F.count("*").alias("links"))


def link_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The most relevant links of the whole crawl for a query, best first."""
    x = frontier.rank_links(_links(spark, sf).withColumn("description", F.lit(None).cast("string")), QUERY, "url", "anchor", "description")
    return x.select("fetch_id", "ordinal", "score").orderBy(F.desc("score"), "fetch_id", "ordinal").limit(50)


def crawl_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of every address within three clicks of each host's least page."""
    p = _fetched(spark, sf).select(U.normalize(F.col("final_url")).alias("url"), U.host(F.col("final_url")).alias("h")).filter("url IS NOT NULL").distinct()
    links = _links(spark, sf).select(U.normalize(F.col("page_url")).alias("url"), U.normalize(F.col("url")).alias("target")).distinct()
    seeds = p.groupBy("h").agg(F.min("url").alias("url")).select("url")
    return frontier.crawl(p, links, seeds, 3).select("url", F.col("depth").cast("int").alias("depth"), "found")


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of change between the crawl as it stood half way and at its end."""
    from pyspark.sql import Window

    from skeinlake.functions import text

    full = _t(spark, sf, "fetched_documents").select("fetch_id", "final_url", "status", "fetched_at", "received_at", "html")
    x = full.select("fetch_id", U.normalize(F.col("final_url")).alias("url"), "final_url", "status", "fetched_at", F.sha2("html", 256).alias("raw_hash"), text.page_hash(F.col("html")).alias("norm_hash")).filter("url IS NOT NULL").distinct()
    bounds = x.agg((F.min(F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 2 + F.max(F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 2).alias("mid"))
    timed = x.crossJoin(F.broadcast(bounds))  # one row
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("fetch_id"))
    last = lambda d: d.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    base = last(timed.filter(F.unix_micros(F.col("fetched_at").cast("timestamp")) <= F.col("mid")))
    return snapshots.summary(snapshots.diff(last(timed), base))


QUERIES = {f.__name__: f for f in (url_normalize, url_parts, url_dedupe, host_stats, frontier_reasons, path_filter, robots_allowed, source_class, link_targets, link_rank, crawl_bfs, snapshot_diff)}

_U = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\s*$"
_TRACK = "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','gclid','fbclid','msclkid','mc_eid','ref','ref_src','igshid','yclid'"


def _norm(u: str) -> str:
    part = lambda i: f"regexp_extract({u}, '{_U}', {i})"
    query = f"list_sort(list_filter(string_split({part(5)}, '&'), lambda p: p <> '' AND NOT list_contains([{_TRACK}], lower(string_split(p, '=')[1]))))"
    return (
        f"CASE WHEN {part(2)} = '' THEN NULL ELSE lower({part(1)}) || '://' || lower({part(2)})"
        f" || CASE WHEN {part(3)} = '' OR ({part(3)} = '80' AND lower({part(1)}) = 'http') OR ({part(3)} = '443' AND lower({part(1)}) = 'https') THEN '' ELSE ':' || {part(3)} END"
        f" || CASE WHEN {part(4)} = '' THEN '/' ELSE {part(4)} END"
        f" || CASE WHEN len({query}) = 0 THEN '' ELSE '?' || array_to_string({query}, '&') END END"
    )


_FETCHED = "(SELECT DISTINCT fetch_id, initial_url, final_url, host, status, content_length, fetched_at FROM fetched_documents)"
_HOST = lambda u: f"nullif(lower(regexp_extract({u}, '{_U}', 2)), '')"
_PATH = lambda u: f"CASE WHEN regexp_extract({u}, '{_U}', 4) = '' THEN '/' ELSE regexp_extract({u}, '{_U}', 4) END"
_LINKS = "(SELECT fetch_id, page_url, i - 1 AS ordinal, links[i].url AS url, links[i].anchor AS anchor FROM (SELECT fetch_id, page_url, links, unnest(range(1, len(links) + 1)) AS i FROM (SELECT DISTINCT fetch_id, page_url, links FROM page_summaries WHERE links IS NOT NULL)))"
_ASSETS = "jpg|jpeg|png|gif|webp|svg|ico|bmp|tiff|mp4|webm|mp3|wav|ogg|zip|rar|7z|tar|gz|woff|woff2|ttf|eot|css|js|map|pdf|docx|xlsx|pptx|exe|dmg|pkg|deb|rpm|iso"
_RANK_STOP = "'the','to','in','of','on','at','by','an','as','is','it','or','and','for','that','this','with','from','are','was','com','org','net','html','php','http','https','www'"

ORACLES = {
    "url_normalize": f"SELECT fetch_id, {_norm('initial_url')} AS normalized FROM {_FETCHED}",
    "url_parts": f"""SELECT source_url, nullif(lower(regexp_extract(source_url, '{_U}', 1)), '') AS scheme, {_HOST('source_url')} AS host,
        CASE WHEN {_HOST('source_url')} IS NOT NULL THEN {_PATH('source_url')} END AS path, lower(regexp_extract(regexp_extract(source_url, '{_U}', 4), '\\.([^./]*)$', 1)) AS extension,
        CASE WHEN source_url IS NULL OR trim(source_url) = '' THEN 'empty' WHEN NOT regexp_matches(lower(trim(source_url)), '^https?:') THEN 'scheme' WHEN {_HOST('source_url')} IS NULL THEN 'host' END AS error
        FROM (SELECT DISTINCT source_url FROM chunk_vectors)""",
    "url_dedupe": f"SELECT normalized, min(fetch_id) AS fetch_id FROM (SELECT fetch_id, {_norm('initial_url')} AS normalized FROM {_FETCHED}) WHERE normalized IS NOT NULL GROUP BY 1",
    "host_stats": f"SELECT {_HOST('initial_url')} AS host, count(*) AS pages, count(*) FILTER (status < 400) AS ok, count(*) FILTER (status >= 400) AS failed, coalesce(sum(content_length), 0)::BIGINT AS bytes FROM {_FETCHED} GROUP BY 1",
    "frontier_reasons": f"""
        WITH l AS (SELECT *, {_HOST('url')} AS h, {_HOST('page_url')} AS s, {_PATH('url')} AS p, {_norm('url')} AS n FROM {_LINKS}),
        r AS (SELECT *, CASE WHEN url IS NULL OR NOT regexp_matches(lower(trim(url)), '^https?:') OR h IS NULL THEN 'scheme' WHEN ordinal % 5 > 3 THEN 'depth'
            WHEN regexp_matches(h, '^(localhost|local|instance-data)$|\\.(localhost|local|internal)$|^(10|127|0)\\.\\d+\\.\\d+\\.\\d+$|^192\\.168\\.\\d+\\.\\d+$') THEN 'blocked_host'
            WHEN regexp_matches(lower(p), '\\.({_ASSETS})$') THEN 'static_asset' WHEN NOT coalesce(h = s OR h LIKE '%.' || s, false) THEN 'domain'
            WHEN regexp_matches(p, '^/blog/k[^/]*$|^/help/.*$') THEN 'path' END AS reason FROM l),
        d AS (SELECT coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY n, reason IS NULL ORDER BY fetch_id, ordinal) > 1 THEN 'duplicate' END, 'fetch') AS reason FROM r)
        SELECT reason, count(*) AS links FROM d GROUP BY 1""",
    "path_filter": f"SELECT fetch_id, regexp_matches({_PATH('initial_url')}, '^/docs/.*$|^/guide/.*$|^/blog/[^/]*$') AND NOT regexp_matches({_PATH('initial_url')}, '^/blog/k[^/]*$|^/help/.*$') AS allowed FROM {_FETCHED}",
    "robots_allowed": f"""WITH x AS (SELECT fetch_id, {_HOST('initial_url')} AS h, {_PATH('initial_url')} AS p FROM {_FETCHED})
        SELECT fetch_id, CASE WHEN h IS NULL OR h LIKE '%.test' THEN true WHEN h LIKE 'docs.%' THEN NOT starts_with(p, '/blog/') OR starts_with(p, '/blog/k') ELSE NOT starts_with(p, '/guide') AND (NOT starts_with(p, '/docs/') OR starts_with(p, '/docs/b')) END AS allowed FROM x""",
    "source_class": f"""
        SELECT class, CASE class WHEN 'documentation' THEN 0.9 WHEN 'primary' THEN 0.95 ELSE 0.4 END::DOUBLE AS weight, count(*) AS documents FROM (
          SELECT CASE WHEN {_HOST('source_url')} IS NULL THEN 'unknown' WHEN regexp_matches({_HOST('source_url')}, '^docs\\.|^developer\\.') OR regexp_matches(lower({_PATH('source_url')}), '^/(doc|documentation|guide|api|reference)') THEN 'documentation' ELSE 'primary' END AS class
          FROM (SELECT DISTINCT document_id, source_url FROM indexed_documents)) GROUP BY 1""",
    "link_targets": f"""SELECT NOT coalesce({_HOST('page_url')} = {_HOST('url')}, false) AS is_external, regexp_matches(lower(trim(url)), '^(javascript|mailto|tel|data|sms|callto|fax|magnet):') OR trim(url) = '#' AS is_ignorable, count(*) AS links FROM {_LINKS} GROUP BY 1, 2""",
    "link_rank": f"""
        WITH q AS (SELECT unnest(['retry', 'policy', 'host', 'limiter']) AS q),
        l AS (SELECT fetch_id, ordinal, list_filter(string_split_regex(lower(coalesce(anchor, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2 AND NOT list_contains([{_RANK_STOP}], w)) AS t,
              CASE WHEN {_HOST('url')} IS NULL THEN [] ELSE list_filter(string_split_regex(lower({_PATH('url')}), '[/\\-_.]'), lambda w: strlen(w) >= 2 AND NOT list_contains([{_RANK_STOP}, 'htm', 'asp', 'aspx', 'jsp', 'pdf', 'json'], w)) END AS p FROM {_LINKS}),
        s AS (SELECT fetch_id, ordinal, sum(CASE WHEN list_contains(t, q) THEN 4.0 WHEN len(list_filter(t, lambda x: contains(x, q) OR contains(q, x))) > 0 THEN 2.0 ELSE 0 END
              + CASE WHEN list_contains(p, q) THEN 2.5 WHEN len(list_filter(p, lambda x: contains(x, q))) > 0 THEN 1.2 ELSE 0 END) / 30.0 AS v FROM l, q GROUP BY ALL)
        SELECT fetch_id, ordinal::INT AS ordinal, round(least(0.99, greatest(0.01, v)), 2)::DOUBLE AS score FROM s ORDER BY score DESC, fetch_id, ordinal LIMIT 50""",
    "crawl_bfs": f"""
        WITH RECURSIVE p AS (SELECT DISTINCT {_norm('final_url')} AS url, {_HOST('final_url')} AS h FROM {_FETCHED}),
        e AS (SELECT DISTINCT {_norm('page_url')} AS url, {_norm('url')} AS target FROM {_LINKS} WHERE {_norm('url')} IS NOT NULL),
        b(url, depth) AS (SELECT min(url), 0 FROM p WHERE url IS NOT NULL GROUP BY h UNION SELECT e.target, depth + 1 FROM b JOIN e ON e.url = b.url JOIN p ON p.url = b.url WHERE depth < 3)
        SELECT url, min(depth)::INT AS depth, url IN (SELECT url FROM p WHERE url IS NOT NULL) AS found FROM b WHERE url IS NOT NULL GROUP BY url""",
    "snapshot_diff": f"""
        WITH x AS (SELECT DISTINCT fetch_id, {_norm('final_url')} AS url, final_url, status, fetched_at, epoch_us(fetched_at) AS t, sha256(html) AS raw,
          sha256(array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda l: regexp_replace(l, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda l: l <> ''), chr(10))) AS norm FROM fetched_documents),
        u AS (SELECT * FROM x WHERE url IS NOT NULL), m AS (SELECT min(t) / 2 + max(t) / 2 AS mid FROM u),
        n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) AS rn FROM u),
        o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) AS rn FROM u, m WHERE t <= mid),
        j AS (SELECT a.url AS au, b.url AS bu, a.status, a.final_url AS af, b.final_url AS bf, coalesce(a.raw = b.raw, false) OR coalesce(a.norm = b.norm, false) AS same FROM (SELECT * FROM n WHERE rn = 1) a FULL JOIN (SELECT * FROM o WHERE rn = 1) b ON a.url = b.url)
        SELECT CASE WHEN au IS NULL THEN 'deleted' WHEN bu IS NULL THEN 'new' WHEN status = 304 THEN 'unchanged' WHEN status IN (404, 410) THEN 'deleted' WHEN status >= 400 THEN 'unknown' WHEN af IS DISTINCT FROM bf THEN 'redirected' WHEN same THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS pages FROM j GROUP BY 1""",
}
