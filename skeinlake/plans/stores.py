"""Queries of the stored index, site discovery, evidence, caching and schema extraction, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.functions import url as U
from skeinlake.operators import discovery, evidence, extraction, storage
from skeinlake.operators.index import InvertedIndex
from skeinlake.plans import search, urls
from skeinlake.plans.texts import _WS, _tokens, _trim
from skeinlake.plans.urls import _HOST, _LINKS, _PATH, _norm

SCHEMA = {"type": "object", "required": ["section"], "properties": {"section": {"type": "string"}, "char_start": {"type": "integer"}, "language": {"type": "string"}}}
SITE_QUERY = "index guide"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _grown_index(spark: SparkSession, sf: str) -> InvertedIndex:
    """Two segments, of which documents without an address are deleted again."""
    c = search.chunks(spark, sf)
    index = InvertedIndex(spark, storage.shared_dir(spark), "chunk_id", "document_id", search._fields(), buckets=16)
    index.add(c.filter("tenant_id IS NULL"))
    index.add(c.filter("tenant_id IS NOT NULL"))
    index.delete(c.filter("source_url IS NULL").select("document_id"))
    return index


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    return _grown_index(spark, sf).search("retry policy limiter", 50)


def index_size(spark: SparkSession, sf: str) -> DataFrame:
    return _grown_index(spark, sf).stats()


def chunk_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each document that an index of the others' tenants already holds."""
    c = search.chunks(spark, sf)
    index = InvertedIndex(spark, storage.shared_dir(spark), "chunk_id", "document_id", search._fields(), buckets=16)
    index.add(c.filter("tenant_id IS NOT NULL"))
    return index.reused(c)


def _sitemap_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sitemaps written from the pages of each host: an index, and two files that list the pages; one host's files failed."""
    p = _t(spark, sf, "fetched_documents").select("host", "final_url", "fetch_id").filter("host IS NOT NULL AND final_url IS NOT NULL").distinct()
    part = p.select("host", "final_url", (F.col("fetch_id") % 2).alias("part"))
    base = F.concat(F.lit("https://"), F.col("host"))
    loc = lambda c: F.concat(F.lit("<url><loc>"), c, F.lit("</loc></url>"))
    files = part.groupBy("host", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_set(loc(F.col("final_url"))), ""), F.lit("</urlset>")).alias("xml")).select(F.concat(base, F.lit("/sitemap-"), F.col("part"), F.lit(".xml")).alias("url"), "host", "xml")
    index = files.groupBy("host").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_set(F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.concat(base, F.lit("/sitemap.xml")).alias("url"), "host", "xml")
    status = F.when(F.col("host").startswith("docs."), F.lit(404)).otherwise(F.lit(200))
    documents = files.unionByName(index).select("url", status.alias("status"), "xml")
    seeds = p.select(F.concat(base, F.lit("/")).alias("seed"), F.lit(None).cast("string").alias("sitemap")).distinct()
    return seeds, documents


def sitemap_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.sitemaps(*_sitemap_documents(spark, sf))


def site_map(spark: SparkSession, sf: str) -> DataFrame:
    """The map of the busiest site for a query: links of all pages and its own pages, named by page or anchor."""
    s = _t(spark, sf, "page_summaries").select("page_url", "title", "description", "links")
    host = s.groupBy(U.host(F.col("page_url")).alias("h")).count().filter("h IS NOT NULL").orderBy(F.desc("count"), "h").first()["h"]
    links = s.select(F.explode("links").alias("x")).select("x.url", F.col("x.anchor").alias("title")).unionByName(s.select(F.col("page_url").alias("url"), F.lit(None).cast("string").alias("title")))
    return discovery.site_map(links, s.select(F.col("page_url").alias("url"), "title", "description"), host, SITE_QUERY, excludes=["/admin/**"], limit=200)


def crawl_counters(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "fetched_documents").select("fetch_id", "host", "status", "initial_url", "final_url", "content_type", "content_length", "fetch_time_ms", "warnings").distinct()
    return discovery.crawl_counters(x, ["host"])


def blocked_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all pages by whether a browser must not request them, as if each were an image."""
    bad = discovery.blocks_request(F.col("url"), F.lit("Image"), [])
    return urls._links(spark, sf).groupBy(bad.alias("blocked"), discovery.is_tracker(F.col("url")).alias("tracker")).agg(F.count("*").alias("links"))


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """Local search over the indexed documents, each address once, without hosts of documentation."""
    from skeinlake.operators import retrieval as R

    x = _t(spark, sf, "indexed_documents").select("document_id", "source_url", "text").dropDuplicates(["document_id"])
    hits = R.local_search(x, "document_id", F.coalesce("text", F.lit("")), "retry policy limiter", None).join(x.select("document_id", "source_url"), "document_id")
    return discovery.search_results(hits, "source_url", "score", "document_id", exclude=["docs."], limit=50).select("document_id", "score", "normalized")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "content_chunks").select("id", "source_url", "heading_path", "content", "content_type", "score")
    return evidence.store(x, "content", "source_url", "score", ["id"])


def evidence_top(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.top(_evidence(spark, sf), "id", 50).select("id", "class", "weighted")


def evidence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "chunk_vectors").select("document_id", "source_url", "metadata")
    return evidence.gaps(x, "document_id", "source_url", F.json_object_keys("metadata"), ["section", "char_start", "language"]).withColumn("missing", F.array_join("missing", ","))


def evidence_report(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.report(_evidence(spark, sf), "content_type", "id", "id")


def context_packing(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "content_chunks").select("id", "content_type", "content", F.col("score").cast("double").alias("score")).dropDuplicates(["id"])
    return evidence.pack_bytes(x, "content_type", "score", "id", "content", 20_000, 30).select("content_type", "id", "position", "used")


def cache_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What a cache of one week by site and path depth would have answered."""
    x = _t(spark, sf, "fetched_documents").select("fetch_id", "host", "fetched_at").distinct()
    return evidence.cache_outcomes(x, "fetch_id", "host", "fetched_at", 0).groupBy("outcome").agg(F.count("*").alias("requests"))


def schema_values(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of a schema from the chunks' metadata, missing ones named; required ones are errors."""
    x = _t(spark, sf, "chunk_vectors").select("chunk_id", "metadata").dropDuplicates(["chunk_id"])
    values = extraction.by_schema(extraction.json_member_candidates(x, "chunk_id", "metadata"), SCHEMA)
    return extraction.with_missing(values, x.select("chunk_id"), SCHEMA, "error").select(F.col("id").alias("chunk_id"), "property", "value", "confidence", "error")


def metadata_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """The first array of each chunk's document metadata."""
    x = _t(spark, sf, "chunk_vectors").select("chunk_id", "document_metadata").dropDuplicates(["chunk_id"])
    a = extraction.array_values(extraction.json_member_candidates(x, "chunk_id", "document_metadata"))
    return a.select(F.col("id").alias("chunk_id"), F.array_join(F.from_json("value", "array<string>"), ",").alias("items"))


def repaired_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Errors left once the metadata is repaired against the schema."""
    x = _t(spark, sf, "chunk_vectors").select("chunk_id", "metadata").dropDuplicates(["chunk_id"])
    return extraction.repaired(x, "chunk_id", "metadata", SCHEMA).select("chunk_id", F.array_join("errors", "; ").alias("errors"))


QUERIES = {
    f.__name__: f
    for f in (
        index_search, index_size, chunk_reuse, sitemap_discovery, site_map, crawl_counters, blocked_requests, search_results, evidence_top, evidence_gaps, evidence_report, context_packing, cache_outcomes,
        schema_values, metadata_arrays, repaired_metadata,
    )
}

_LIVE = "document_id NOT IN (SELECT document_id FROM chunk_vectors WHERE source_url IS NULL)"
_HASH = lambda t: f"sha256(regexp_replace({_trim(t)}, '{_WS}', ' ', 'g'))"
_CLASS = lambda u: f"CASE WHEN {_HOST(u)} IS NULL THEN 'unknown' WHEN regexp_matches({_HOST(u)}, '^docs\\.|^developer\\.') OR regexp_matches(lower({_PATH(u)}), '^/(doc|documentation|guide|api|reference)') THEN 'documentation' ELSE 'primary' END"
_EVIDENCE = f"""
    p AS (SELECT DISTINCT id, source_url, content, content_type, score, {_HASH('content')} AS h FROM content_chunks WHERE regexp_matches(content, '[^\\s\\p{{Z}}]')),
    o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY id) AS rn FROM p),
    e AS (SELECT id, content_type, class, round(coalesce(score::DOUBLE, 0) * CASE class WHEN 'documentation' THEN 0.9 WHEN 'primary' THEN 0.95 ELSE 0.4 END, 6)::DOUBLE AS weighted FROM (SELECT *, {_CLASS('source_url')} AS class FROM o WHERE rn = 1))"""
_BUSY = "(SELECT h FROM (SELECT {h} AS h, count(*) AS n FROM page_summaries GROUP BY 1) WHERE h IS NOT NULL ORDER BY n DESC, h LIMIT 1)".replace("{h}", _HOST("page_url"))

ORACLES = {
    "index_search": search._bm25_sql("retry policy limiter", 50, where=_LIVE),
    "index_size": f"""SELECT count(*) AS chunks, sum(greatest(len({_tokens("coalesce(title, '')")}) + len({_tokens("heading")}) + len({_tokens("coalesce(text, '')")}), 1))::BIGINT AS tokens FROM {search._CHUNKS} WHERE {_LIVE}""",
    "chunk_reuse": f"""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, tenant_id, {_HASH('text')} AS h FROM chunk_vectors)
        SELECT document_id, count(*) AS chunks, count(*) FILTER (EXISTS (SELECT 1 FROM c o WHERE o.tenant_id IS NOT NULL AND o.document_id = c.document_id AND o.h = c.h)) AS reused FROM c WHERE document_id IS NOT NULL GROUP BY 1""",
    "sitemap_discovery": "SELECT DISTINCT 'https://' || host || '/' AS seed, final_url AS url, 2::INT AS level FROM fetched_documents WHERE host IS NOT NULL AND final_url IS NOT NULL AND NOT starts_with(host, 'docs.')",
    "site_map": f"""
        WITH l AS (SELECT url, anchor AS title FROM {_LINKS} UNION ALL SELECT page_url, NULL FROM page_summaries),
        n AS (SELECT {_norm('url')} AS url, title FROM l), b AS (SELECT {_BUSY} AS base),
        k AS (SELECT url, min(title) AS anchor FROM n, b WHERE url IS NOT NULL AND ({_HOST('url')} = base OR ends_with({_HOST('url')}, '.' || base)) AND NOT regexp_matches(lower({_PATH('url')}), '\\.({urls._ASSETS})$') AND NOT regexp_matches({_PATH('url')}, '^/admin/.*$') GROUP BY 1),
        t AS (SELECT {_norm('page_url')} AS url, min(title) AS title, min(description) AS description FROM page_summaries GROUP BY 1),
        m AS (SELECT k.url, coalesce(t.title, k.anchor) AS title, t.description FROM k LEFT JOIN t ON k.url = t.url),
        q AS (SELECT unnest(['index', 'guide']) AS q),
        w AS (SELECT url, title, list_filter(string_split_regex(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2 AND NOT list_contains([{urls._RANK_STOP}], w)) AS t,
              list_filter(string_split_regex(lower({_PATH('url')}), '[/\\-_.]'), lambda w: strlen(w) >= 2 AND NOT list_contains([{urls._RANK_STOP}, 'htm', 'asp', 'aspx', 'jsp', 'pdf', 'json'], w)) AS p,
              list_filter(string_split_regex(lower(coalesce(description, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2 AND NOT list_contains([{urls._RANK_STOP}], w)) AS d FROM m),
        s AS (SELECT url, title, sum(CASE WHEN list_contains(t, q) THEN 4.0 WHEN len(list_filter(t, lambda x: contains(x, q) OR contains(q, x))) > 0 THEN 2.0 ELSE 0 END
              + CASE WHEN list_contains(p, q) THEN 2.5 WHEN len(list_filter(p, lambda x: contains(x, q))) > 0 THEN 1.2 ELSE 0 END
              + CASE WHEN list_contains(d, q) THEN 1.0 WHEN len(list_filter(d, lambda x: contains(x, q))) > 0 THEN 0.5 ELSE 0 END) / 15.0 AS v FROM w, q GROUP BY ALL)
        SELECT url, title, round(least(0.99, greatest(0.01, v)), 2)::DOUBLE AS score FROM s ORDER BY score DESC, url LIMIT 200""",
    "crawl_counters": """
        WITH f AS (SELECT DISTINCT fetch_id, host, status, initial_url, final_url, content_type, content_length, fetch_time_ms, warnings FROM fetched_documents)
        SELECT host, count(*) AS pages, count(*) FILTER (status BETWEEN 200 AND 299) AS completed, count(*) FILTER (NOT status BETWEEN 200 AND 299) AS failed, count(*) FILTER (status = 403) AS blocked, count(*) FILTER (status IN (404, 410)) AS missing,
        count(*) FILTER (status = 429) AS limited, count(*) FILTER (status >= 500) AS server_errors, count(*) FILTER (initial_url IS DISTINCT FROM final_url) AS redirected, count(*) FILTER (contains(lower(content_type), 'html')) AS html, count(*) FILTER (content_type IS NULL) AS untyped,
        count(*) FILTER (len(warnings) > 0) AS warned, coalesce(sum(content_length), 0)::BIGINT AS bytes, max(fetch_time_ms) AS slowest_ms, count(DISTINCT final_url) AS addresses FROM f GROUP BY 1""",
    "blocked_requests": f"""
        WITH l AS (SELECT url, coalesce(regexp_matches(lower(url), '{"|".join(t.replace(".", "[.]") for t in discovery.TRACKERS)}'), false) AS tracker, {_HOST('url')} AS h FROM {_LINKS})
        SELECT tracker OR coalesce(regexp_matches(h, '^(localhost|local|instance-data)$|\\.(localhost|local|internal)$|^(10|127|0)\\.\\d+\\.\\d+\\.\\d+$|^192\\.168\\.\\d+\\.\\d+$'), false) OR url IS NULL OR NOT regexp_matches(lower(trim(url)), '^https?:') OR h IS NULL AS blocked, tracker, count(*) AS links FROM l GROUP BY ALL""",
    "search_results": f"""
        WITH x AS (SELECT DISTINCT ON (document_id) document_id, source_url, {_tokens("coalesce(text, '')")} AS t FROM indexed_documents),
        r AS (SELECT document_id, {_norm('source_url')} AS normalized, {_HOST('source_url')} AS h, len(list_filter(['limiter', 'policy', 'retry'], lambda q: list_contains(t, q))) AS raw FROM x),
        s AS (SELECT document_id, normalized, round(least(0.99, greatest(0.1, raw / 6.0)), 2)::DOUBLE AS score FROM r WHERE raw > 0 AND normalized IS NOT NULL AND NOT contains(h, 'docs.')),
        k AS (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY score DESC, document_id) AS rn FROM s)
        SELECT document_id, score, normalized FROM k WHERE rn = 1 ORDER BY score DESC, document_id LIMIT 50""",
    "evidence_top": f"WITH {_EVIDENCE} SELECT id, class, weighted FROM e ORDER BY weighted DESC, id LIMIT 50",
    "evidence_gaps": f"""
        WITH d AS (SELECT document_id, count(DISTINCT {_HOST('source_url')}) AS sources, list_distinct(flatten(list(coalesce(json_keys(metadata), [])))) AS have FROM chunk_vectors GROUP BY 1),
        g AS (SELECT *, array_to_string(list_sort(list_filter(['section', 'char_start', 'language'], lambda f: NOT list_contains(have, f))), ',') AS missing FROM d)
        SELECT document_id, sources, missing, sources >= 2 AS diverse, sources >= 2 AND missing = '' AS complete FROM g""",
    "evidence_report": f"""
        WITH {_EVIDENCE}, n AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY weighted DESC, id) AS no FROM e)
        SELECT content_type, string_agg('- ' || id || ' [E' || no || ']', chr(10) ORDER BY no) AS report, count(*) AS claims, CASE WHEN count(*) >= 3 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM n WHERE no <= 5 GROUP BY 1""",
    "context_packing": """
        WITH x AS (SELECT DISTINCT ON (id) id, content_type, coalesce(strlen(content), 0) AS n, score::DOUBLE AS score FROM content_chunks),
        r AS (SELECT *, row_number() OVER w AS position, sum(n) OVER w AS running FROM x WINDOW w AS (PARTITION BY content_type ORDER BY score DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING))
        SELECT content_type, id, position, least(running, 20000)::BIGINT AS used FROM r WHERE position <= 30 AND (running <= 20000 OR position = 1)""",
    "cache_outcomes": """WITH x AS (SELECT DISTINCT fetch_id, host, fetched_at FROM fetched_documents WHERE host IS NOT NULL AND fetched_at IS NOT NULL),
        r AS (SELECT row_number() OVER (PARTITION BY host ORDER BY fetched_at, fetch_id) AS n FROM x) SELECT CASE WHEN n = 1 THEN 'miss' ELSE 'hit' END AS outcome, count(*) AS requests FROM r GROUP BY 1""",
    "schema_values": """
        WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, metadata FROM chunk_vectors), p(property) AS (VALUES ('section'), ('char_start'), ('language')),
        v AS (SELECT chunk_id, property, json_extract(metadata, '$.' || property)::VARCHAR AS value FROM c, p)
        SELECT chunk_id, property, value, CASE WHEN value IS NULL THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence, CASE WHEN value IS NULL AND property = 'section' THEN 'missing section' END AS error FROM v""",
    "metadata_arrays": "SELECT DISTINCT chunk_id, array_to_string(json_extract_string(document_metadata, '$.tags[*]'), ',') AS items FROM chunk_vectors WHERE json_type(document_metadata, '$.tags') = 'ARRAY'",
    "repaired_metadata": "SELECT DISTINCT chunk_id, CASE WHEN json_extract(metadata, '$.section') IS NULL THEN '$.section: required' ELSE '' END AS errors FROM chunk_vectors",
}
