"""Queries of the retrieval operators over the chunk table, and of page and event operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skeinlake.functions import text as T
from skeinlake.operators import pages, retrieval as R
from skeinlake.operators.index import InvertedIndex
from skeinlake.operators.storage import shared_dir
from skeinlake.sources.providers import MockEmbedder
from skeinlake.streaming import streams

QUERY = "retry policy of the host limiter"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One row per chunk with what retrieval needs of it; columns that a query does not use are never read."""
    x = _t(spark, sf, "chunk_vectors").select("chunk_id", "document_id", "index_id", "tenant_id", "source_url", "title", "heading_path", "text", "embedding")
    return x.dropDuplicates(["chunk_id"])


def _fields():
    return {"title": F.col("title"), "heading": F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " "), "body": F.col("text")}


def _query_vector(dim: int = 64) -> list[float]:
    return [float(x) for x in MockEmbedder(dim).embed([QUERY])[0]]


_indexes: dict[tuple[str, str], InvertedIndex] = {}


def chunk_index(spark: SparkSession, sf: str) -> InvertedIndex:
    """The stored index of the chunks of one folder: written by the first query of a session that needs it, read by the others."""
    at = (spark.sparkContext.applicationId, sf)
    index = _indexes.get(at)
    if index is None or index._read("stats") is None:
        index = InvertedIndex(spark, shared_dir(spark), "chunk_id", "document_id", _fields(), ["source_url", "tenant_id"], buckets=16)
        index.add(chunks(spark, sf))
        _indexes[at] = index
    return index


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_index(spark, sf).search(QUERY, 50)


def bm25_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same without an index: one pass over the texts of a table that is asked once."""
    return R.bm25(chunks(spark, sf), "chunk_id", _fields(), QUERY, limit=50)


def bm25_tenant(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical search within the shared chunks, those of no tenant, on hosts of documentation; statistics stay those of the whole index."""
    ok = F.col("tenant_id").isNull() & F.coalesce(F.col("source_url").rlike(r"(?i)^https?://(?:www\.)?docs\."), F.lit(False))
    return chunk_index(spark, sf).search("table extractor", 20, ok)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.knn(_t(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(), limit=50)


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return R.knn(chunks(spark, sf), "chunk_id", "embedding", _query_vector(), limit=50, min_score=0.5)


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and lexical results fused by reciprocal rank, at most three chunks a document, packed into a token budget."""
    c = chunks(spark, sf)
    fused = R.rrf(R.knn(c, "chunk_id", "embedding", _query_vector(), 40), chunk_index(spark, sf).search(QUERY, 40), "chunk_id")
    facts = c.select("chunk_id", "document_id", T.approx_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    kept = R.diversify(fused.join(facts, "chunk_id"), "document_id", "rrf", "chunk_id", 3, 20)
    return R.pack(kept, "rrf", "chunk_id", "tokens", budget=4000).select("position", "chunk_id", "document_id", "vector_rank", "lexical_rank", "rrf", "tokens")


def expanded(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a question and of its variants, each chunk as the first variant saw it."""
    out = None
    for i, q in enumerate(T.expand_query("How does the retry policy work")):
        x = chunk_index(spark, sf).search(q, 20).withColumn("variant", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return R.first_seen(out, "chunk_id", ["variant"]).select("chunk_id", "score", "variant")


def local_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.local_search(_t(spark, sf, "documents"), "doc_id", F.coalesce("text", F.lit("")), "retry policy limiter", 50)


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    """True counts of each index beside its stale ones."""
    c = _t(spark, sf, "chunk_vectors").select("index_id", "document_id", "chunk_id", "text").dropDuplicates(["chunk_id"])
    s = c.groupBy("index_id").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.sum(T.approx_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    return _t(spark, sf, "search_indexes").select(F.col("id").alias("index_id"), "name", F.col("chunk_count").alias("stale_chunks")).join(s, "index_id", "left").select("index_id", "name", "stale_chunks", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk ids in brackets, checked against the chunks; answers are made of the chunks' own ids."""
    x = _t(spark, sf, "chunk_vectors").select("chunk_id", "document_id").distinct()
    answers = x.groupBy("document_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_set("chunk_id")), lambda i: F.concat(F.lit("as said ["), i, F.lit("] and [chk_gone]")))).alias("answer"))
    cited = answers.select("document_id", F.explode(R.citations(F.col("answer"))).alias("cited"))
    return cited.join(x.select(F.col("chunk_id").alias("cited"), F.lit(True).alias("known")), "cited", "left").groupBy("document_id").agg(F.count_if("known").alias("valid"), F.count_if(F.col("known").isNull()).alias("invented"))


def _pages(spark, sf):
    return _t(spark, sf, "fetched_documents").select("fetch_id", "final_url", "content_type", "html").dropDuplicates(["fetch_id"])


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_features(_pages(spark, sf), "fetch_id", "final_url", "html", ["title", "description", "language"])


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.link_edges(_pages(spark, sf), "fetch_id", "final_url", "html")


def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_features(_pages(spark, sf), "fetch_id", "final_url", "html", ["markdown"])


def page_clean(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_features(_pages(spark, sf), "fetch_id", "final_url", "html", ["clean_html"])


def page_outline(spark: SparkSession, sf: str) -> DataFrame:
    x = pages.page_features(_pages(spark, sf), "fetch_id", "final_url", "html", ["headings", "images", "definitions", "json_ld"])
    return x.select("fetch_id", F.size("headings").alias("headings"), F.size("images").alias("images"), F.size("definitions").alias("definitions"), F.size("json_ld").alias("json_ld"))


def content_types(spark: SparkSession, sf: str) -> DataFrame:
    return pages.content_types(_pages(spark, sf), "fetch_id", "final_url", "content_type", "html")


def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    x = pages.parsed_documents(_pages(spark, sf), "fetch_id", "final_url", "content_type", "html")
    return x.select("fetch_id", "document_type", "title", F.char_length("text").alias("chars"), F.size("links").alias("links"))


def render_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return pages.render_decisions(_pages(spark, sf), "fetch_id", "html").drop("frameworks")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.event_counts(_t(spark, sf, "events"), "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = streams.sessions(_t(spark, sf, "events"), "ts", "user_id", "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def latest_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """The last fetch of each address: the upsert view of an append-only table."""
    from skeinlake.functions import url as U
    from skeinlake.operators.storage import latest

    x = _t(spark, sf, "fetched_documents").select(U.normalize(F.col("final_url")).alias("url"), "fetch_id", "fetched_at").filter("url IS NOT NULL")
    return latest(x, ["url"], [F.desc("fetched_at"), F.desc("fetch_id")]).select("url", "fetch_id")


def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred of a queue by priority, then time, then id."""
    x = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    w = Window.orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    top = x.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100)
    return top.select(F.row_number().over(w).cast("long").alias("position"), "o_orderkey")


def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("tasks"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scan, bm25_tenant, vector_topk, vector_chunks, hybrid, expanded, local_search, index_stats, citations, page_titles, page_links, page_markdown, page_clean, page_outline, content_types, parsed_pages, render_decisions,
        event_windows, event_sessions, latest_fetches, priority_queue, queue_stats,
    )
}

from skeinlake.plans.texts import _tokens  # noqa: E402
from skeinlake.plans.urls import _norm  # noqa: E402

_CHUNKS = "(SELECT chunk_id, any_value(document_id) AS document_id, any_value(source_url) AS source_url, any_value(tenant_id) AS tenant_id, any_value(title) AS title, any_value(array_to_string(coalesce(heading_path, []), ' ')) AS heading, any_value(text) AS text, any_value(embedding::DOUBLE[]) AS embedding FROM chunk_vectors GROUP BY chunk_id)"


def _bm25_sql(query: str, limit: int, ok: str = "true", where: str = "true") -> str:
    tokens = R.query_tokens(query)
    values = ", ".join(f"('{t}', {tokens.count(t)})" for t in sorted(set(tokens)))
    return f"""
        WITH c AS (SELECT * FROM {_CHUNKS} WHERE {where}),
        f AS (SELECT chunk_id, {_tokens("coalesce(title, '')")} AS a, {_tokens("heading")} AS b, {_tokens("coalesce(text, '')")} AS d, contains(lower(text), '{query.lower()}') AS phrase, {ok} AS ok FROM c),
        q(t, m) AS (VALUES {values}),
        w AS (SELECT chunk_id, phrase, ok, greatest(len(a) + len(b) + len(d), 1)::DOUBLE AS dl, t, m, 3.0 * len(list_filter(a, lambda x: x = t)) + 2.0 * len(list_filter(b, lambda x: x = t)) + len(list_filter(d, lambda x: x = t)) AS w FROM f, q),
        s AS (SELECT count(DISTINCT chunk_id) AS n, avg(dl) AS avgdl FROM w), df AS (SELECT t, count(*) FILTER (w > 0) AS df FROM w GROUP BY t),
        r AS (SELECT chunk_id, any_value(coalesce(phrase, false)) AS phrase, sum(m * greatest(0.1, ln((n - df + 0.5) / (df + 0.5) + 1)) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM w JOIN df USING (t), s WHERE ok AND w > 0 GROUP BY chunk_id)
        SELECT chunk_id, round(CASE WHEN phrase THEN score * 1.5 ELSE score END, 6)::DOUBLE AS score FROM r ORDER BY score DESC, chunk_id LIMIT {limit}"""


def _knn_sql(source: str, key: str, limit: int, least: float = 0.0) -> str:
    q = "[" + ", ".join(repr(x) for x in _query_vector()) + "]::DOUBLE[]"
    return f"""SELECT {key}, round(greatest(0.0, least(1.0, (CASE WHEN list_dot_product(embedding, embedding) = 0 THEN 0 ELSE list_cosine_similarity(embedding, {q}) END + 1) / 2)), 6)::DOUBLE AS score
        FROM {source} WHERE len(embedding) = 64 AND (CASE WHEN list_dot_product(embedding, embedding) = 0 THEN 0 ELSE list_cosine_similarity(embedding, {q}) END + 1) / 2 >= {least} ORDER BY score DESC, {key} LIMIT {limit}"""


_VARIANTS = T.expand_query("How does the retry policy work")  # two, so that the second adds what the first has not seen

ORACLES = {
    "bm25_topk": _bm25_sql(QUERY, 50),
    "bm25_scan": _bm25_sql(QUERY, 50),
    "expanded": " UNION ALL ".join(
        [f"SELECT *, 0::INT AS variant FROM ({_bm25_sql(_VARIANTS[0], 20)})", *(f"SELECT *, {i}::INT FROM ({_bm25_sql(v, 20)}) WHERE chunk_id NOT IN (SELECT chunk_id FROM ({_bm25_sql(_VARIANTS[0], 20)}))" for i, v in enumerate(_VARIANTS) if i)]
    ),
    "bm25_tenant": _bm25_sql("table extractor", 20, "tenant_id IS NULL AND coalesce(regexp_matches(source_url, '(?i)^https?://(?:www\\.)?docs\\.'), false)"),
    "vector_topk": _knn_sql("(SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)", "vec_id", 50),
    "vector_chunks": _knn_sql(f"(SELECT * FROM {_CHUNKS} WHERE embedding IS NOT NULL)", "chunk_id", 50, 0.5),
    "hybrid": f"""
        WITH v AS ({_knn_sql(f"(SELECT * FROM {_CHUNKS} WHERE embedding IS NOT NULL)", "chunk_id", 40)}), l AS (SELECT * FROM ({_bm25_sql(QUERY, 40)})),
        vr AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS vector_rank FROM v), lr AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS lexical_rank FROM l),
        u AS (SELECT chunk_id, vector_rank, lexical_rank, round(coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0), 9)::DOUBLE AS rrf FROM vr FULL JOIN lr USING (chunk_id)),
        t AS (SELECT chunk_id, document_id, coalesce(text, '') AS x FROM {_CHUNKS}),
        m AS (SELECT u.*, document_id, CASE WHEN x = '' THEN 0 WHEN len(list_filter(string_split_regex(x, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) = 0 THEN 1 ELSE (ceil(length(x) / 4.0) + ceil(len(list_filter(string_split_regex(x, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) * 4 / 3.0))::BIGINT // 2 END::BIGINT AS tokens FROM u JOIN t USING (chunk_id)),
        d AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rrf DESC, chunk_id) AS rn FROM m),
        k AS (SELECT * FROM d WHERE rn <= 3 ORDER BY rrf DESC, chunk_id LIMIT 20),
        p AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, chunk_id) AS position, sum(tokens) OVER (ORDER BY rrf DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS running FROM k)
        SELECT position, chunk_id, document_id, vector_rank, lexical_rank, rrf, tokens FROM p WHERE running <= 4000 OR position = 1""",
    "local_search": f"""
        WITH d AS (SELECT doc_id, {_tokens("coalesce(text, '')")} AS t FROM documents),
        r AS (SELECT doc_id, len(list_filter(['limiter', 'policy', 'retry'], lambda q: list_contains(t, q))) AS raw FROM d)
        SELECT doc_id, round(least(0.99, greatest(0.1, raw / 6.0)), 2)::DOUBLE AS score FROM r WHERE raw > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    "index_stats": """
        WITH c AS (SELECT chunk_id, any_value(index_id) AS index_id, any_value(document_id) AS document_id, any_value(coalesce(text, '')) AS x FROM chunk_vectors GROUP BY 1),
        s AS (SELECT index_id, count(DISTINCT document_id) AS documents, count(*) AS chunks, sum(CASE WHEN x = '' THEN 0 WHEN len(list_filter(string_split_regex(x, '[\\s\\p{Z}]+'), lambda w: w <> '')) = 0 THEN 1 ELSE (ceil(length(x) / 4.0) + ceil(len(list_filter(string_split_regex(x, '[\\s\\p{Z}]+'), lambda w: w <> '')) * 4 / 3.0))::BIGINT // 2 END)::BIGINT AS tokens FROM c GROUP BY 1)
        SELECT id AS index_id, name, chunk_count AS stale_chunks, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks, coalesce(tokens, 0)::BIGINT AS tokens FROM search_indexes LEFT JOIN s ON id = s.index_id""",
    "citations": "SELECT document_id, count(DISTINCT chunk_id) AS valid, 1::BIGINT AS invented FROM chunk_vectors GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL",
    "event_sessions": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g), n AS (SELECT user_id, no, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
    "latest_fetches": f"SELECT url, arg_max(fetch_id, (fetched_at, fetch_id)) AS fetch_id FROM (SELECT {_norm('final_url')} AS url, fetch_id, fetched_at FROM fetched_documents) WHERE url IS NOT NULL GROUP BY url",
    "priority_queue": "SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS position, o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100)",
    "queue_stats": "SELECT o_orderpriority, o_orderstatus, count(*) AS tasks FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
}
