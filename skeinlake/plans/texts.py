"""Queries of the text, chunking, similarity and evidence operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.functions import text as T
from skeinlake.operators import chunking, duplicates, extraction, retrieval

QUERY_TOKENS = ["retry", "policy", "limiter"]
KEYWORDS = ["retry", "server", "table"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _t(spark, sf, "documents").select("doc_id", T.approx_tokens(t).alias("tokens"), T.word_tokens(t).alias("word_tokens"), T.word_count(t).alias("words"))


def chunk_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "content_chunks").select("id", T.chunk_hash(F.col("content")).alias("hash"), T.page_hash(F.col("content")).alias("page_hash")).distinct()


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.exact_classes(_t(spark, sf, "documents"), "doc_id", "text")


def simhashes(spark: SparkSession, sf: str) -> DataFrame:
    return T.simhash(_t(spark, sf, "documents"), "doc_id", "text")


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.near_classes(_t(spark, sf, "documents"), "doc_id", "text")


def index_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.size(T.index_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and weighted frequency of every term of the chunks' titles and texts."""
    x = _t(spark, sf, "chunk_vectors").select("chunk_id", "title", "text").distinct()
    p = retrieval.postings(x, "chunk_id", {"title": F.col("title"), "body": F.col("text")})
    return p.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("wtf"), 3).alias("weight"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", T.snippet(F.coalesce("text", F.lit("")), QUERY_TOKENS).alias("snippet"))


def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_t(spark, sf, "indexed_documents").select("document_id", "text").distinct(), "document_id", "text")


def evidence_split(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.evidence(_t(spark, sf, "documents"), "doc_id", "text").select("doc_id", "position", "excerpt")


def chunk_relevance(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "content_chunks").select("id", "content_type", "heading_path", "content").distinct()
    return x.select("id", extraction.chunk_relevance(F.col("content_type"), F.col("heading_path"), F.col("content"), KEYWORDS).alias("relevance"))


def metadata_members(spark: SparkSession, sf: str) -> DataFrame:
    """Plain members of the chunks' JSON metadata, the surest value of each key."""
    x = _t(spark, sf, "chunk_vectors").select("chunk_id", "metadata").distinct()
    return extraction.without_schema(extraction.json_member_candidates(x, "chunk_id", "metadata")).select(F.col("id").alias("chunk_id"), "key", "value", "confidence")


def event_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Typed member of the events' JSON properties."""
    x = _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("raw"))
    return x.select("event_id", T.parse_scalar(F.col("raw")).alias("kind"), F.col("raw").try_cast("long").alias("number"))


QUERIES = {f.__name__: f for f in (token_counts, chunk_hashes, exact_duplicates, simhashes, near_duplicates, index_token_counts, term_stats, snippets, structural_chunks, evidence_split, chunk_relevance, metadata_members, event_numbers)}

_WS = "[\\s\\p{Z}]+"
_trim = lambda t: f"regexp_replace({t}, '^{_WS}|{_WS}$', '', 'g')"
_words = lambda t: f"len(list_filter(string_split_regex({t}, '{_WS}'), lambda w: w <> ''))"
_D = "coalesce(text, '')"
_TOKENS = r"""flatten(list_transform(list_filter(list_transform(string_split_regex({t}, '[^\p{L}\p{N}_.\-]+'), lambda t: lower(regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda t: t <> ''),
  lambda t: CASE WHEN regexp_matches(t, '[_.\-]') THEN list_concat([t], list_filter(string_split_regex(t, '[_.\-]'), lambda p: strlen(p) > 1)) ELSE [t] END))"""
_tokens = lambda t: _TOKENS.replace("{t}", t)
_page = "sha256(array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda l: " + _trim("l") + "), lambda l: l <> ''), chr(10)))"

_SIMHASH = f"""
    d AS (SELECT doc_id, list_filter(string_split_regex(lower(translate(text, '\u0130\u03a3', 'i\u03c3')), '{_WS}'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    x AS (SELECT doc_id, unnest(w) AS t, 2 AS v FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 1 FROM d),
    h AS (SELECT doc_id, ('0x' || substr(sha256(t), 1, 15))::BIGINT AS h, v FROM x),
    s AS (SELECT doc_id, b, sum(CASE WHEN (h & (1::BIGINT << b)) <> 0 THEN v ELSE -v END) AS s FROM h, (SELECT unnest(range(60))::INT AS b) GROUP BY ALL),
    f AS (SELECT doc_id, coalesce(sum(CASE WHEN s > 0 THEN 1::BIGINT << b ELSE 0 END), 0)::BIGINT AS fingerprint FROM d LEFT JOIN s USING (doc_id) GROUP BY 1)"""

_AT = "coalesce(nullif(instr(lower(t), 'retry'), 0), nullif(instr(lower(t), 'policy'), 0), instr(lower(t), 'limiter'))"

ORACLES = {
    "snippets": f"""
        WITH d AS (SELECT doc_id, {_D} AS t FROM documents), a AS (SELECT doc_id, t, length(t) AS n, {_AT} AS pos FROM d), w AS (SELECT *, greatest(pos - 40, 1) AS s, least(pos + 80, n + 1) AS e FROM a)
        SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN s > 1 THEN '...' ELSE '' END || substr(t, s, e - s) || CASE WHEN e <= n THEN '...' ELSE '' END WHEN n > 150 THEN substr(t, 1, 150) || '...' ELSE t END AS snippet FROM w""",
    "simhashes": f"WITH {_SIMHASH} SELECT doc_id, fingerprint FROM f",
    "near_duplicates": f"""WITH {_SIMHASH}, c AS (SELECT fingerprint, min(doc_id) AS class_id FROM f GROUP BY 1),
        l AS (SELECT a.fingerprint, count(*) AS links FROM c a JOIN c b ON a.fingerprint <> b.fingerprint AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 3 GROUP BY 1)
        SELECT doc_id, class_id, coalesce(links, 0) AS links FROM f JOIN c USING (fingerprint) LEFT JOIN l USING (fingerprint)""",
    "token_counts": f"""SELECT doc_id, CASE WHEN {_D} = '' THEN 0 WHEN {_words(_D)} = 0 THEN 1 ELSE (ceil(length({_D}) / 4.0) + ceil({_words(_D)} * 4 / 3.0))::BIGINT // 2 END::BIGINT AS tokens,
        ({_words(_D)} + length(regexp_replace({_D}, '[^!-/:-@\\[-`{{-~]', '', 'g')) // 3)::BIGINT AS word_tokens, {_words(_D)}::BIGINT AS words FROM documents""",
    "chunk_hashes": f"SELECT DISTINCT id, sha256(regexp_replace({_trim('content')}, '{_WS}', ' ', 'g')) AS hash, {_page} AS page_hash FROM content_chunks",
    "exact_duplicates": f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS copies FROM (SELECT doc_id, sha256(regexp_replace({_trim('text')}, '{_WS}', ' ', 'g')) AS h FROM documents WHERE text IS NOT NULL)""",
    "index_token_counts": f"SELECT doc_id, len({_tokens(_D)})::BIGINT AS tokens FROM documents",
    "term_stats": f"""WITH c AS (SELECT DISTINCT chunk_id, title, text FROM chunk_vectors),
        p AS (SELECT chunk_id, unnest({_tokens("coalesce(title, '')")}) AS term, 3.0 AS w FROM c UNION ALL SELECT chunk_id, unnest({_tokens(_D)}), 1.0 FROM c),
        g AS (SELECT chunk_id, term, sum(w) AS wtf FROM p GROUP BY ALL) SELECT term, count(*) AS df, round(sum(wtf), 3)::DOUBLE AS weight FROM g GROUP BY 1""",
    "evidence_split": f"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS raw, unnest(range(len(string_split_regex(text, '\\n\\s*\\n')))) AS position FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, position, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS excerpt FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace({_trim('excerpt')}, '{_WS}', ' ', 'g') ORDER BY doc_id, position) AS rn FROM e WHERE strlen(excerpt) BETWEEN 40 AND 2000)
        SELECT doc_id, position::INT AS position, excerpt FROM k WHERE rn = 1""",
    "chunk_relevance": """SELECT id, round(CASE content_type WHEN 'json' THEN 1.5 WHEN 'table' THEN 1.2 WHEN 'metadata' THEN 1.0 WHEN 'feed_entry' THEN 0.9 WHEN 'section' THEN 0.8 WHEN 'pdf_page' THEN 0.8 WHEN 'docx_section' THEN 0.8 ELSE 0.5 END
        + list_sum(list_transform(['retry', 'server', 'table'], lambda w: CASE WHEN contains(lower(array_to_string(coalesce(heading_path, []), ' ')), w) THEN 1.1 WHEN contains(lower(coalesce(content, '')), w) THEN 0.4 ELSE 0 END)), 6)::DOUBLE AS relevance
        FROM (SELECT DISTINCT id, content_type, heading_path, content FROM content_chunks)""",
    "metadata_members": """SELECT chunk_id, key, json_extract(metadata, '$.' || key)::VARCHAR AS value, 0.95::DOUBLE AS confidence FROM (SELECT DISTINCT chunk_id, metadata, unnest(json_keys(metadata)) AS key FROM (SELECT DISTINCT chunk_id, metadata FROM chunk_vectors))""",
    "event_numbers": """SELECT event_id, CASE WHEN raw IS NULL OR lower(trim(raw)) = 'null' THEN 'null' WHEN regexp_matches(raw, '^[+-]?\\d{1,18}$') THEN 'integer' WHEN regexp_matches(raw, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'number' WHEN lower(raw) IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind, try_cast(raw AS BIGINT) AS number
        FROM (SELECT event_id, json_extract_string(props, '$.k') AS raw FROM events)""",
}
