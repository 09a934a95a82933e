"""Queries of the training-data operators and, where SQL can say the same, their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.llm import language, leakage, main_body, markup, neighbours, residue, site_lines, splitting, stuffing, tokenizing
from skeinlake.llm.common import table

#: Cosine above which p4_found reports a pair.
SIMILAR = 0.85


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.stuffed(table(spark, sf, "fetched_documents"), table(spark, sf, "page_summaries")).select("fetch_id")


def p1_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.stuffed(table(spark, sf, "fetched_documents"), table(spark, sf, "page_summaries")).select("fetch_id", *[F.round(c, 6).alias(c) for c in ("density", "carried", "repeated")])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, sf, "chunk_vectors"))


def p2_texts(spark: SparkSession, sf: str) -> DataFrame:
    return site_lines.without_repeated_lines(table(spark, sf, "chunk_vectors"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "fetched_documents")).select("fetch_id")


def p3_kept(spark: SparkSession, sf: str) -> DataFrame:
    return residue.without_residue(table(spark, sf, "fetched_documents")).select("fetch_id", "final_url", "status", "html").dropDuplicates(["fetch_id"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.neighbours(table(spark, sf, "chunk_vectors")), SIMILAR).select("chunk_id_a", "chunk_id_b")


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.neighbours(table(spark, sf, "chunk_vectors"))
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def _pieces(spark: SparkSession, sf: str, only_split: bool) -> DataFrame:
    vectors = splitting.split_items(table(spark, sf, "chunk_vectors"), "chunk_id", "text", "heading_path", only_split=only_split)
    chunks = splitting.split_items(table(spark, sf, "content_chunks"), "id", "content", "heading_path", only_split=only_split)
    return vectors.unionByName(chunks)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf, True).filter("piece_no = 2").select("item_id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf, False)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    indexed = markup.document_markup(table(spark, sf, "indexed_documents")).select(F.lit("indexed").alias("origin"), F.col("document_id").alias("record_id"), "markup")
    fetched = markup.page_markup(table(spark, sf, "fetched_documents")).select(F.lit("fetched").alias("origin"), F.col("fetch_id").cast("string").alias("record_id"), "markup")
    return indexed.unionByName(fetched)


def p6_texts(spark: SparkSession, sf: str) -> DataFrame:
    indexed = markup.clean_documents(table(spark, sf, "indexed_documents")).select(F.lit("indexed").alias("origin"), F.col("document_id").alias("record_id"), "text")
    fetched = markup.clean_pages(table(spark, sf, "fetched_documents")).select(F.lit("fetched").alias("origin"), F.col("fetch_id").cast("string").alias("record_id"), "text")
    return indexed.unionByName(fetched)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return main_body.content_blocks(table(spark, sf, "fetched_documents"), table(spark, sf, "page_summaries"))


def p7_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return main_body.main_body(table(spark, sf, "fetched_documents"), table(spark, sf, "page_summaries")).select("fetch_id", "text")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizing.token_ids(table(spark, sf, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.exact(leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")))


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return language.mislabelled(documents, language.fit(documents))


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return language.segments(documents, language.fit(documents)).withColumn("confidence", F.round("confidence", 6))


def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    found = language.document_languages(documents, language.fit(documents))
    return documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), "languages")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_evidence, p2_found, p2_texts, p3_found, p3_kept, p4_found, p4_neighbours, p5_found, p5_pieces, p6_found, p6_texts, p7_found, p7_bodies, p8_ids, p9_found, p9_leaks, p10_found, p10_segments, p10_documents)
}

_SITE = r"regexp_replace(regexp_extract(lower(trim(source_url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www[.]', '')"
_LINES = rf"""
lines AS (
  SELECT chunk_id, document_id, {_SITE} AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
  FROM (SELECT DISTINCT chunk_id, document_id, source_url, text FROM chunk_vectors WHERE source_url IS NOT NULL AND text IS NOT NULL)
),
fenced AS (
  SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS marks FROM lines
),
keyed AS (
  SELECT chunk_id, document_id, site, line, line_no, regexp_replace(lower(line), '[^\p{{L}}]', '', 'g') AS letters
  FROM fenced WHERE marks % 2 = 0 AND NOT starts_with(line, '```')
),
often AS (SELECT site, letters FROM keyed WHERE letters <> '' AND site <> '' GROUP BY ALL HAVING count(DISTINCT document_id) >= 4),
found AS (SELECT DISTINCT chunk_id, line_no::INT AS line_no FROM keyed JOIN often USING (site, letters))
"""
_SIZE = "((ceil(length({t}) / 4.0) + ceil(len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) * 4 / 3.0))::BIGINT // 2)"

ORACLES = {
    "p2_found": f"WITH {_LINES} SELECT chunk_id, line_no FROM found",
    "p5_found": f"""
        SELECT DISTINCT item_id FROM (
          SELECT chunk_id AS item_id, {_SIZE.format(t='text')} AS size FROM chunk_vectors WHERE text IS NOT NULL
          UNION ALL SELECT id, {_SIZE.format(t='content')} FROM content_chunks WHERE content IS NOT NULL
        ) WHERE size > 800""",
    "p9_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        k AS (SELECT item_id, w, least(12, len(w)) AS k FROM i WHERE len(w) > 0),
        ig AS (SELECT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM k)),
        n AS (SELECT DISTINCT k FROM k),
        dg AS (SELECT doc_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, n WHERE len(w) >= k))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (k, g)""",
}
