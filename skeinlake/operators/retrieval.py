"""Lexical and vector retrieval, rank fusion, diversification and context packing.

A query is a short string: its tokens and the corpus statistics are small by construction and travel
as literals or one-row tables; everything that grows with the corpus stays distributed.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinlake.functions import text
from skeinlake.operators.storage import cut

K1, B = 1.2, 0.75
#: Weight of a term by where it stands.
WEIGHTS = {"title": 3.0, "heading": 2.0, "url": 1.5, "body": 1.0}
RRF_K = 60


def query_tokens(query: str) -> list[str]:
    """Tokens of a query, repeated ones kept."""
    out = []
    for t in re.split(r"[^\w.\-]+", query):
        t = re.sub(r"^[\W_]+|[\W_]+$", "", t).lower()
        if t:
            out.append(t)
            if re.search(r"[_.\-]", t):
                out += [p for p in re.split(r"[_.\-]", t) if len(p.encode()) > 1]
    return out


def _weighted(w: float):
    return lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))


def _is(term: str):
    return lambda x: x == F.lit(term)


def postings(chunks: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """``key, term, wtf`` with a term's weighted frequency over the fields (``title``, ``heading``, ``url``, ``body``)."""
    parts = [F.transform(F.coalesce(text.index_tokens(c), F.array().cast("array<string>")), _weighted(WEIGHTS[f])) for f, c in fields.items()]
    return chunks.select(key, F.explode(F.concat(*parts)).alias("x")).groupBy(key, F.col("x.term").alias("term")).agg(F.sum("x.w").alias("wtf"))


def lengths(chunks: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """``key, dl``: unweighted tokens of all fields, at least 1."""
    n = sum((F.coalesce(F.size(text.index_tokens(c)), F.lit(0)) for c in fields.values()), F.lit(0))
    return chunks.select(key, F.greatest(n, F.lit(1)).cast("long").alias("dl"))


def bm25(chunks: DataFrame, key: str, fields: dict[str, Column], query: str, candidates: Column | None = None, limit: int = 10) -> DataFrame:
    """``key, score`` of the best chunks for a query; ties are ordered by key.

    Number, frequency and mean length come from all chunks, filters only restrict the candidates.
    Repeated query tokens count repeatedly, any token may match, and texts that hold the whole query
    score half as much again. One pass over the corpus: the terms of the query are counted in place,
    without building postings for the others.
    """
    tokens = query_tokens(query)
    if not tokens:
        return chunks.select(key, F.lit(0.0).alias("score")).limit(0)
    terms = sorted(set(tokens))
    # every row is counted by regular expressions; token arrays are built only where a query term can stand
    weighted = {t: F.lit(0.0) for t in terms}
    dl = F.lit(0)
    some = lambda c: F.lower(c).rlike("|".join(re.escape(t) for t in terms))
    columns = []
    for f, c in fields.items():
        columns += [text.token_count(c).alias(f"_n_{f}"), F.when(some(c), text.index_tokens(c)).alias(f"_{f}")]
        dl = dl + F.col(f"_n_{f}")
        for t in terms:
            weighted[t] = weighted[t] + F.lit(WEIGHTS[f]) * F.coalesce(F.size(F.filter(F.col(f"_{f}"), _is(t))), F.lit(0))
    phrase = F.coalesce(F.contains(F.lower(fields["body"]), F.lit(query.lower())), F.lit(False)) if "body" in fields else F.lit(False)
    extra = [candidates.alias("_ok")] if candidates is not None else []
    tokenised = chunks.select(key, *columns, phrase.alias("phrase"), *extra)
    scored = tokenised.select(key, F.greatest(dl, F.lit(1)).cast("double").alias("dl"), *[weighted[t].alias(f"w{i}") for i, t in enumerate(terms)], "phrase", *(["_ok"] if extra else []))
    # one narrow row a chunk, written once: the statistics and the scores read it, and filters on the
    # counts are not pushed below it, where they would build the token arrays again for every term
    scored = cut(scored)
    stats = scored.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"w{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    x = scored.filter(" OR ".join(f"w{i} > 0" for i in range(len(terms))))
    if candidates is not None:
        x = x.filter("_ok")
    x = x.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.greatest(F.lit(0.1), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1))
        w = F.col(f"w{i}")
        score = score + tokens.count(t) * idf * w * (K1 + 1) / (w + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = F.when(F.col("phrase"), score * 1.5).otherwise(score)
    return x.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def knn(vectors: DataFrame, key: str, embedding: str, query: list[float], limit: int = 10, min_score: float | None = None) -> DataFrame:
    """``key, score`` of the vectors most similar to one query vector: ``(cosine + 1) / 2`` within 0 and 1; other dimensions are skipped."""
    q = F.array(*[F.lit(float(v)) for v in query])
    sim = text.cosine(F.col(embedding), q)
    x = vectors.select(key, sim.alias("sim")).filter(F.col("sim").isNotNull()).select(key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sim") + 1) / 2)), 6).alias("score"))
    if min_score is not None:
        x = x.filter(F.col("score") >= min_score)
    return x.orderBy(F.desc("score"), key).limit(limit)


def ranked(scores: DataFrame, key: str, name: str) -> DataFrame:
    """Ranks from 1 of a bounded result list."""
    return scores.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long").alias(name))


def rrf(vector: DataFrame, lexical: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """``key, vector_rank, lexical_rank, rrf`` of two ranked lists: reciprocal rank fusion by a full outer join."""
    x = ranked(vector, key, "vector_rank").join(ranked(lexical, key, "lexical_rank"), key, "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return x.select(key, "vector_rank", "lexical_rank", F.round(part("vector_rank") + part("lexical_rank"), 9).alias("rrf"))


def diversify(matches: DataFrame, group: str, score: str, key: str, most: int = 3, limit: int | None = None) -> DataFrame:
    """At most ``most`` rows of each group, best first; 0 keeps all."""
    x = matches
    if most:
        x = x.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).filter(F.col("_rn") <= most).drop("_rn")
    return x.orderBy(F.desc(score), key).limit(limit) if limit else x


def pack(matches: DataFrame, score: str, key: str, tokens: str, budget: int = 16_000, most: int = 20) -> DataFrame:
    """Best matches while their tokens fit the budget; the first always fits, and packing stops at the first that does not."""
    w = Window.orderBy(F.desc(score), key)
    x = matches.withColumn("_rn", F.row_number().over(w)).withColumn("_sum", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.filter(((F.col("_sum") <= budget) | (F.col("_rn") == 1)) & (F.col("_rn") <= most)).withColumn("position", F.col("_rn").cast("long")).drop("_rn", "_sum")


def first_seen(results: DataFrame, key: str, order: list) -> DataFrame:
    """First row of each key over the results of several queries."""
    return results.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def local_search(docs: DataFrame, key: str, body: Column, query: str, limit: int | None = 10) -> DataFrame:
    """``key, score``: share of query tokens that a text holds, .1 to .99 over twice their number; without a limit all that hold one."""
    tokens = sorted(set(query_tokens(query)))
    if not tokens:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    have = text.index_tokens(body)
    raw = sum((F.when(F.array_contains(F.col("_t"), t), 1).otherwise(0) for t in tokens), F.lit(0))
    x = docs.select(key, have.alias("_t")).select(key, raw.alias("raw")).filter("raw > 0")
    x = x.select(key, F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.1), F.col("raw") / (2.0 * len(tokens)))), 2).alias("score"))
    return x if limit is None else x.orderBy(F.desc("score"), key).limit(limit)


def matches_filter(domain: str | None = None, path_prefix: str | None = None, language: str | None = None, document_id: str | None = None, tags: list[str] = (), tenant: str | None = None, url: str = "source_url") -> Column:
    """Filter of index rows: host, path prefix, language, document, all of some tags, and the tenant if one is given."""
    from skeinlake.functions import url as U

    ok = F.lit(True)
    if domain:
        ok = ok & (U.host(F.col(url)) == domain.lower())
    if path_prefix:
        ok = ok & F.startswith(F.coalesce(U.path(F.col(url)), F.col(url)), F.lit(path_prefix))
    if language:
        ok = ok & (F.col("lang") == language)
    if document_id:
        ok = ok & (F.col("document_id") == document_id)
    if tags:
        ok = ok & (F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.coalesce(F.col("tags"), F.array().cast("array<string>")))) == 0)
    if tenant is not None:
        ok = ok & (F.col("tenant_id") == tenant)
    return F.coalesce(ok, F.lit(False))


def citations(answer: Column) -> Column:
    """Ids cited in brackets, ``[chk_…]``, ``[src_…]`` or ``[E1]``, each once in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[((?:chk_|src_)[A-Za-z0-9_\-]+|E\d+)\]"), F.lit(1)))
