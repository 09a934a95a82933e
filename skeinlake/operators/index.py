"""A stored inverted index: postings by term bucket, chunks by key bucket, tombstones and running statistics.

Everything lives in Parquet folders of one shared directory and only ever grows by whole segments:

* ``postings/segment=/bucket=``: ``term, key, document, wtf, dl``, sorted by term within a file;
* ``chunks/segment=/part=``: ``key, document, hash, body`` and the columns that filters and vectors need;
* ``stats``: chunks and tokens that a segment added, or, negative, that a deletion took away;
* ``deleted``: documents whose rows in segments before the given one are void.

A search reads the buckets of its own terms and the one-row statistics, never the texts of the corpus:
the texts of those few candidates alone are read that could still be lifted by the phrase bonus.
"""
from __future__ import annotations

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skeinlake.functions import text as T
from skeinlake.operators import retrieval as R

BUCKETS = 64
#: Files of one bucket that a segment is written to, so that a term which half of all chunks hold is no single task.
SPREAD = 4
PHRASE = 1.5


def _bucket(term: str, buckets: int) -> int:
    """``pmod(xxhash64(term), buckets)`` as Spark computes it."""
    h = xxhash.xxh64_intdigest(term.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


class InvertedIndex:
    """An index below a shared folder; ``fields`` name the text columns by role (``title``, ``heading``, ``url``, ``body``)."""

    def __init__(self, spark: SparkSession, folder: str, key: str, document: str, fields: dict[str, Column], keep: list[str] = (), buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.document = spark, folder.rstrip("/"), key, document
        self.fields, self.keep, self.buckets = fields, list(keep), buckets

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None

    def _segment(self) -> int:
        last = [d.agg(F.max("segment")).first()[0] for d in (self._read("stats"), self._read("deleted")) if d is not None]
        return max([-1, *(x for x in last if x is not None)]) + 1

    def add(self, chunks: DataFrame) -> None:
        """Appends chunks as one segment; a chunk key that comes twice in them counts once, null keys not at all. Re-indexing a document is ``delete`` and ``add``."""
        segment = self._segment()
        x = chunks.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        body = self.fields.get("body", F.lit(None).cast("string"))
        kept = x.select(F.col(self.key).alias("key"), F.col(self.document).alias("document"), T.chunk_hash(body).alias("hash"), body.alias("body"), *self.keep, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("part"))
        kept.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/chunks/segment={segment}")
        named = {f: F.coalesce(c, F.lit("")) for f, c in self.fields.items()}
        parts = x.select(F.col(self.key).alias("key"), F.col(self.document).alias("document"), *[T.index_tokens(c).alias(f) for f, c in named.items()])
        weighted = F.concat(*[F.transform(F.col(f), R._weighted(R.WEIGHTS[f])) for f in named])
        dl = F.greatest(sum((F.size(f) for f in named), F.lit(0)), F.lit(1)).cast("long")
        terms = parts.select("key", "document", dl.alias("dl"), F.explode(weighted).alias("x")).groupBy("key", "document", "dl", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("wtf"))
        out = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        out.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "key").write.partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        sums = parts.select(dl.alias("dl")).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
        sums.withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{self.folder}/stats")

    def chunks(self) -> DataFrame | None:
        """The live chunks with ``segment`` and ``part``."""
        x = self._read("chunks")
        return None if x is None else self._live(x)

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._read("deleted")
        if gone is None:
            return rows
        last = gone.groupBy(F.col("document").alias("_d")).agg(F.max("segment").alias("_s"))
        return rows.join(last, (F.col("document") == F.col("_d")) & (F.col("segment") < F.col("_s")), "left_anti")

    def delete(self, documents: DataFrame) -> None:
        """Voids the rows of the documents (one column of ids) that are in the index now; unknown and null ids change nothing."""
        live = self.chunks()
        if live is None:
            return
        segment = self._segment()
        ids = documents.select(F.col(documents.columns[0]).alias("document")).filter(F.col("document").isNotNull()).distinct()
        keys = live.join(ids, "document", "left_semi").select("key", "segment")
        lengths = self._live(self._read("postings")).select("key", "segment", "dl").distinct()
        sums = keys.join(lengths, ["key", "segment"], "left").agg((-F.count("*")).alias("chunks"), (-F.coalesce(F.sum(F.coalesce("dl", F.lit(1))), F.lit(0))).alias("tokens"))
        sums.withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{self.folder}/stats")
        ids.withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{self.folder}/deleted")

    def reused(self, chunks: DataFrame) -> DataFrame:
        """For each document its new ``chunks`` and how many of them it already has by their hash (``reused``)."""
        body = self.fields["body"]
        x = chunks.select(F.col(self.document).alias("document"), T.chunk_hash(body).alias("hash")).filter(F.col("document").isNotNull())
        old = self.chunks()
        known = old.select("document", "hash", F.lit(True).alias("known")).distinct() if old is not None else x.select("document", "hash", F.lit(True).alias("known")).limit(0)
        return x.join(known, ["document", "hash"], "left").groupBy("document").agg(F.count("*").alias("chunks"), F.count("known").alias("reused")).withColumnRenamed("document", self.document)

    def stats(self) -> DataFrame:
        """One row ``chunks, tokens`` of the live index, from the statistics alone."""
        x = self._read("stats")
        if x is None:
            return self.spark.createDataFrame([(0, 0)], "chunks long, tokens long")
        return x.agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))

    def search(self, query: str, limit: int = 10, candidates: Column | None = None) -> DataFrame:
        """``key, score`` of the best live chunks by BM25, ties by key; as ``retrieval.bm25``, from the postings of the query's terms.

        ``candidates`` is a condition on the columns kept with the chunks; statistics stay those of the whole index.
        """
        tokens = R.query_tokens(query)
        postings = self._read("postings") if tokens else None
        if postings is None:
            return self.spark.createDataFrame([], "key string, score double").withColumnRenamed("key", self.key)
        terms = sorted(set(tokens))
        mine = self._live(postings.filter(F.col("bucket").isin(*{_bucket(t, self.buckets) for t in terms}) & F.col("term").isin(*terms)).select("segment", "document", "key", "term", "wtf", "dl"))
        by_chunk = mine.groupBy("key").agg(F.max("dl").cast("double").alias("dl"), *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("wtf"))), F.lit(0.0)).alias(f"w{i}") for i, t in enumerate(terms)])
        df = mine.agg(*[F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)])
        x = by_chunk.crossJoin(F.broadcast(df.crossJoin(F.broadcast(self.stats()))))  # one row
        score = F.lit(0.0)
        for i, t in enumerate(terms):
            idf = F.greatest(F.lit(0.1), F.log((F.col("chunks") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1))
            w = F.col(f"w{i}")
            score = score + tokens.count(t) * idf * w * (R.K1 + 1) / (w + R.K1 * (1 - R.B + R.B * F.col("dl") / (F.col("tokens") / F.col("chunks"))))
        x = x.select("key", score.alias("base"))
        chunks = self.chunks()
        if candidates is not None:
            x = x.join(chunks.filter(candidates).select("key"), "key", "left_semi")
        # only chunks within the bonus of the last of the best can change places by it
        last = x.orderBy(F.desc("base")).limit(limit).agg(F.min("base").alias("last"))
        near = x.crossJoin(F.broadcast(last)).filter(F.col("base") * PHRASE >= F.col("last")).select("key", "base", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("part"))
        bodies = chunks.select("key", "part", F.coalesce(F.contains(F.lower("body"), F.lit(query.lower())), F.lit(False)).alias("phrase"))
        final = near.join(bodies, ["key", "part"]).select(F.col("key").alias(self.key), F.round(F.when(F.col("phrase"), F.col("base") * PHRASE).otherwise(F.col("base")), 6).alias("score"))
        return final.orderBy(F.desc("score"), self.key).limit(limit)
