"""The stored index, site discovery, evidence, caching, schema extraction and storage."""
import random

import pytest
from pyspark.sql import functions as F

from skeinlake.functions.arrow import map_rows
from skeinlake.operators import discovery, evidence, extraction, frontier, retrieval as R, storage
from skeinlake.operators.index import InvertedIndex, _bucket

CHUNK = "k string, doc string, title string, body string, tenant string"


def fields():
    return {"title": F.col("title"), "body": F.col("body")}


def chunks(spark, n, seed=1):
    rng = random.Random(seed)
    words = "retry policy host limiter queue index page crawl parser link table_of rows".split()
    rows = [(f"k{i:03}", f"d{i % 17}", rng.choice([None, "", rng.choice(words)]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))]), rng.choice(["a", None])) for i in range(n)]
    return spark.createDataFrame(rows, CHUNK)


def test_index_equals_scan(spark, tmp_path):
    df = chunks(spark, 200)
    index = InvertedIndex(spark, str(tmp_path / "ix"), "k", "doc", fields(), ["tenant"], buckets=8)
    assert index.search("retry", 5).count() == 0 and index.stats().first().chunks == 0
    index.add(df.filter("k < 'k100'").unionByName(df.filter("k < 'k010'")))  # repeated rows count once
    index.add(df.filter("k >= 'k100'"))
    same = lambda q, d, c=None, n=7: [tuple(r) for r in index.search(q, n, c).collect()] == [tuple(r) for r in R.bm25(d, "k", fields(), q, candidates=c, limit=n).collect()]
    for q in ("retry policy", "queue", "table_of rows retry retry", "nothing known"):
        assert same(q, df) and same(q, df, F.col("tenant") == "a")
    assert index.search("...", 5).count() == 0
    index.delete(spark.createDataFrame([("d3",), ("d5",), (None,), ("unknown",)], "doc string"))
    left = df.filter("doc not in ('d3', 'd5')")
    assert same("retry policy", left) and index.stats().first().chunks == left.count()
    again = df.filter("doc = 'd3'")
    assert {r.doc: (r.chunks, r.reused) for r in index.reused(df.filter("doc in ('d3', 'd4')")).collect()}["d3"][1] == 0
    index.add(again)  # a document comes back
    assert same("retry policy", left.unionByName(again)) and index.stats().first().chunks == left.count() + again.count()
    assert {r.doc: r.chunks - r.reused for r in index.reused(again.filter("body is not null")).collect()} == {"d3": 0}
    assert _bucket("retry", 8) == spark.range(1).select(F.pmod(F.xxhash64(F.lit("retry")), F.lit(8))).first()[0]


def test_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "ix"), "k", "doc", fields(), buckets=8)
    index.add(chunks(spark, 60))
    plan = index.search("retry", 5)._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "PartitionFilters" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,retry)" in plan


def test_sitemaps(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    urls = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    docs = spark.createDataFrame([
        ("http://a.test/sitemap.xml", 200, index("http://a.test/1.xml", "http://a.test/2.xml", "http://a.test/sitemap.xml")), ("http://a.test/1.xml", 200, urls("http://a.test/x", "ftp://a.test/no", "http://a.test/y")),
        ("http://a.test/2.xml", 200, index("http://a.test/3.xml")), ("http://a.test/3.xml", 200, urls("http://a.test/deep", "http://a.test/x")), ("http://b.test/own.xml", 200, urls("http://b.test/p")),
        ("http://c.test/sitemap.xml", 404, urls("http://c.test/never")), ("http://a.test/1.xml", 200, urls("http://a.test/x", "ftp://a.test/no", "http://a.test/y")), ("http://d.test/sitemap.xml", 200, None), (None, 200, "x"),
    ], "url string, status int, xml string")
    seeds = spark.createDataFrame([("http://a.test/", None), ("http://b.test/", "http://b.test/own.xml"), ("http://c.test/", None), ("http://d.test/", None), ("http://a.test/", None)], "seed string, sitemap string")
    got = {(r.seed, r.url): r.level for r in discovery.sitemaps(seeds, docs).collect()}
    assert got == {("http://a.test/", "http://a.test/x"): 2, ("http://a.test/", "http://a.test/y"): 2, ("http://a.test/", "http://a.test/deep"): 3, ("http://b.test/", "http://b.test/p"): 1}
    assert {r.url for r in discovery.sitemaps(seeds, docs, levels=2).collect()} == {"http://a.test/x", "http://a.test/y", "http://b.test/p"}
    assert discovery.sitemaps(seeds, docs, limit=1).count() == 2 and discovery.sitemaps(seeds.limit(0), docs).count() == 0


def test_site_map(spark):
    links = spark.createDataFrame([("http://a.test/guide", "Guide"), ("http://A.test/guide#x", None), ("http://sub.a.test/q", "Q"), ("http://evila.test/", "no"), ("http://a.test/x.png", "no"), ("http://a.test/admin/x", "no"), (None, "no")], "url string, title string")
    titles = spark.createDataFrame([("http://a.test/guide", "The index guide", "about")], "url string, title string, description string")
    got = [(r.url, r.title) for r in discovery.site_map(links, titles, "a.test", "index", excludes=["/admin/**"]).collect()]
    assert got == [("http://a.test/guide", "The index guide"), ("http://sub.a.test/q", "Q")]
    h = spark.createDataFrame([("a.test", "http://evila.test/")], "b string, u string")
    assert h.select(discovery.map_host(F.col("b"), F.col("u"), strict=False)).first()[0] and not h.select(discovery.map_host(F.col("b"), F.col("u"))).first()[0]


def test_follow_rules_and_requests(spark):
    df = spark.createDataFrame([("html",), ("rss",), ("pdf",), (None,)], "t string")
    assert [tuple(r) for r in df.select(discovery.follows(F.col("t")), discovery.follows(F.col("t"), feeds=True), discovery.follows(F.col("t"), documents=True)).collect()] == [(True, True, True), (False, True, True), (False, False, True), (False, False, True)]
    req = spark.createDataFrame([("https://www.Google-Analytics.com/x", "script"), ("http://10.0.0.1/", "document"), ("http://a.test/f.woff", "Font"), ("http://a.test/v", "video"), ("http://a.test/", "document"), (None, None), ("http://a.test/s", None)], "u string, k string")
    assert [r[0] for r in req.select(discovery.blocks_request(F.col("u"), F.col("k"), ["font", "media"])).collect()] == [True, True, True, True, False, True, False]


def test_search_results(spark):
    hits = spark.createDataFrame([("a", "http://x.test/1", 0.5), ("b", "http://X.test/1#f", 0.5), ("c", "http://docs.x.test/", 0.9), ("d", None, 1.0), ("e", "http://y.test/", 0.1)], "k string, u string, s double")
    assert [r.k for r in discovery.search_results(hits, "u", "s", "k", exclude=["docs."]).collect()] == ["a", "e"]
    assert [r.k for r in discovery.search_results(hits, "u", "s", "k", domain="x.test", limit=0).collect()] == ["c"]


def test_evidence_store_gaps_and_report(spark):
    rows = [("1", "t", "Some  text", "http://a.gov/", 0.9, ["f"]), ("2", "t", "Some text", "http://b.test/", 1.0, None), ("3", "t", "More", "http://reddit.com/x", 1.0, ["g"]), ("4", "u", None, "http://a.gov/", 1.0, None), ("5", "u", "  ", None, None, None), ("6", "u", "End", None, None, ["f"])]
    df = spark.createDataFrame(rows, "id string, topic string, text string, url string, rel double, fields array<string>")
    e = evidence.store(df, "text", "url", "rel", ["id"])
    assert [(r.id, r.weighted) for r in evidence.top(e, "id").collect()] == [("1", 0.765), ("3", 0.5), ("6", 0.0)]
    gaps = {r.topic: (r.sources, r.missing, r.complete) for r in evidence.gaps(df, "topic", "url", F.col("fields"), ["f", "g"]).collect()}
    assert gaps == {"t": (3, [], True), "u": (1, ["g"], False)}
    report = {r.topic: (r.report, r.claims, r.confidence) for r in evidence.report(e, "topic", "text", "id").collect()}
    assert report["t"] == ("- Some  text [E1]\n- More [E2]", 2, 0.5)
    assert evidence.store(df.limit(0), "text", "url", "rel", ["id"]).count() == 0


def test_context_packing(spark):
    df = spark.createDataFrame([("a", "g", 3.0, "x" * 90), ("b", "g", 2.0, "x" * 8), ("c", "g", 1.0, "x" * 20), ("d", "h", None, "é" * 200), ("e", "h", None, None)], "k string, g string, s double, t string")
    got = {(r.g, r.k): (r.position, r.used) for r in evidence.pack_bytes(df, "g", "s", "k", "t", 100).collect()}
    assert got == {("g", "a"): (1, 90), ("g", "b"): (2, 98), ("h", "d"): (1, 100)}


def test_cache_lifetimes(spark):
    df = spark.sql("select * from values (1, 'u', timestamp'2025-01-01 00:00:00'), (2, 'u', timestamp'2025-01-01 00:00:09'), (3, 'u', timestamp'2025-01-01 00:00:10'), (4, 'u', timestamp'2025-01-01 00:00:19'), (5, 'v', timestamp'2025-01-01 00:00:00'), (6, null, timestamp'2025-01-01 00:00:00'), (7, 'u', timestamp'2025-01-01 00:00:00') t(k, u, at)")
    got = {r.k: r.outcome for r in evidence.cache_outcomes(df, "k", "u", "at", 10).collect()}
    assert got == {1: "miss", 7: "hit", 2: "hit", 3: "expired", 4: "hit", 5: "miss"}
    assert {r.k: r.outcome for r in evidence.cache_outcomes(df, "k", "u", "at", 0).collect()}[3] == "hit"


def test_schema_extraction(spark):
    cands = spark.createDataFrame([(1, 0, "product.offers.price", '"12.50"', 0.9, "json_ld"), (1, 1, "tags", '["a"]', 0.95, "json_ld"), (1, 2, "x.name", '"No"', 0.9, "json_ld"), (2, 0, "name", '"Yes"', 0.8, "meta")], "id int, ord int, key string, value string, confidence double, source string")
    schema = {"required": ["name"], "properties": {"name": {"type": "string"}, "price": {"type": "number"}}}
    values = extraction.by_schema(cands, schema)
    got = {(r.id, r.property): r.value for r in values.collect()}
    assert got == {(1, "price"): "12.5", (2, "name"): '"Yes"'}
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    full = {(r.id, r.property): (r.value, r.error) for r in extraction.with_missing(values, ids, schema, "error").collect()}
    assert full[1, "name"] == (None, "missing name") and full[3, "price"] == (None, None) and len(full) == 6
    assert extraction.with_missing(values, ids, schema, "omit").count() == 2 and extraction.with_missing(values, ids, schema).filter("error is not null").count() == 0
    assert [(r.id, r.value) for r in extraction.array_values(cands).collect()] == [(1, '["a"]')]


def test_repair(spark):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer"}, "p": {"type": "number"}, "b": {"type": "boolean"}, "s": {"type": "string"}, "l": {"type": "array", "items": {"type": "integer"}}}}
    assert extraction.repair({"n": "1,200", "p": "$ 3.5", "b": "Yes", "s": 4, "l": "7", "z": 1}, schema) == {"n": 1200, "p": 3.5, "b": True, "s": "4", "l": [7]}
    df = spark.createDataFrame([(1, '{"n": "x"}'), (2, "no json"), (3, None), (4, '{"n": 2.0}')], "k int, v string")
    assert {r.k: r.errors for r in extraction.repaired(df, "k", "v", schema).collect()} == {1: ["$.n: expected integer, found string"], 2: ["$: no JSON"], 3: ["$: no JSON"], 4: []}


def test_candidates_of_tables(spark):
    df = spark.createDataFrame([(1, "http://a.test/", "<table><tr><th>Weight:</th><td>12</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>")], "id int, url string, html string")
    assert {(r.key, r.value, r.confidence) for r in extraction.candidates(df, "id", "url", "html").filter("source = 'table'").collect()} == {("Weight", "12", 0.8)}


def test_hot_address_in_frontier(spark):
    rows = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.lit("http://a.test/home")).otherwise(F.concat(F.lit("http://a.test/"), F.col("id"))).alias("url"), F.lit(1).alias("depth"), F.lit("http://a.test/").alias("seed"))
    got = {r.reason: r["count"] for r in frontier.decide(rows.unionByName(rows.filter("n = 5")), "url", "depth", "seed", ["n"]).groupBy("reason").count().collect()}
    assert got == {None: 2001, "duplicate": 999}  # equal rows are one row


def test_map_rows_isolates_failures(spark):
    df = spark.createDataFrame([(1, 2), (2, 0)], "k int, v int")
    one = lambda k, v: {"k": k, "x": 10 // v}
    assert {r.k: (r.x, (r.error or "")[:17]) for r in map_rows(df, one, "k int, x int, error string").collect()} == {1: (5, ""), 2: (None, "ZeroDivisionError")}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        map_rows(df, one, "k int, x int").collect()


def test_shared_folder_is_needed_on_a_cluster():
    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Cluster:
        conf = Conf({"spark.sql.warehouse.dir": "/tmp/w"})

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf())

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)
