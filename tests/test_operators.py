"""Frontier, snapshots, retrieval, chunking, duplicates, extraction and streams."""
import itertools
import json
import random
import time

from pyspark.sql import functions as F

from skeinlake.functions import text as T
from skeinlake.operators import chunking, duplicates, extraction, frontier, retrieval as R, snapshots, storage
from skeinlake.sources import providers
from skeinlake.streaming import streams


def test_dedupe_and_reasons(spark):
    rows = [(1, "http://a.test/x#1", 1), (2, "http://A.test/x?utm_source=q", 1), (3, "http://b.test/", 1), (4, "http://a.test/y.png", 1), (5, "mailto:x", 1), (6, "http://a.test/z", 9), (7, "http://10.0.0.1/", 1), (8, None, 1), (9, "http://a.test/no", 1)]
    df = spark.createDataFrame([(*r, "http://a.test/", "r") for r in rows], "n int, url string, depth int, seed string, reason0 string")
    got = {r.n: r.reason for r in frontier.decide(df, "url", "depth", "seed", ["n"], excludes=["/no"]).collect()}
    assert got == {1: None, 2: "duplicate", 3: "domain", 4: "static_asset", 5: "scheme", 6: "depth", 7: "blocked_host", 8: "scheme", 9: "path"}
    assert [r.n for r in frontier.dedupe(df, "url", ["n"]).filter("url like '%test/x%'").collect()] == [1]
    assert frontier.dedupe(df.limit(0), "url", ["n"]).count() == 0


def test_crawl_against_breadth_first_search(spark):
    rng = random.Random(1)
    edges = {(f"u{a}", f"u{b}") for a, b in ((rng.randint(0, 60), rng.randint(0, 60)) for _ in range(140))} | {(f"u{i}", "hub") for i in range(40)}
    pages = [(f"u{i}",) for i in range(50)]
    depth, level = {"u0": 0}, ["u0"]
    for d in range(1, 4):
        level = sorted({t for u in level if u in {p[0] for p in pages} for s, t in edges if s == u} - set(depth))
        depth |= {u: d for u in level}
    got = frontier.crawl(spark.createDataFrame(pages, "url string"), spark.createDataFrame(sorted(edges), "url string, target string"), spark.createDataFrame([("u0",), ("u0",)], "url string"), 3)
    assert {r.url: r.depth for r in got.collect()} == depth
    assert {r.url for r in got.filter("found").collect()} == {u for u in depth if u in {p[0] for p in pages}}


def test_retry(spark):
    df = spark.createDataFrame([(503, 1), (404, 0), (429, 9)], "s int, n int").select(frontier.retry(F.col("s"), F.col("n"), 100).alias("x"))
    assert [tuple(r.x) for r in df.collect()] == [(True, 200), (False, 100), (True, 3200)]


def test_snapshot_diff(spark):
    s = "url string, status int, final_url string, raw_hash string, norm_hash string"
    old = spark.createDataFrame([("same", 200, "same", "1", "a"), ("space", 200, "space", "1", "a"), ("changed", 200, "changed", "1", "a"), ("gone", 200, "gone", "1", "a"), ("404", 200, "404", "1", "a"), ("500", 200, "500", "1", "a"), ("moved", 200, "moved", "1", "a"), ("304", 200, "304", "1", "a"), ("null", 200, "null", None, None)], s)
    new = spark.createDataFrame([("same", 200, "same", "1", "a"), ("space", 200, "space", "2", "a"), ("changed", 200, "changed", "2", "b"), ("new", 200, "new", "1", "a"), ("404", 404, "404", "2", "b"), ("500", 500, "500", "2", "b"), ("moved", 200, "elsewhere", "1", "a"), ("304", 304, "304", None, None), ("null", 200, "null", None, None)], s)
    got = {r.url: r.change for r in snapshots.diff(new, old).collect()}
    assert got == {"same": "unchanged", "space": "unchanged", "changed": "changed", "gone": "deleted", "new": "new", "404": "deleted", "500": "unknown", "moved": "redirected", "304": "unchanged", "null": "changed"}


def test_bm25_fields_phrase_and_filter(spark):
    rows = [("a", "retry policy", "the retry policy of hosts", 1), ("b", "other", "retry now", 2), ("c", "none", "nothing here", 1), ("d", None, None, 1)]
    df = spark.createDataFrame(rows, "k string, title string, body string, tenant int")
    fields = {"title": F.col("title"), "body": F.col("body")}
    got = [r.k for r in R.bm25(df, "k", fields, "retry policy").collect()]
    assert got == ["a", "b"]
    only = R.bm25(df, "k", fields, "retry policy", candidates=F.col("tenant") == 2).collect()
    full = {r.k: r.score for r in R.bm25(df, "k", fields, "retry policy").collect()}
    assert [(r.k, r.score) for r in only] == [("b", full["b"])]  # statistics of the whole index
    assert R.bm25(df, "k", fields, "...").count() == 0 and R.bm25(df.limit(0), "k", fields, "retry").count() == 0


def test_knn_skips_other_dimensions(spark):
    df = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 0.0]), ("z", [-1.0, 0.0]), ("w", [1.0]), ("n", None)], "k string, v array<float>")
    assert [(r.k, r.score) for r in R.knn(df, "k", "v", [2.0, 0.0]).collect()] == [("x", 1.0), ("y", 0.5), ("z", 0.0)]
    assert R.knn(df, "k", "v", [2.0, 0.0], min_score=0.6).count() == 1


def test_fusion_diversity_and_packing(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "k string, score double")
    x = spark.createDataFrame([("b", 7.0), ("c", 3.0)], "k string, score double")
    got = [(r.k, r.vector_rank, r.lexical_rank) for r in R.rrf(v, x, "k").orderBy(F.desc("rrf"), "k").collect()]
    assert got == [("b", 2, 1), ("a", 1, None), ("c", None, 2)]
    m = spark.createDataFrame([("a", "d", 5.0, 900), ("b", "d", 4.0, 50), ("c", "d", 3.0, 10), ("e", "f", 2.0, 100), ("g", "f", 1.0, 1)], "k string, doc string, s double, tokens long")
    assert [r.k for r in R.diversify(m, "doc", "s", "k", 2).collect()] == ["a", "b", "e", "g"]
    assert [r.k for r in R.pack(m, "s", "k", "tokens", budget=100).orderBy("position").collect()] == ["a"]  # the first always fits, then packing stops
    assert [r.k for r in R.pack(m, "s", "k", "tokens", budget=955).orderBy("position").collect()] == ["a", "b"]


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(60)) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base + [b + " tail" for b in base] + [base[0]] * 15 + [None, ""])]
    df = spark.createDataFrame(docs, "id int, t string")
    prints = {r.id: r.fingerprint for r in T.simhash(df, "id", "t").collect()}
    least = {p: min(i for i, q in prints.items() if q == p) for p in prints.values()}
    links = {p: sum(1 for q in least if q != p and bin(p ^ q).count("1") <= 3) for p in least}
    got = {r.id: (r.class_id, r.links) for r in duplicates.near_classes(df, "id", "t").collect()}
    assert got == {i: (least[p], links[p]) for i, p in prints.items()}
    exact = {r.id: (r.class_id, r.copies) for r in duplicates.exact_classes(df, "id", "t").collect()}
    assert exact[24] == (0, 16) and exact[1] == (1, 1) and len(exact) == len(docs) - 1
    pairs = {(r.a, r.b) for r in duplicates.near_pairs(spark.createDataFrame([(p,) for p in least], "fingerprint long")).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, b in itertools.combinations(least, 2) if bin(a ^ b).count("1") <= 3}


def test_structural_chunks(spark):
    md = "# Top\n\nIntro text here.\n\n## Part\n\n" + "A sentence about queues. " * 300 + "\n\n```python\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- one\n- two\n  more\n"
    chunks = chunking.chunk_markdown("d1", md)
    assert chunks[0]["heading_path"] == ["Top"] and chunks[0]["text"] == "Intro text here."
    assert all(c["heading_path"] == ["Top", "Part"] for c in chunks[1:]) and all(c["token_count"] <= 800 for c in chunks)
    assert chunks[-1]["code_lang"] == "python" and "| 1 | 2 |" in chunks[-1]["text"] and chunks[1]["chunk_id"].startswith("chk_d1_1_")
    assert chunking.chunk_markdown("d", None) == [] == chunking.chunk_markdown("d", "")
    df = spark.createDataFrame([("d1", md), ("d2", None), ("d3", "plain")], "id string, t string")
    assert chunking.chunk_documents(df, "id", "t").filter("document_id = 'd3'").count() == 1
    js = chunking.chunk_json("j", json.dumps([{"a": "x" * 4000}, {"b": 2}, {"c": 3}]))
    assert js[0]["text"].startswith("// Item [0]") and len(js) == 2 and chunking.chunk_json("j", "{bad") == []


def test_evidence(spark):
    p = "This paragraph is long enough to be evidence of something."
    df = spark.createDataFrame([(1, f"{p}\n\nshort\n\n{p}"), (2, p.replace(" ", "  ")), (3, None)], "id int, t string")
    assert [(r.id, r.position) for r in chunking.evidence(df, "id", "t").collect()] == [(1, 0)]


def test_extraction(spark):
    html = '<html><head><title>Head</title><meta property="og:title" content="Og"><script type="application/ld+json">{"@graph": [{"name": "Lamp", "offers": {"weight": "12 kg"}, "tags": ["a"]}]}</script></head><body><dl><dt>Height</dt><dd>30</dd></dl></body></html>'
    df = spark.createDataFrame([(1, "http://a.test/", html), (2, None, None)], "id int, url string, html string")
    cands = extraction.candidates(df, "id", "url", "html")
    schema = {"type": "object", "properties": {"name": {"type": "string"}, "weight": {"type": "integer"}, "height": {"type": "number"}, "summary": {"type": "string"}, "tags": {"type": "array"}}}
    got = {r.property: (json.loads(r.value), r.confidence, r.source) for r in extraction.by_schema(cands, schema).collect()}
    assert got["name"] == ("Lamp", 0.95, "json_ld") and got["weight"][0] == 12 and got["height"][0] == 30 and got["tags"][0] == ["a"] and "summary" not in got
    assert {r.key: json.loads(r.value) for r in extraction.without_schema(cands).collect()}["title"] in ("Og", "Head")
    values = extraction.by_schema(cands, schema)
    chunks = spark.createDataFrame([(1, "c1", 0, "no"), (1, "c2", 1, "a Lamp of 30 cm"), (1, "c3", 2, "Lamp")], "id int, chunk_id string, position int, text string")
    assert {(r.property, r.chunk_id) for r in extraction.provenance(values, chunks).collect()} >= {("name", "c2"), ("height", "c2")}
    assert extraction.aliases("Headline")[:2] == ["headline", "product_name"]
    assert extraction.validate({"a": "x", "b": 1}, {"type": "object", "required": ["c"], "additionalProperties": False, "properties": {"a": {"type": "string", "minLength": 2}}}) == ["$.c: required", "$.a: shorter than 2", "$.b: not allowed"]
    assert extraction.check_schema({"type": "thing", "properties": {"a": 1}}) == ["$: unknown type thing", "$.a: schema must be an object"]
    assert extraction.schema_hash({"a": 1, "b": 2}) == extraction.schema_hash({"b": 2, "a": 1})
    assert extraction.relaxed_json('Sure:\n```json\n{"a": 1}\n```') == {"a": 1} and extraction.relaxed_json("x [1, 2] y") == [1, 2] and extraction.relaxed_json("none") is None


def test_embedding_cache(spark):
    class Counting(providers.MockEmbedder):
        pass

    df = spark.createDataFrame([("a", "x y"), ("b", " x  y "), ("c", "z"), ("d", None)], "k string, t string")
    got = {r.k: r for r in providers.embed(df, "k", "t", Counting(8)).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].embedding == got["b"].embedding and abs(sum(v * v for v in got["c"].embedding) - 1) < 1e-5
    cache = spark.createDataFrame([(got["a"].hash, [9.0])], "hash string, embedding array<float>")
    assert {r.k: len(r.embedding) for r in providers.embed(df, "k", "t", Counting(8), cache).collect()} == {"a": 1, "b": 1, "c": 8}
    assert providers.signature("s", 1, "p") == providers.signature("s", 1, "p") != providers.signature("s", 2, "p")


def test_batches(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate([5, 5, 9, 20, 1, 1, 1])] + [("e", 0, 99)], "doc string, k int, t int")
    got = {(r.doc, r.k): r.batch for r in providers.batches(df, "k", "t", "doc", most=3, budget=10).collect()}
    assert [got["d", i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 3] and got["e", 0] == 0


def test_sql_functions(spark):
    from skeinlake.functions import sql

    assert "page_markdown" in sql.register(spark)
    spark.createDataFrame([(1, "http://a.test/", "<title>T</title><h1>H</h1><p>x <a href=/y>l</a>"), (2, None, None)], "id int, url string, html string").createOrReplaceTempView("pages_for_sql")
    rows = spark.sql("select id, page_title(html) t, page_markdown(html) m, document_type(url, null, html) d from pages_for_sql order by id").collect()
    assert rows[0].t == "T" and rows[0].m.startswith("# H") and rows[1].t is None
    assert [r.url for r in spark.sql("select l.url from pages_for_sql p, lateral page_link_rows(p.url, p.html) l").collect()] == ["http://a.test/y"]
    assert spark.sql("select * from markdown_chunks('d', '# A\\n\\ntext')").collect()[0].heading_path == ["A"]


def test_results_and_pages(spark, tmp_path):
    df = spark.createDataFrame([("j1", "k1", 1), ("j1", "k2", 2), ("j2", "k3", 3)], "job string, key string, v int")
    storage.save_results(df, str(tmp_path / "r"), ["job"])
    back = storage.load_results(spark, str(tmp_path / "r"), job="j1")
    assert back.count() == 2 and [r.key for r in storage.page_of(back, "key", "k1", 5).collect()] == ["k2"]
    assert {r.key: r.v for r in storage.latest(df.unionByName(spark.createDataFrame([("j1", "k1", 9)], df.schema)), ["key"], [F.desc("v")]).collect()}["k1"] == 9


def test_streams(spark, tmp_path):
    spark.sql("select timestamp'2025-01-01 00:05:00' + make_interval(0,0,0,0,0,id) ts, id % 4 k, 'e' kind from range(20)").write.parquet(str(tmp_path / "in"))
    schema = "ts timestamp, k long, kind string"
    q = streams.to_parquet(streams.dedupe(streams.read(spark, str(tmp_path / "in"), schema), ["k"], "ts", "2 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    seen = []
    q = streams.ingest(streams.read(spark, str(tmp_path / "in"), schema), str(tmp_path / "cp2"), lambda d, i: seen.append((i, d.count())))
    q.awaitTermination(120)
    assert sum(n for _, n in seen) == 20
    q = streams.event_counts(streams.read(spark, str(tmp_path / "in"), schema), "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.events for r in spark.sql("select * from windows").collect()) == 20


def test_json_candidates_walk_whole_arrays():
    found = extraction.json_candidates({"a": [{"x": i} for i in range(60)] + [{"late": 1}]})
    assert sum(k == "x" for k, _, _ in found) == 60 and any(k == "late" for k, _, _ in found)
