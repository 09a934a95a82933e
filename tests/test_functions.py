"""URL, text and robots functions."""
import pytest
from pyspark.sql import functions as F

from skeinlake.functions import robots, text as T, url as U
from skeinlake.operators import retrieval as R


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize("url, want", [
    ("HTTP://Example.COM:80/docs/../docs/index.html#intro", "http://example.com/docs/index.html"), ("https://a.test:443", "https://a.test/"), ("https://a.test:8443/x", "https://a.test:8443/x"),
    ("http://a.test/p?b=2&utm_source=x&a=1&REF=q", "http://a.test/p?a=1&b=2"), ("http://a.test/p?a=1&a=2", "http://a.test/p?a=2"), ("http://a.test/p/?utm_id=1", "http://a.test/p/"), ("http://a.test/a/./b/../../c/", "http://a.test/c/"),
    ("http://u:p@a.test/x y", "http://a.test/x y"), ("no url", None), ("", None), (None, None),
])
def test_normalize(spark, url, want):
    assert one(spark, url, U.normalize) == want
    if want:
        assert one(spark, want, U.normalize) == want  # idempotent


@pytest.mark.parametrize("url, want", [(None, "empty"), (" ", "empty"), ("javascript:x", "scheme"), ("ftp://a.test", "scheme"), ("http:///x", "host"), ("https://a.test", None)])
def test_syntax_error(spark, url, want):
    assert one(spark, url, U.syntax_error) == want


@pytest.mark.parametrize("pattern, path, want", [
    ("/docs/**", "/docs/a/b", True), ("/docs/*", "/docs/a/b", False), ("/docs/?", "/docs/a", True), ("**/b", "/x/b", True), ("**/b", "ab", True), ("/a.b", "/axb", False), ("/*/end", "/x/end", True),
])
def test_glob(spark, pattern, path, want):
    assert one(spark, path, lambda c: c.rlike(U.glob_regex(pattern))) is want


@pytest.mark.parametrize("includes, excludes, path, want", [
    ([], [], "/a", True), (["/a/**"], [], "/a/b", True), (["/a/**"], ["/a/b"], "/a/b", False), ([" "], [], "/a", False), ([], [" "], "/a", True), (["/a"], [], "a", True),
])
def test_path_allowed(spark, includes, excludes, path, want):
    assert one(spark, path, lambda c: U.path_allowed(c, includes, excludes)) is want


@pytest.mark.parametrize("host, want", [
    ("localhost", True), ("x.localhost", True), ("db.internal", True), ("10.1.2.3", True), ("100.64.0.1", True), ("100.128.0.1", False), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True), ("169.254.169.254", True),
    ("198.18.0.1", True), ("203.0.113.9", True), ("224.0.0.1", True), ("255.255.255.255", True), ("8.8.8.8", False), ("example.org", False), ("[::1]", True), ("[fd00::1]", True), ("[2606:4700::1]", False), (None, False),
])
def test_blocked_host(spark, host, want):
    assert one(spark, host, U.blocked_host) is want


def test_assets_domains_classes(spark):
    assert one(spark, "http://a.test/x.PNG?y", U.is_static_asset) is True
    assert one(spark, "http://a.test/x.pdf", lambda c: U.is_static_asset(c, ["pdf"])) is False
    assert one(spark, "http://docs.a.test/x", lambda c: U.same_domain(F.lit("https://A.test"), c)) is False
    assert one(spark, "http://docs.a.test/x", lambda c: U.same_domain(F.lit("https://A.test"), c, True)) is True
    assert one(spark, "http://evila.test/x", lambda c: U.same_domain(F.lit("https://a.test"), c, True)) is False
    assert one(spark, None, lambda c: U.is_external(F.lit("http://a.test"), c)) is True
    for u, want in (("https://x.gov/a", "government"), ("https://docs.x.test/", "documentation"), ("https://x.test/api/y", "documentation"), ("https://github.com/a", "repository"), ("https://x.test/", "primary"), ("x", "unknown")):
        assert one(spark, u, U.source_class) == want


ROBOTS = "User-agent: Googlebot\nDisallow: /private\n# note\nUser-agent: *\nAllow: /admin/open\nDisallow: /admin\nDisallow: /same\nAllow: /same\nCrawl-delay: 2.5\nSitemap: https://a.test/s.xml\nSitemap: /rel.xml\nDisallow:\n"


@pytest.mark.parametrize("agent, path, want", [
    ("googlebot/2", "/private/x", False), ("googlebot/2", "/admin", True), ("other", "/admin/x", False), ("other", "/admin/open/y", True), ("other", "/same", False), ("other", "/", True), ("other", "/private", True),
])
def test_robots(spark, agent, path, want):
    assert one(spark, ROBOTS, lambda c: robots.allowed(robots.parse(c), F.lit(path), agent)) is want


def test_robots_facts(spark):
    assert one(spark, ROBOTS, lambda c: robots.delay_ms(robots.parse(c), "other")) == 2500
    assert one(spark, ROBOTS, lambda c: robots.parse(c)["sitemaps"]) == ["https://a.test/s.xml"]
    assert one(spark, None, lambda c: robots.allowed(robots.parse(c), F.lit("/x"), "any")) is True


@pytest.mark.parametrize("text, want", [("", 0), ("   ", 1), ("hello", 2), ("one two three", 4), (None, None)])
def test_tokens(spark, text, want):
    assert one(spark, text, T.approx_tokens) == want


def test_index_tokens(spark):
    assert one(spark, "set MAX_CONCURRENT_FETCHES, now!", T.index_tokens) == ["set", "max_concurrent_fetches", "max", "concurrent", "fetches", "now"]
    assert one(spark, "", T.index_tokens) == []
    assert R.query_tokens("MAX_CONCURRENT_FETCHES a") == ["max_concurrent_fetches", "max", "concurrent", "fetches", "a"]


def test_hashes_ignore_space(spark):
    assert one(spark, " a \n b ", T.chunk_hash) == one(spark, "a b", T.chunk_hash) != one(spark, "ab", T.chunk_hash)
    assert one(spark, " a \n\n b ", T.page_hash) == one(spark, "a\nb", T.page_hash) != one(spark, "a b", T.page_hash)


def test_simhash_near_and_far(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base.replace("word7 ", "changed ")), (3, " ".join(f"other{i}" for i in range(60))), (4, ""), (5, None), (6, base)]
    got = {r.k: r.fingerprint for r in T.simhash(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert set(got) == {1, 2, 3, 4, 6} and got[4] == 0 and got[1] == got[6]
    bits = lambda a, b: bin(a ^ b).count("1")
    assert bits(got[1], got[2]) <= 12 and bits(got[1], got[3]) >= 18


def test_snippet_is_unicode_safe(spark):
    text = "é" * 100 + " Needle " + "ü" * 200
    got = one(spark, text, lambda c: T.snippet(c, ["needle"]))
    assert got.startswith("...") and "Needle" in got and got.endswith("...") and len(got) <= 130
    assert one(spark, "short", lambda c: T.snippet(c, ["x"])) == "short"


def test_link_score(spark):
    df = spark.createDataFrame([("Retry policy", "/docs/retry-policy.html"), ("Other", "/x"), (None, None)], "t string, p string")
    got = [r.s for r in df.select(T.link_score(["retry", "policy"], F.col("t"), F.col("p"), F.lit(None).cast("string")).alias("s")).collect()]
    assert got == [0.87, 0.01, 0.01]


def test_expand_query():
    assert T.expand_query("How do I retry the fetch") == ["How do I retry the fetch", "retry fetch"]
    assert T.expand_query("retry fetch") == ["retry fetch"]


def test_scalars(spark):
    for v, want in (("12", "integer"), ("-1.5e3", "number"), ("TRUE", "boolean"), ("null", "null"), (None, "null"), ("x1", "string")):
        assert one(spark, v, T.parse_scalar) == want
