"""HTML extraction, content detection, parsers, and the entry points."""
import gzip
import io
import zipfile

import pytest

from skeinlake.html import extract, parse_html
from skeinlake.html.layout import render
from skeinlake.operators import pages
from skeinlake.sources import detect, parsers

PAGE = """<!doctype html><html lang=de><head><title>T &amp; t</title><meta name=description content="D"><meta property="og:title" content="O1"><meta property="og:title" content="O2">
<link rel=canonical href="/c"><script type="application/ld+json">[{"a":1},{"@graph":[{"b":2}]}]</script><script type="application/ld+json">{bad</script></head>
<body><nav class=menu><a href="/n">Nav</a></nav><article class=post><h1 id=top>Head</h1><p>One <b>bold</b> <a href="../x?y=1#z">link</a><p>Two<br>lines<ul><li>a<ul><li>b</ul><li>c</ul>
<pre><code class="language-py">x = 1
y</code></pre><table><tr><th>A<th>B<tr><td>1<td>2|3</table><blockquote>Q</blockquote><img src=i.png alt=I><img data-src="/j.png" width=1 height=1><a href="javascript:x">no</a><a href="https://other.test:443/q">out</a><a href="../x?y=1#z">again</a></article></body>"""


def test_tree_repairs():
    t = parse_html("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>1<td>2<tr><td>3</table><div>e</p>f</div></i>g<!-- x --><script>if (a<b) {}</script>")
    assert [n.tag for n in t.nodes] == ["p", "p", "ul", "li", "li", "table", "tr", "td", "td", "tr", "td", "div", "script"]
    assert t.nodes[2].parent is t and t.nodes[9].parent is t.nodes[5] and t.text() == "abcd123efg"
    for bad in (None, "", "<", "<a", "<a href='x", "</", "<p <b>", "\x00<p>", "<" * 5000):
        parse_html(bad)


def test_metadata_links_images_headings_json():
    t = parse_html(PAGE)
    m = extract.metadata(t, "http://a.test/d/p")
    assert (m["title"], m["description"], m["language"], m["canonical_url"], m["open_graph"]) == ("T & t", "D", "de", "http://a.test/c", {"title": "O2"})
    links = extract.links(t, "http://a.test/d/p")
    assert [(x["url"], x["text"], x["is_external"]) for x in links] == [("http://a.test/n", "Nav", False), ("http://a.test/x?y=1#z", "link", False), ("https://other.test/q", "out", True)]
    assert [x["url"] for x in extract.images(t, "http://a.test/d/p")] == ["http://a.test/d/i.png", "http://a.test/j.png"]
    assert extract.headings(t) == [{"level": 1, "text": "Head", "id": "top"}]
    values, warnings = extract.json_ld(t)
    assert values == [{"a": 1}, {"@graph": [{"b": 2}]}, {"b": 2}] and len(warnings) == 1


def test_markdown_and_clean():
    node, warnings = extract.main_content(parse_html(PAGE.replace("Two<br>", "Two " + "words " * 40 + "<br>")))
    assert node.tag == "article" and not warnings
    md = extract.markdown(parse_html(PAGE))
    for part in ("# Head", "One **bold** [link](../x?y=1#z)", "Two  \nlines", "- a\n  - b\n- c", "```py\nx = 1\ny\n```", "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |", "> Q", "![I](i.png)"):
        assert part in md
    clean = extract.clean_html(parse_html('<div onclick=x class=y><script>z</script><p style="display:none">h</p><form>f</form><custom><b>k</b></custom><img src=p width=1 height=1></div>'))
    assert clean == "<div><b>k</b></div>"
    assert extract.main_content(parse_html("<p>x"))[1] == ["missing_main_content"]


def test_render_layout():
    assert render(parse_html("<h1>A</h1><p>b c<ul><li>x<li>y</ul><div hidden>q</div>")) == "A\n\nb c\n\n- x\n- y\n\nq"


def test_render_decision():
    spa = '<html><body><div id="root"></div><noscript>You need to enable JavaScript to run this app.</noscript></body></html>'
    assert extract.render_facts(spa, 0)["browser"] is True
    assert extract.render_facts("<html><body>" + "<p>some words here</p>" * 200 + "</body></html>", 900)["browser"] is False


@pytest.mark.parametrize("url, header, body, kind, confidence", [
    ("http://a/x", None, b"%PDF-1.4", "pdf", 1.0), (None, None, b'{"a": 1}', "json", 0.95), (None, None, b"{bad", "plain_text", 0.5), (None, None, b'<?xml version="1.0"?><rss>', "rss", 0.95), (None, None, b'<feed xmlns="http://www.w3.org/2005/Atom">', "atom", 0.95),
    (None, "text/plain", b"<!DOCTYPE html><html>", "html", 0.95), (None, None, b"<?xml version='1.0'?><a/>", "xml", 0.9), ("http://a/x.csv", None, b"a,b\n1,2\n", "csv", 0.85), (None, None, b"a\tb\n1\t2\n", "tsv", 0.85), ("http://a/x", "application/vnd.x+json; charset=UTF-8", b"x", "json", 0.8),
    ("http://a/x.md?q", None, b"words", "plain_text", 0.7), (None, None, b"\x00\x01\x02", "unknown", 0.3), (None, None, None, "plain_text", 0.5), (None, "TEXT/HTML", b"", "html", 0.8),
])
def test_detect(url, header, body, kind, confidence):
    got = detect.detect(url, header, body)
    assert (got["document_type"], got["confidence"]) == (kind, confidence)


def test_decode():
    assert detect.decode("é".encode("latin-1")) == ("é", ["charset_fallback"]) and detect.decode(b"\xef\xbb\xbfa") == ("a", []) and detect.decode("é".encode("latin-1"), "x; charset=iso-8859-1") == ("é", [])


def test_json_xml_feed_table_text():
    j = parsers.parse_json('{"title": "T", "items": [{"p": 1, "n": "a"}, {"p": 5, "n": "b"}], "u": "https://a.test/x"}')
    assert j["title"] == "T" and j["links"] == ["https://a.test/x"] and "**items**" in j["markdown"]
    assert parsers.parse_json('{"a": [{"p": 1}, {"p": 5}]}', "$.a[?(@.p>2)]")["json"] == '{"p": 5}' and parsers.parse_json('{"a": [1, 2]}', "$.a[*]")["json"] == "[1, 2]"
    assert parsers.parse_json("{")["warnings"] == ["invalid_json"] and parsers.parse_json("[" * 70 + "]" * 70)["warnings"] == ["json_too_deep"]
    x = parsers.parse_xml('<r xmlns="n"><title>A</title><b href="http://l">t</b></r>')
    assert (x["title"], x["text"], x["links"]) == ("A", "A t", ["http://l"]) and parsers.parse_xml("<r>")["warnings"] == ["invalid_xml"]
    f = parsers.parse_feed("<rss><channel><title>F</title><item><title>I</title><link>http://i</link><category>c</category><description>d</description></item></channel></rss>")
    assert f["title"] == "F" and f["links"] == ["http://i"] and '"categories": ["c"]' in f["json"]
    a = parsers.parse_feed('<feed xmlns="http://www.w3.org/2005/Atom"><title>G</title><entry><title>E</title><link href="http://e"/><author><name>N</name></author></entry></feed>')
    assert a["links"] == ["http://e"] and '"author": "N"' in a["json"]
    assert parsers.sniff_delimiter("a;b;c,d") == ";" and parsers.sniff_delimiter("a;b,c") == ","
    c = parsers.parse_delimited("a,b\n1\n2,3,4\n")
    assert c["tables"][0]["headers"] == ["a", "b"] and c["json"] == '[{"a": "1", "b": ""}, {"a": "2", "b": "3"}]'
    assert parsers.parse_text("see https://a.test/x.\r\nb")["links"] == ["https://a.test/x"] and parsers.parse_delimited("")["warnings"] == ["empty_table"]


def test_sitemaps():
    xml = '<urlset xmlns="s"><url><loc> http://a/1 </loc><priority>0.5</priority><lastmod>2025</lastmod></url><url><loc>http://a/2</loc></url><url><loc>http://a/3'
    got = parsers.parse_sitemap(xml)
    assert [(e["kind"], e["loc"], e["priority"]) for e in got] == [("url", "http://a/1", 0.5), ("url", "http://a/2", None)]
    assert parsers.parse_sitemap(gzip.compress(b"<sitemapindex><sitemap><loc>http://a/s</loc></sitemap></sitemapindex>"))[0]["kind"] == "sitemap"
    assert parsers.parse_sitemap("") == [] == parsers.parse_sitemap(b"\x1f\x8bxx")


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", doc)
    got = parsers.parse_docx(b.getvalue())
    assert got["markdown"] == "# H\n\n**bold**\n\n| a |\n| --- |\n| 1 |" and parsers.parse_docx(b"x")["warnings"] == ["invalid_docx"]


def test_page_operators(spark):
    df = spark.createDataFrame([(1, "http://a.test/d/p", "text/html", PAGE), (2, None, None, None), (3, "http://a.test/x.json", None, '{"a": 1}')], "k int, url string, ct string, html string")
    got = {r.k: r for r in pages.page_features(df, "k", "url", "html", ["title", "links", "markdown"]).collect()}
    assert got[1].title == "T & t" and len(got[1].links) == 3 and got[2].title is None and got[2].links == []
    assert {r.k: r.document_type for r in pages.content_types(df, "k", "url", "ct", "html").collect()} == {1: "html", 2: "plain_text", 3: "json"}
    assert {r.k: r.document_type for r in pages.parsed_documents(df, "k", "url", "ct", "html").collect()}[3] == "json"
    assert pages.link_edges(df, "k", "url", "html").count() == 3 and pages.render_decisions(df.limit(0), "k", "html").count() == 0
    maps = spark.createDataFrame([(1, "<urlset><url><loc>http://a/1</loc></url></urlset>"), (2, None)], "k int, x string")
    assert [r.loc for r in pages.sitemap_entries(maps, "k", "x").collect()] == ["http://a/1"]


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
