"""Page operators over tables of fetched documents: only the wanted features are computed, in one narrow stage."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from skeinlake.functions.arrow import map_rows
from skeinlake.html import extract, parse_html
from skeinlake.sources import detect, parsers

FEATURES = {
    "title": "string", "description": "string", "language": "string", "canonical_url": "string", "author": "string", "published_time": "string", "main_html": "string", "clean_html": "string", "markdown": "string", "text": "string",
    "links": "array<struct<url:string,text:string,rel:array<string>,is_external:boolean>>", "images": "array<struct<url:string,alt:string,title:string,width:int,height:int,srcset:string,loading:string>>",
    "headings": "array<struct<level:int,text:string,id:string>>", "json_ld": "array<string>", "definitions": "array<struct<term:string,description:string>>", "open_graph": "map<string,string>", "twitter": "map<string,string>", "warnings": "array<string>",
}
_META = {"title", "description", "language", "canonical_url", "author", "published_time", "open_graph", "twitter"}


def page_features(pages: DataFrame, key: str, url: str, html: str, wanted: list[str]) -> DataFrame:
    """``key`` and the wanted features of every page; one parse serves all of them, none is computed unasked."""
    wanted = [w for w in FEATURES if w in set(wanted)]
    need = set(wanted)

    def one(k, u, h):
        root = parse_html(h)
        out = {key: k}
        warnings: list[str] = []
        if need & _META:
            out |= {n: v for n, v in extract.metadata(root, u).items() if n in need}
        if need & {"main_html", "clean_html", "markdown", "text"}:
            node, warnings = extract.main_content(root)
            if "main_html" in need or "clean_html" in need:
                clean = extract.clean_html(node)
                out |= {"main_html": clean, "clean_html": clean}
            if "markdown" in need:
                out["markdown"] = extract.markdown(node)
            if "text" in need:
                out["text"] = " ".join(node.text(" ").split())
        if "links" in need:
            out["links"] = extract.links(root, u)
        if "images" in need:
            out["images"] = extract.images(root, u)
        if "headings" in need:
            out["headings"] = extract.headings(root)
        if "json_ld" in need:
            values, more = extract.json_ld(root)
            out["json_ld"] = [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in values]
            warnings = warnings + more
        if "definitions" in need:
            out["definitions"] = [{"term": a, "description": b} for a, b in extract.definitions(root)]
        if "warnings" in need:
            out["warnings"] = warnings
        return out

    kind = dict(pages.select(key).dtypes)[key]
    return map_rows(pages.select(key, url, html), one, f"{key} {kind}, " + ", ".join(f"{w} {FEATURES[w]}" for w in wanted))


def content_types(pages: DataFrame, key: str, url: str, header: str, body: str) -> DataFrame:
    """``key, document_type, mime, charset, confidence, reason`` of every body."""
    kind = dict(pages.select(key).dtypes)[key]
    return map_rows(pages.select(key, url, header, body), lambda k, u, c, b: {key: k, **detect.detect(u, c, b)}, f"{key} {kind}, document_type string, mime string, charset string, confidence double, reason string")


def parsed_documents(pages: DataFrame, key: str, url: str, header: str, body: str) -> DataFrame:
    """``key, document_type`` and the parsed document of every body, whatever its format."""
    kind = dict(pages.select(key).dtypes)[key]

    def one(k, u, c, b):
        t = detect.detect(u, c, b)["document_type"]
        return {key: k, "document_type": t, **parsers.parse(t, b or "")}

    return map_rows(pages.select(key, url, header, body), one, f"{key} {kind}, document_type string, {parsers.DOCUMENT}")


def render_decisions(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Counts, signs, score and decision of whether each page needs a browser."""
    kind = dict(pages.select(key).dtypes)[key]

    def one(k, h):
        root = parse_html(h)
        return {key: k, **extract.render_facts(h or "", len(extract.clean_html(extract.main_content(root)[0]).encode()))}

    return map_rows(pages.select(key, html), one, f"{key} {kind}, paragraphs int, scripts int, links int, visible_text int, empty_root boolean, js_notice boolean, frameworks array<string>, placeholder boolean, score int, browser boolean")


def sitemap_entries(maps: DataFrame, key: str, xml: str) -> DataFrame:
    """``key, kind, loc, lastmod, changefreq, priority`` of every entry of sitemap bodies."""
    kind = dict(maps.select(key).dtypes)[key]
    return map_rows(maps.select(key, xml), lambda k, x: [{key: k, **e} for e in parsers.parse_sitemap(x or "")], f"{key} {kind}, kind string, loc string, lastmod string, changefreq string, priority double")


def link_edges(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``key, ordinal, url, anchor``: the edge table of the pages' links."""
    return page_features(pages, key, url, html, ["links"]).select(key, F.posexplode("links").alias("ordinal", "x")).select(key, "ordinal", F.col("x.url").alias("url"), F.col("x.text").alias("anchor"))
