"""Functions for users of SQL: Arrow scalar functions and table functions for LATERAL."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf


def register(spark: SparkSession) -> list[str]:
    """Registers ``page_markdown``, ``page_clean_html``, ``page_title``, ``document_type``, ``markdown_chunks``, ``page_link_rows``, ``sitemap_rows``; gives their names."""
    from skeinlake.html import extract, parse_html
    from skeinlake.operators.chunking import chunk_markdown
    from skeinlake.sources import detect, parsers

    def of_page(f):
        def run(html: pd.Series) -> pd.Series:
            return html.map(lambda h: f(parse_html(h)))

        return pandas_udf(run, "string")

    @pandas_udf("string")
    def document_type(url: pd.Series, header: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([detect.detect(u, h, b)["document_type"] for u, h, b in zip(url, header, body)])

    @udtf(returnType="position int, heading_path array<string>, text string, token_count int")
    class MarkdownChunks:
        def eval(self, document_id: str, markdown: str):
            for c in chunk_markdown(document_id or "", markdown):
                yield c["position"], c["heading_path"], c["text"], c["token_count"]

    @udtf(returnType="ordinal int, url string, anchor string, is_external boolean")
    class PageLinks:
        def eval(self, url: str, html: str):
            for i, x in enumerate(extract.links(parse_html(html), url)):
                yield i, x["url"], x["text"], x["is_external"]

    @udtf(returnType="kind string, loc string, lastmod string, changefreq string, priority double")
    class SitemapRows:
        def eval(self, xml: str):
            for e in parsers.parse_sitemap(xml or ""):
                yield e["kind"], e["loc"], e["lastmod"], e["changefreq"], e["priority"]

    scalars = {
        "page_markdown": of_page(lambda t: extract.markdown(extract.main_content(t)[0])),
        "page_clean_html": of_page(lambda t: extract.clean_html(extract.main_content(t)[0])),
        "page_title": of_page(lambda t: extract.metadata(t)["title"]),
        "document_type": document_type,
    }
    tables = {"markdown_chunks": MarkdownChunks, "page_link_rows": PageLinks, "sitemap_rows": SitemapRows}
    for n, f in scalars.items():
        spark.udf.register(n, f)
    for n, f in tables.items():
        spark.udtf.register(n, f)
    return [*scalars, *tables]
