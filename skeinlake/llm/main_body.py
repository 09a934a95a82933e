"""Problem 7: page boilerplate mixed with the main content.

Method: layout-aware rendering. The tree builder closes implied tags, visibility rules drop hidden
parts, and the rest is laid out as text with block spacing, bullets and aligned table cells. Furniture
of the page (menus, notices, side columns, promotions, comments, footers, share and letter prompts,
bylines), recognised by element, role, class, shape and wording, is left out of the layout; the blocks
of the main body are those of which the layout shows text. One layout gives the text and the blocks.

Defined results: null, empty and non-HTML sources have no blocks and give no row; blocks without
text are no blocks of the body; repeated rows of one fetch give the same blocks once; pages of problems
1 and 3 have no main body; extra columns are never read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import pages
from skeinlake.llm.common import map_arrow, written
from skeinlake.llm.residue import residue_kind
from skeinlake.llm.stuffing import FACTS, evidence, phrase_columns, stuffed_pages


def laid_out(fetched: DataFrame, text: bool) -> DataFrame:
    """Rows of ``stuffing.page_facts`` with ``blocks`` and, if wanted, ``text`` of every main body that is no residue."""

    def rows(b):
        out = {k: [] for k in ("fetch_id", "host", "total", "listed", "loose", "blocks", *["text"] * text)}
        words = []
        for f, host, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            page = pages.read_page(h.as_py())
            if not page.blocks or residue_kind(page)[0]:
                continue
            body, blocks = pages.main_body(page)
            if blocks:
                total, listed, loose, *phrases = evidence(page)
                for k, v in zip(out, (f, host, total, listed, loose, blocks, body)):
                    out[k].append(v)
                words.append(phrases)
        return out | phrase_columns(words)

    return map_arrow(fetched.select("fetch_id", "host", "html"), rows, f"{FACTS}, blocks array<int>" + (", text string" if text else ""))


def _kept(fetched: DataFrame, summaries: DataFrame | None, text: bool) -> DataFrame:
    facts = written(laid_out(fetched, text))
    stuffed = stuffed_pages(facts, summaries).select("fetch_id")
    return facts.select("fetch_id", "blocks", *["text"] * text).join(stuffed, "fetch_id", "left_anti")


def main_body(fetched: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """``fetch_id, text, blocks``: the rendered main body of every page that has one, and the numbers of its blocks."""
    return _kept(fetched, summaries, True).groupBy("fetch_id").agg(F.min(F.struct("text", "blocks")).alias("x")).select("fetch_id", "x.*")


def content_blocks(fetched: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """``fetch_id, block_no`` of the main body of pages that are neither residue nor keyword-stuffed."""
    return _kept(fetched, summaries, False).select("fetch_id", F.explode("blocks").alias("block_no")).distinct()
