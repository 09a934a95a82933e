"""Problems 1, 3, 6 and 7: pages read layout-aware."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import main_body, markup, residue, stuffing
from skeinlake.llm.pages import is_furniture, main_body as body_of, read_page

FETCHED = "fetch_id long, host string, html string, near string, density double, text string"
ARTICLE = """<html><head><title>The deep queue - Site</title></head><body>
<header><b>Site</b></header><nav><ul><li><a href="/a">Docs</a></li><li><a href="/b">Blog</a></li></ul></nav>
<main><article><h1>The deep queue</h1><div class="by">A. Writer, 1.2.2025</div>
<p>The queue of the crawler keeps the order in which the pages were found, and that is enough for a small site.
<p>It took two hours until the index was ready, because the hosts allow only a few requests.</p>
<p>Read also: <a href="/x">Another page</a></p><ul class="share"><li><a href="/share?u=1">Share</a></li><li><a href="/share?u=2">Print</a></li></ul>
<div class="box"><h4>Get our letter</h4><p>Thousands read it.</p></div><p>Share this page with your colleagues at Site</p></article></main>
<aside><h3>Related</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>
<div style="display:none"><p>Hidden words.</p></div><footer><p>About us.</p><a href="/c">Contact</a> &middot; <a href="/d">Press</a><p>&copy; 2025 Site</p></footer></body></html>"""
WORDS = "best cheap water filter online discount water filter now buy desk lamp deal printer ink sale "
STUFFED = f"<html><body><div class='post-content'><h1>Water Filter</h1><p>{WORDS * 8}</p><p>{WORDS * 8}</p></div></body></html>"
ERROR = "<html><head><title>Site - Site</title></head><body><h1>Oops!</h1><p>We could not find the page you asked for. Go back to the start page.</p></body></html>"


def frame(spark, rows):
    return spark.createDataFrame([(i, h, t, None, None, None) for i, h, t in rows], FETCHED)


def test_main_body_blocks():
    page = read_page(ARTICLE)
    # li li | h1 p p | p li li h4 p p | h3 li li | p | p p
    assert body_of(page)[1] == [3, 4, 5]


def test_main_body_text(spark):
    rows = main_body.main_body(frame(spark, [(1, "a", ARTICLE), (1, "a", ARTICLE), (2, "a", None), (3, "a", "")])).collect()
    assert [r.fetch_id for r in rows] == [1]
    assert "The queue of the crawler" in rows[0].text and "Related" not in rows[0].text and "Hidden" not in rows[0].text


@pytest.mark.parametrize("html, kind", [
    (ERROR, "error"), (None, ""), ("", ""), ("   ", ""), (ARTICLE, ""),
    ("<html><body><div id=app>Please wait while we load your experience…</div></body></html>", "script"),
    ("<html><body><noscript>You must enable JavaScript.</noscript><div id=root></div></body></html>", "script"),
    (ARTICLE.replace("</article>", "<noscript>Please enable JavaScript.</noscript></article>"), ""),
    (ARTICLE.replace("<h1>The", "<h1>{{page.title}} The"), "placeholder"), (ARTICLE.replace("It took", "${cta_text} It took"), "placeholder"),
    (ARTICLE.replace("It took", "Write <code>{{ title }}</code>. It took"), ""), (ARTICLE.replace("<title>The", "<title>&lt;%= page.title %&gt;"), "placeholder"),
    ("<html><body><h1>Heading</h1><p>Lorem ipsum dolor sit amet tellus. Vitae urna semper magnis.</p></body></html>", "filler"),
    (ARTICLE.replace("It took", "Some hosts say page not found here. It took"), ""), ("\\begin{itemize}\n\\item {x}\n\\end{itemize}", ""),
])
def test_residue_kinds(html, kind):
    assert residue.residue_kind(read_page(html))[0] == kind


@pytest.mark.parametrize("form", ["<?= $title ?>", "FIXME: add text", "TBD: write this", "XXX: fill in", "TODO: describe it", "__PAGE_TITLE__", "*|FNAME|*", "undefined undefined", "@@NAME@@", "%%CTA%%", "NaN%"])
def test_every_placeholder_form(form):
    shown = form.replace("<", "&lt;")
    assert residue.residue_kind(read_page(ARTICLE.replace("It took", f"{shown} It took")))[0] == "placeholder"
    assert residue.residue_kind(read_page(ARTICLE.replace("<title>The", f"<title>{shown} The")))[0] == "placeholder"


def test_residue_operator(spark):
    df = frame(spark, [(1, "a", ERROR), (1, "a", ERROR), (2, "a", ARTICLE), (3, None, None), (None, "a", ERROR)])
    assert sorted((r.fetch_id is None, r.fetch_id) for r in residue.residue(df).collect()) == [(False, 1), (True, None)]
    assert sorted(r.fetch_id for r in residue.without_residue(df).filter("fetch_id is not null").collect()) == [2, 3]
    assert residue.residue(df.limit(0)).count() == 0


def test_stuffed_pages(spark):
    links = "<html><body><main><h1>Offers</h1><ul>" + "".join(f"<li><a href='http://h{i}.test'>cheap desk lamp Place{i}</a></li>" for i in range(30)) + "</ul></main></body></html>"
    hidden = ARTICLE.replace("</article>", f"<div style='position:absolute;left:-9999px'>{WORDS * 20}</div></article>")
    tagged = ARTICLE.replace("</article>", "<div>Tags: <a rel=tag href=/t>desk lamp</a> <a rel=tag href=/u>water filter</a></div></article>")
    rows = [(1, "a", STUFFED), (2, "b", STUFFED), (3, "c", links), (4, "d", hidden), (5, "e", tagged), (6, "f", ARTICLE), (7, "g", None), (8, None, STUFFED), (1, "a", STUFFED), (9, "h", ERROR)]
    got = {r.fetch_id: r for r in stuffing.stuffed(frame(spark, rows)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 8]
    assert got[1].repeated > 0.3 > got[3].repeated and got[1].carried > stuffing.CARRIED > got[3].carried
    assert stuffing.stuffed(frame(spark, [])).count() == 0


def test_content_blocks_leave_out_other_cases(spark):
    got = main_body.content_blocks(frame(spark, [(1, "a", ARTICLE), (2, "a", STUFFED), (3, "a", ERROR), (1, "a", ARTICLE), (4, "b", None)])).collect()
    assert sorted((r.fetch_id, r.block_no) for r in got) == [(1, 3), (1, 4), (1, 5)]
    assert main_body.content_blocks(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text, kinds", [
    (None, []), ("", []), ("  \n", []), ("R&D at A & partners -- 5 people [see note 5] -- agreed.", []), ("It cost $5 in A and $9 elsewhere.", []), ("rock 'n' roll 'years' (1990-2001) were loud.", []),
    ("It makes 8 * 9 * 4 requests.", []), ("Look at #472 and #tag for more.", []), ("If a == b then rows[0][1] stays.", []), (r"max_x_pages is read from C:\temp\x.ini at start.", []), ("The type Vec<Name> holds 3.", []),
    ("while 1 < depth and size > 56 hold", []), ("Hello [Your company], {{page.title}} {% block x %} %%CTA%%", []), ("a <b>c</b>", ["html"]), ("A&nbsp;b", ["html"]), ("x <!-- y --> z", ["html"]), ("a<br/>b", ["html"]),
    ("## Head\n\ntext", ["markdown"]), ("a **b c** d", ["markdown"]), ("[a](/b.md)", ["markdown"]), ("Title\n=====\n", ["markdown"]), ("| a | b |\n|---|:--:|\n| 1 | 2 |", ["markdown"]), ("```rust\nlet x_1 = a[0];\n```", ["markdown"]), ("see `x_1` here", ["markdown"]), ("a[^9] b", ["markdown"]),
    ("== Head ==\ntext", ["wiki"]), ("'''B''' x", ["wiki"]), ("[[A|b]] c", ["wiki"]), ("[[A]]s c", ["wiki"]), ("__TOC__\na", ["wiki"]), ("#REDIRECT [[A]]", ["wiki"]), ('{| class="wikitable"\n! A\n|-\n| 1\n|}', ["wiki"]), ("[https://a.example/ text here]", ["wiki"]),
    (r"\emph{a} \cite{b}", ["latex"]), (r"$z \leq 26$ a", ["latex"]), (r"a \(c_8 < \mu\) b", ["latex"]), (r"\[ s = \sum_{i=1}^{8} \frac{y_i}{7} \]", ["latex"]), (r"$b^{2} + \alpha_{4}$.", ["latex"]),
])
def test_markup_kinds(text, kinds):
    assert markup.markup_kinds(text) == kinds


def test_clean_text_keeps_structure():
    assert markup.clean_text(None) == "" and markup.clean_text(" ") == ""
    assert markup.clean_text("== H ==\n'''a''' [[B|b]]") == "## H\na b"
    assert markup.clean_text("\\section{H}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\\[ x^2 \\]") == "## H\n\n- a\n$$ x^2 $$"
    assert markup.clean_text("<h2>H</h2><ul><li>a<li>b</ul><pre>x\n y</pre>") == "## H\n\n- a\n- b\n\n```\nx\n y\n```"
    assert "**" not in markup.clean_text("a **b** c\n\n```\n**kept**\n```").split("```")[0]


def test_page_markup_by_style_tree(spark):
    page = lambda i, body: f"<html><body><div class='c'><h1>T{i}</h1><p>Text {i} {body}</p><pre>## no heading</pre></div><div class='f'><p>**all pages** have this</p></div></body></html>"
    rows = [(i, "h", page(i, "[[A|b]] here" if i == 3 else "plain")) for i in range(8)] + [(20, "h", "## Source\n\nno page"), (21, None, page(21, "$x^{2}$")), (22, "h", None), (3, "h", page(3, "[[A|b]] here"))]
    got = sorted((r.fetch_id, r.markup) for r in markup.page_markup(frame(spark, rows)).collect())
    # the footer's markdown stands on every page of the host, so its branch is removed
    assert got == [(3, "wiki"), (20, "markdown"), (21, "latex"), (21, "markdown")]
    assert markup.page_markup(frame(spark, [])).count() == 0
    texts = {r.fetch_id: r.text for r in markup.clean_pages(frame(spark, rows)).collect()}
    assert "Text 3 b here" in texts[3] and "all pages" not in texts[3]


def test_clean_pages_keep_order_marks_and_code(spark):
    page = lambda i: (
        f"<html><body><nav><ul><li><a href=/>Start</a></li><li>Docs</li></ul></nav><div><h1>First {i}</h1><p>Say {i} <code>a_{i} **b**</code> and **bold {i}**.</p><ul><li>one {i}<li>two {i}</ul>"
        f"<h2>Second {i}</h2><p>Then {i}</p><pre>if x:\n\n\n    [[y|z]] = {i}</pre><p>End {i} [[A|b]]</p></div></body></html>"
    )
    texts = {r.fetch_id: r.text for r in markup.clean_pages(frame(spark, [(i, "h", page(i)) for i in range(6)] + [(9, "h", None)])).collect()}
    assert texts[2] == "# First 2\n\nSay 2 `a_2 **b**` and bold 2.\n\n- one 2\n- two 2\n\n## Second 2\n\nThen 2\n\n```\nif x:\n\n\n    [[y|z]] = 2\n```\n\nEnd 2 b"
    assert len(texts) == 7 and texts[9] == ""


def test_repeated_fetches_count_once(spark):
    page = "<html><body><div class='own'><p>Only **here** is this.</p></div></body></html>"
    df = frame(spark, [(1, "h", page), (1, "h", page), (2, "h", "<html><body><p>Other</p></body></html>"), (3, "s", "## Source"), (3, "s", "## Source")])
    tree = markup.style_tree(markup.page_branches(df)).collect()
    assert all(r.pages == 1 and r.importance == 1 for r in tree)
    assert sorted((r.fetch_id, r.markup) for r in markup.page_markup(df).collect()) == [(1, "markdown"), (3, "markdown")]
    assert {r.fetch_id: r.text for r in markup.clean_pages(df).collect()} == {1: "Only here is this.", 2: "Other", 3: "## Source"}


def test_document_markup(spark):
    df = spark.createDataFrame([("a", "x **b c** d", 1), ("a", "x **b c** d", 1), ("b", None, 2), ("c", "", 3), (None, "== H ==", 4)], "document_id string, text string, markup int")
    assert sorted((r.document_id or "", r.markup) for r in markup.document_markup(df).collect()) == [("", "wiki"), ("a", "markdown")]
    assert markup.clean_documents(df).filter("document_id = 'a'").collect()[0].text == "x b c d"


def test_long_and_broken_pages():
    deep = "<html><body>" + "<div>" * 3000 + "text <p>word" + "</div>" * 10
    assert body_of(read_page(deep))[1] == [1]
    assert read_page("<p a='>x" * 500).segments is not None
    assert read_page("<html><body><p>" + "word " * 200_000).blocks[0][1]


def test_residue_sentences_of_any_length():
    long = "We could not " + "open the page that you asked for and " * 8 + "so you see this."
    assert residue.residue_kind(read_page(f"<html><body><p>{long}</p></body></html>"))[0] == "error" and len(long.split()) > 50
    filler = "Vitae tellus rerum magnis ligula corpus urna dolorum. Novis latum orae porta cordis pretium semper vestis."
    assert residue.residue_kind(read_page(f"<html><body><h1>Heading</h1><p>{filler}</p></body></html>"))[0] == "filler"
    for text in ("La ventana de la casa es blanca y la puerta no.", "Gratis gartenhaus billigkredit armbanduhr server miete.", "Il museo apre alle nove e chiude la sera."):
        assert residue.residue_kind(read_page(f"<html><body><p>{text}</p></body></html>"))[0] == ""


def test_furniture_of_any_length():
    for n in (1, 8, 40):
        prompt = "Share this page with " + "your friends and " * n + "all others"
        assert is_furniture(prompt) and body_of(read_page(f"<html><body><h1>Title</h1><p>Text of the page.</p><p>{prompt}</p></body></html>"))[1] == [1, 2]
    assert not is_furniture("Share this page. Then we go on with the text. And there is one more sentence here.")


def test_formulas_and_heads_of_any_length():
    for n in (5, 150, 600):
        body = "x_1 + " * n + "y"
        assert "latex" in markup.markup_kinds(f"Text $${body}$$ more") and "latex" in markup.markup_kinds(f"Text ${body}$ more")
        assert "latex" in markup.markup_kinds(f"Text\n\\[\n{body}\n\\]\nmore") and "latex" not in markup.markup_kinds(f"It costs $$ a\n\n{body} b $$ ")
    head = "<meta name='a'>" * 40
    assert [b[0] for b in markup.branches(f"{head}<body><p>**Bold**</p></body>")] != [0] and markup.branches("# Title\n\n`<body>` is a tag")[0][0] == 0


def test_style_tree_decides(spark):
    """Markup that stands only in a branch that every page of the host repeats is dropped with the branch."""
    page = "<html><body><div class='main'><p>Page {} says {}.</p></div><div class='foot'><p>Read the **terms** of use</p></div></body></html>"
    rows = [(i, "h.test", page.format(i, "a **bold** word" if i < 3 else f"number {i} of them")) for i in range(12)]
    rows += [(99, "other.test", page.format(99, "nothing"))]  # seen on one page only: content like any other
    df = frame(spark, rows)
    assert {r.fetch_id for r in markup.page_markup(df).collect()} == {0, 1, 2, 99}
    assert markup.page_branches(df).filter("size(kinds) > 0").select("fetch_id").distinct().count() == 13  # without the tree
    texts = {r.fetch_id: r.text for r in markup.clean_pages(df).collect()}
    assert "terms" not in texts[5] and "number 5" in texts[5] and "terms" in texts[99]


def test_hosts_of_phrases_decide(spark):
    """The same list-like facts are flagged or not by whether other hosts have their phrases; loose evidence needs that hardly any has."""
    schema = "fetch_id long, host string, total int, listed int, loose int, shingles int, repeated int, phrases array<long>"
    facts = [(1, "a", 100, 90, 90, 50, 0, [1, 2, 3, 4]), (2, "b", 100, 90, 90, 50, 0, [11, 12, 13, 14]), (3, "c", 100, 90, 90, 50, 40, [1, 2, 3, 4]), (4, "d", 100, 10, 60, 50, 0, [21, 22, 23, 24]), (5, "e", 100, 10, 60, 50, 0, [1, 22, 33, 34]),
             (6, "f", 100, 40, 40, 50, 0, [41, 42, 43, 44]), (7, "g", 100, 40, 40, 50, 0, [51, 52, 53, 54]), (8, None, 100, 0, 0, 50, 0, [1, 2, 3, 4]), (1, "a", 100, 90, 90, 50, 0, [1, 2, 3, 4])]
    links = spark.createDataFrame([(6, [("u", "one two three")] * 50), (6, None), (7, [("u", None)] * 50), (None, None)], "fetch_id long, links array<struct<url:string,anchor:string>>")
    df = spark.createDataFrame(facts, schema)
    assert {r.fetch_id for r in stuffing.stuffed_pages(df, links).collect()} == {2, 3, 4, 6}
    assert {r.fetch_id for r in stuffing.stuffed_pages(df).collect()} == {2, 3, 4}
    everywhere = df.unionByName(df.withColumn("host", F.lit("x"))).unionByName(df.withColumn("host", F.lit("y")))
    assert {r.fetch_id for r in stuffing.stuffed_pages(everywhere, links).collect()} == {3}  # all phrases on three hosts


def test_fingerprints_are_shared():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 60, 50).astype(np.uint64), rng.integers(0, 1 << 60, 50).astype(np.uint64)
    for at in (0, 17, 40):
        assert set(stuffing.winnowed(np.concatenate([a, b[at : at + 4]]))) & set(stuffing.winnowed(np.concatenate([b[at : at + 4], a[::-1]])))
    assert list(stuffing.phrase_hashes([["x"], list("abcdefg"), ["x"]]))[0] == list(stuffing.phrase_hashes([["x"], list("abcdefg"), ["x"]]))[-1]
    assert len(stuffing.phrase_hashes([["x"], list("abcdefg")])) == 4 and len(stuffing.phrase_hashes([])) == 0


def test_every_phrase_counts(spark):
    """The carried share is exact: phrases are neither sampled nor windowed, whoever repeats them."""
    words = [a + b + "x" for a in "bcdfghkl" for b in "aeioumnr"]
    page = lambda w: f"<html><body><main><h1>x</h1><p>{' '.join(w)}</p></main></body></html>"
    rows = [(1, "a", page(words)), (1, "a", page(words)), (2, "b", page(words[:20])), (3, "c", page(words[:20])), (4, "c", page(words[18:40])), (5, "d", page(words[50:55])), (6, "e", page(words[50:55])), (None, "f", page(words[30:40]))]
    df = frame(spark, rows)
    facts = {r.fetch_id: r for r in stuffing.page_facts(df).collect()}
    assert facts[1].shingles == len(facts[1].phrases) == 61 and facts[2].shingles == len(facts[2].phrases) == 17  # the heading is one
    want = {1: 16 + 1 + 1 + 6, 2: 17, 3: 17, 4: 6 + 1, 5: 2, 6: 2}
    counted = stuffing.carried_phrases(stuffing.page_facts(df.repartition(3)), F.lit(True)).collect()
    assert {r.fetch_id: r.hits for r in counted} == want
    got = {r.fetch_id: r.carried for r in stuffing.stuffed(df).collect()}
    assert got[1] == want[1] / 61


def test_short_texts_are_phrases():
    rng = np.random.default_rng(3)
    texts = [[str(x) for x in rng.integers(0, 3, n)] for n in rng.integers(1, 9, 200)]
    runs = [tuple(t[i : i + 5]) for t in texts for i in range(max(1, len(t) - 4))]
    hashes = stuffing.phrase_hashes(texts).tolist()
    assert len(hashes) == len(runs) and len(set(zip(hashes, runs))) == len(set(hashes)) == len(set(runs))


def test_plain_text_is_not_cut_into_sentences(monkeypatch):
    """Sentences are looked at only where wording, whole headings or Latin words can mark some; what decides stays the same."""
    plain = "The lamp on the desk gives a warm light. " * 20
    for end in (". ", "! ", "\n", " | ", " · ", "。 ", "… "):
        marked = end.join(["Page not found", "Access denied", "été 404 Not Found"] * 12)
        assert residue.coverage(marked)[0] > 0.5 and residue.coverage(plain[:200] + end + marked)[1]["error"] >= 50
        assert residue._may_be_whole(residue.fold(plain + end + "Loading:" + end + plain))
    monkeypatch.setattr(residue, "_SENTENCE", None)
    assert residue.coverage(plain) == (0.0, {}) and residue.coverage(plain.replace("lamp", "Lämpchen")) == (0.0, {})


def test_placeholders_are_sought_once_a_page(monkeypatch):
    """Texts are searched for placeholders only where the page has a sign of one; which page is a placeholder stays the same."""
    import html

    for sign in ("{{ name }}", "%%NAME%%", "[INSERT NAME]", "<?php echo 1 ?>", "__MSG_NAME__", "*|NAME|*", "TODO: write this"):
        assert residue.residue_kind(read_page(ARTICLE.replace("</article>", f"<p>{html.escape(sign)}</p></article>")))[0] == "placeholder"
    calls, real = [], residue._has_placeholder
    monkeypatch.setattr(residue, "_has_placeholder", lambda *a: calls.append(a) or real(*a))
    assert residue.residue_kind(read_page(ARTICLE))[0] == "" and len(calls) == 1  # the title
