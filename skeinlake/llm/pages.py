"""Layout-aware reading of a page: visible segments, numbered blocks and what is boilerplate.

One pass over the tree gives a list of segments (runs of text between block boundaries). Each
knows its block number, how much of it is link text, whether it is hidden and which kind of
boilerplate it lies in, if any. Problems 1, 3, 6 and 7 all read pages through this module.
"""
from __future__ import annotations

import re

from skeinlake.html.layout import render
from skeinlake.html.tree import Node, parse_html

# fixed values: element classes and wording of page furniture, several languages
NUMBERED = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = NUMBERED | frozenset(
    "address article aside body br button caption center details dialog div dl figcaption figure footer form header "
    "hr html legend main menu nav noscript ol option section summary table tbody td tfoot th thead tr ul #root".split()
)
CONTAINER = frozenset("div section table td center aside nav header footer form dialog main article ul ol dl figure font".split())
SKIP = frozenset("script style template head iframe svg object select textarea noembed noframes xmp".split())
JUNK_TAG = {"nav": "nav", "aside": "side", "footer": "footer", "dialog": "notice", "button": "notice", "menu": "nav"}
JUNK_ROLE = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "dialog": "notice", "alertdialog": "notice", "complementary": "side", "search": "nav"}
JUNK_CLASS = {
    t: kind
    for kind, terms in {
        "nav": "nav navbar navigation menu topmenu breadcrumb breadcrumbs pagination pager toolbar",
        "side": "sidebar aside widget related recommended recommendations trending",
        "footer": "footer foot colophon copyright",
        "header": "header masthead topbar",
        "notice": "cookie cookies consent gdpr cc modal popup overlay",
        "comments": "comments comment replies reply responses respond disqus",
        "share": "share sharing social sharebar",
        "promo": "promo ad ads advert advertisement sponsor sponsored newsletter subscribe signup cta banner",
        "byline": "by byline author dateline",
    }.items()
    for t in terms.split()
}
GOOD_CLASS = frozenset("content article post entry main story".split())
COUNT_HEADING = re.compile(r"\s*\d+\s+[^\W\d_]+\s*\Z|\s*(?:comments?|responses?|replies|discussion|kommentare|antworten|commentaires|réponses|comentarios|respuestas|comentários|commenti|reacties|комментарии)\b", re.I)
AGO = re.compile(r"\b\d+\s+(?:second|minute|hour|day|week|month|year)s?\s+ago\b|\bvor\s+\d+\s+\w+|\bil y a\s+\d+\s+\w+|\bhace\s+\d+\s+\w+|\bhá\s+\d+\s+\w+|\b\d+\s+\w+\s+fa\b|\b\d+\s+\w+\s+geleden\b|\d+\s+\w+\s+назад|\d+\s*(?:天|小时|分钟)前", re.I)
ADVERT = re.compile(r"\s*(?:sponsored|advertisements?|advert|anzeige|werbung|gesponsert|publicité|sponsorisé|publicidad|patrocinado|anuncio|publicidade|pubblicità|sponsorizzato|advertentie|gesponsord|реклама|广告)\b\s*[.:!–—-]", re.I)
READ_ALSO = re.compile(r"\s*(?:read (?:also|more|next)|see also|also read|related|more on this|lesen sie auch|lies auch|siehe auch|mehr dazu|à lire aussi|lire aussi|voir aussi|lea también|ver también|leia também|veja também|leggi anche|vedi anche|lees ook|zie ook|читайте также|см\. также|相关阅读|另见)\s*[:：–—-]", re.I)
COOKIE = re.compile(r"cookie|cookies|einwilligung|datenschutz|données sur votre appareil|information on your device|informationen auf ihrem|privacy|partners store|куки", re.I)
#: Lines of furniture that sites put inside the main column: prompts, bylines, notices. Whole blocks of one or two sentences.
FURNITURE = re.compile(
    r"\W*(?:"
    r"share (?:this|on|via|with)\b|follow (?:us|\w+(?: \w+)?) on\b|was this (?:page|article|post|answer)|copyright\b|©|all rights reserved|comments are closed|written by\b|posted by\b|by [\w.'-]+ [\w.'-]+(?: \||,? on \d|, \d)"
    r"|edit this page|improve this page|report (?:this|an error)|sponsored by|last (?:checked|updated|modified|reviewed|edited)\b|subscribe to|sign up (?:for|to)|join our|get our|read more (?:posts|about|articles|from)|more (?:posts|articles) (?:about|from|by)|we use cookies|this site uses cookies|tags ?:|filed under|posted in|categories ?:|print this|leave a (?:comment|reply)|skip to|back to top|the views (?:on|expressed)|legal notice|privacy notice|terms of (?:use|service)|[\w.'-]+(?: [\w.'-]+)? is a (?:registered )?(?:trade)?mark\b|\d+ min(?:ute)?s? read\b"
    r"|diesen beitrag\b.*teilen|diese seite\b.*teilen|teilen sie\b|folgen sie\b|war diese seite|alle rechte|impressum|datenschutz\b|die kommentare sind|kommentare (?:sind )?geschlossen|geschrieben von|verfasst von|von [\w.'-]+ [\w.'-]+ am \d|abonnieren sie|rundbrief\b|gesponsert von|zuletzt (?:geprüft|aktualisiert|geändert)|seite bearbeiten|mehr beiträge|weitere beiträge|wir verwenden cookies|wir nutzen cookies|schlagwörter ?:|die meinungen|.{0,60}\bist eine eingetragene marke"
    r"|partage[zr]\b|suivez(?:-nous)?\b|cette page vous a-t-elle|tous droits|mentions légales|les commentaires sont|commentaires fermés|rédigé par|écrit par|publié par|par [\w.'-]+ [\w.'-]+, le \d|abonnez-vous|recevez la lettre|recevez notre|sponsorisé par|dernière (?:vérification|mise à jour) (?:le|par|du)|modifier cette page|plus d'articles|lire plus d|les avis publiés|nous utilisons des cookies|mots-clés ?:|étiquettes ?:"
    r"|comparte\b|compartir\b|síguenos|siga a\b|¿te ha resultado útil|¿le ha sido útil|todos los derechos|aviso legal|comentarios cerrados|escrito por|publicado por|por [\w.'-]+ [\w.'-]+, el \d|suscríbase|suscríbete|reciba\b|patrocinado por|última actualización|editar esta página|usamos cookies|utilizamos cookies|etiquetas ?:"
    r"|compartilhe\b|siga-nos|esta página foi útil|todos os direitos|comentários (?:estão )?(?:fechados|encerrados)|assine\b|inscreva-se|receba\b|última atualização|edite esta página"
    r"|condividi\b|seguici|questa pagina (?:è stata|ti è stata) utile|tutti i diritti|note legali|commenti chiusi|scritto da|pubblicato da|iscriviti|ricevi\b|sponsorizzato da|ultimo aggiornamento|modifica questa pagina|usiamo i cookie"
    r"|deel deze|volg ons|was deze pagina|alle rechten|reacties zijn gesloten|geschreven door|abonneer|schrijf u in|gesponsord door|laatst (?:gewijzigd|bijgewerkt)|bewerk deze|wij gebruiken cookies"
    r"|поделит|подпис|все права|комментарии закрыты|автор ?:|мы используем|分享|关注我们|版权所有|评论已关闭|订阅"
    r")",
    re.I,
)
FOOTER = re.compile(r"©|\s[·|•]\s|\(c\) \d{4}|all rights reserved", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:left|top|text-indent)\s*:\s*-\d{3,}|font-size\s*:\s*0(?![.\d])|opacity\s*:\s*0(?![.\d])", re.I)
SPLIT_CLASS = re.compile(r"[^a-z0-9]+")


_NEXT_SENTENCE = re.compile(r"[.!?…]\s+[^\W\d_]\w+\s+\w+\s+\w|[。！？]\s*\w")


def is_brief(text: str) -> bool:
    """Whether a text has at most two sentences, however long."""
    first = _NEXT_SENTENCE.search(text)
    return first is None or _NEXT_SENTENCE.search(text, first.end() - 1) is None


def is_furniture(text: str) -> bool:
    """Whether a block is a prompt, byline or notice: at most two sentences, however long, that begin as such."""
    return FURNITURE.match(text) is not None and is_brief(text)


class Segment:
    """A run of text between two block boundaries.

    ``block`` is the number of the innermost numbered block (0: none), ``tag`` its element;
    ``links`` counts characters inside links, ``junk`` names the boilerplate it lies in or is "".
    """

    __slots__ = ("text", "tag", "block", "links", "n_links", "junk", "hidden", "code", "extra")

    def __init__(self, text, tag, block, links, n_links, junk, hidden, code, extra):
        self.text, self.tag, self.block, self.links, self.n_links = text, tag, block, links, n_links
        self.junk, self.hidden, self.code, self.extra = junk, hidden, code, extra


class Page:
    """``junk`` holds the orders of the elements where boilerplate or hidden parts begin."""

    __slots__ = ("title", "segments", "is_html", "tree", "blocks", "junk")

    def __init__(self, title, segments, is_html, tree, blocks, junk):
        self.title, self.segments, self.is_html, self.tree, self.blocks, self.junk = title, segments, is_html, tree, blocks, junk


def _stats(nodes: list[Node]) -> list[tuple]:
    """By node order: text chars, link chars, links, headings, h1s, p-like elements of the subtree; the root is last."""
    n = len(nodes) + 1
    text, link, links, heads, h1s, ps = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 2, -1, -1):
        x = nodes[i]
        tag = x.tag
        if tag in SKIP:
            continue
        t = text[i]
        for c in x.children:
            if c.__class__ is str and c != "\n":
                t += len(c)
        if tag == "a":
            link[i] = t
            links[i] += 1
        elif tag in HEADING:
            heads[i] += 1
            if tag == "h1":
                h1s[i] += 1
        elif tag == "p" or tag == "pre" or tag == "blockquote" or tag == "dd":
            ps[i] += 1
        text[i] = t
        if t or links[i]:
            p = x.parent.order
            text[p] += t
            link[p] += link[i]
            links[p] += links[i]
            heads[p] += heads[i]
            h1s[p] += h1s[i]
            ps[p] += ps[i]
    return list(zip(text, link, links, heads, h1s, ps))


def _elements(n: Node) -> list[Node]:
    return [c for c in n.children if c.__class__ is Node]


def _named_junk(n: Node) -> str:
    """Boilerplate by element, role or class; good class terms win over bad ones."""
    if n.tag in JUNK_TAG:
        return JUNK_TAG[n.tag]
    if len(n.raw) > 1:
        a = n.attrs
        r = a.get("role")
        if r and r in JUNK_ROLE:
            return JUNK_ROLE[r]
        c = a.get("class", "") + " " + a.get("id", "")
        if len(c) > 1:
            terms = SPLIT_CLASS.split(c.lower())
            if not GOOD_CLASS.intersection(terms):
                for t in terms:
                    if t in JUNK_CLASS:
                        return JUNK_CLASS[t]
    return "header" if n.tag == "header" else ""


def _structural_junk(n: Node, stats: list, inside: bool, after_own: bool) -> str:
    """Boilerplate by shape alone. ``inside``: within the region that holds the page's own heading; ``after_own``: behind it."""
    t, l, a, h, h1, p = stats[n.order]
    if t == 0:
        return ""
    kids = _elements(n)
    if n.tag in ("div", "section", "td", "table", "center", "form"):
        first = next((k for k in kids if k.tag not in ("br", "hr", "img")), None)
        if first is not None and first.tag in ("h2", "h3", "h4") and not h1:
            head = first.text()
            if COUNT_HEADING.match(head) and AGO.search(n.text(" ")):
                return "comments"
            at = kids.index(first)
            after = kids[at + 1] if at + 1 < len(kids) else None
            if after is not None and after.tag in ("ul", "ol"):
                s = stats[after.order]
                if s[0] and s[1] >= 0.9 * s[0] and s[2] >= 2:
                    return "side"
        if not h1 and h <= 1 and AGO.search("".join(c for c in n.children if c.__class__ is str)):
            return "comments"
        if any(k.tag == "button" for k in kids) and p <= 2 and not h1 or any(g.tag == "button" for k in kids if k.tag == "p" for g in _elements(k)):
            return "notice"
        if not h1 and h <= 1 and p <= 2 and COOKIE.search(n.text(" ")) and not inside:
            return "notice"
    if inside:
        if n.tag in ("div", "section") and len(kids) == 2 and kids[0].tag in ("h4", "h5", "h6") and kids[1].tag == "p" and a == 0 and is_brief(kids[1].text()):
            return "promo"
        if n.tag in ("ul", "ol") and a >= 2 and l >= 0.95 * t:
            hrefs = [x.get("href").lower() for x in n.find_all("a")]
            if sum(bool(re.search(r"share|mailto:|print|/send|intent/tweet|whatsapp", x)) for x in hrefs) * 2 > len(hrefs):
                return "share"
        return ""
    if n.tag in ("div", "center", "table", "section", "ul", "td", "p"):
        direct = sum(k.tag == "a" for k in kids)
        if not h and a >= 2 and l >= 0.6 * t:
            return "nav"
        if not h and (direct >= 2 and direct * 2 >= len(kids) - p or (a >= 2 or after_own) and FOOTER.search(n.text())):
            return "footer"
        if n.tag != "p" and not p and not a and not _NEXT_SENTENCE.search(n.text()) and len(kids) == 1 and kids[0].tag in ("b", "h1", "strong", "img", "h2") and n.parent is not None and n.parent.tag in ("body", "html", "#root", "header"):
            return "header"
    return ""


def _own_heading(nodes: list[Node], stats: list) -> Node | None:
    """The h1 of the page's own content, or None: not in a header, nor alone in a box that holds only it."""
    for n in nodes:
        if n.tag != "h1":
            continue
        up, bad = n.parent, False
        if up is not None and up.tag not in ("body", "html", "#root") and stats[up.order][0] == stats[n.order][0]:
            bad = True
        while up is not None and not bad:
            if _named_junk(up) not in ("", "byline"):
                bad = True
            up = up.parent
        if not bad:
            return n
    return None


def read_page(html: str | None) -> Page:
    """Segments, title and numbered blocks of a page; null and empty pages have none of them."""
    tree = parse_html(html)
    nodes = tree.nodes
    names = {n.tag for n in nodes}
    is_html = bool(names & {"html", "body", "head", "title"})
    title = ""
    if "title" in names:
        title = next(n for n in nodes if n.tag == "title").text().strip()
    stats = _stats(nodes)
    h1 = _own_heading(nodes, stats) if "h1" in names else None
    region, above = None, set()
    if h1 is not None:
        region = h1.parent
        while region is not None and region.tag not in CONTAINER and region.tag not in ("body", "html", "#root"):
            region = region.parent
    elif "main" in names or "article" in names:
        region = next(n for n in nodes if n.tag in ("main", "article"))
    own_at = region.order if region is not None else None
    if region is not None and region.tag in ("body", "html", "#root"):
        region, own_at = None, h1.order if h1 is not None else None
    n = region
    while n is not None:
        above.add(n.order)
        n = n.parent

    segments: list[Segment] = []
    blocks: list[list] = []  # [tag, has text, junk, hidden, order] by number - 1
    open_blocks: list[int] = []
    parts: list[str] = []
    links = n_links = 0
    extra: list[str] = []
    junk, hidden, code, link, pre = [""], 0, 0, 0, 0
    block_tag = [("", 0)]
    region_depth = 0
    junk_at: set[int] = set()

    def flush():
        nonlocal links, n_links
        raw = "".join(parts)
        text = raw.strip("\n") if pre else " ".join(raw.split())
        if text or extra:
            tag, no = block_tag[-1]
            segments.append(Segment(text, tag, no, links, n_links, junk[-1], hidden > 0, code > 0, extra[:]))
            if text:
                for b in open_blocks:
                    blocks[b][1] = True
        parts.clear()
        extra.clear()
        links = n_links = 0

    todo: list = [tree]
    while todo:
        x = todo.pop()
        if x.__class__ is str:
            if x != "\n" or parts:
                parts.append(x)
                if link:
                    links += len(x)
            continue
        if x.__class__ is tuple:  # the end of an element
            kind, n, was = x
            tag = n.tag
            if tag in BLOCK:
                if parts or extra:
                    flush()
                if tag in NUMBERED:
                    open_blocks.pop()
                    block_tag.pop()
            if tag == "a":
                link -= 1
            if tag == "pre":
                pre -= 1
            if was & 1:
                junk.pop()
            if was & 2:
                hidden -= 1
            if was & 4:
                code -= 1
            if was & 8:
                region_depth -= 1
            continue
        tag = x.tag
        if tag in SKIP:
            continue
        block = tag in BLOCK
        if block:
            if parts or extra:
                flush()
            if len(x.raw) < 2 and tag in NUMBERED and x is not region and tag != "pre":  # most blocks: no attributes, one text
                kids = x.children
                if len(kids) == 1 and kids[0].__class__ is str and (tag != "p" and tag != "blockquote" or not ADVERT.match(kids[0])):
                    t = " ".join(kids[0].split())
                    if t:
                        j = junk[-1]
                        if not j and tag == "p" and is_furniture(t):
                            j = "furniture"
                            junk_at.add(x.order)
                        if open_blocks:
                            for b in open_blocks:
                                blocks[b][1] = True
                        blocks.append([tag, True, j, hidden > 0, x.order])
                        segments.append(Segment(t, tag, len(blocks), len(t) if link else 0, 0, j, hidden > 0, code > 0, ()))
                    else:
                        blocks.append([tag, False, junk[-1], hidden > 0, x.order])
                    continue
        was = 0
        if x is region:
            region_depth += 1
            was |= 8
        kind = ""
        if not junk[-1]:
            if tag in CONTAINER or tag in JUNK_TAG or tag == "noscript" or block and len(x.raw) > 1:
                if tag == "noscript":
                    kind = "noscript"
                elif x.order not in above:
                    kind = _named_junk(x)
                    if not kind and tag in CONTAINER:
                        kind = _structural_junk(x, stats, region_depth > 0, own_at is not None and x.order > own_at)
            if not kind and tag in ("p", "blockquote"):
                s = stats[x.order]
                own = x.text().strip() if s[0] else ""
                if own and ADVERT.match(own):
                    kind = "promo"
                elif s[2] and s[1] >= 0.5 * s[0] and READ_ALSO.match(own):
                    kind = "promo"
                elif tag == "p" and own and is_furniture(own):
                    kind = "furniture"
            if kind:
                junk.append(kind)
                junk_at.add(x.order)
                was |= 1
        if len(x.raw) > 1 and ("style" in x.raw or "hidden" in x.raw or "STYLE" in x.raw):
            a = x.attrs
            if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
                hidden += 1
                junk_at.add(x.order)
                was |= 2
        if tag == "font" and re.search(r"#f{3}(?:f{3})?\b|white", x.get("color"), re.I):
            hidden += 1
            junk_at.add(x.order)
            was |= 2
            flush()
        if tag in NUMBERED:
            blocks.append([tag, False, junk[-1], hidden > 0, x.order])
            open_blocks.append(len(blocks) - 1)
            block_tag.append((tag, len(blocks)))
        if tag == "a":
            link += 1
            n_links += 1
        elif tag == "pre":
            pre += 1
            code += 1
            was |= 4
        elif tag == "code" or tag == "samp" or tag == "kbd":
            code += 1
            was |= 4
            if not pre:  # inline code is marked, so that others can leave it out
                todo.append((0, x, was))
                parts.append("\x02")
                todo.append("\x03")
                todo.extend(reversed(x.children))
                continue
        elif tag == "img":
            for k in ("alt", "title"):
                v = x.get(k)
                if v:
                    extra.append(v)
            continue
        todo.append((0, x, was))
        todo.extend(reversed(x.children))
    flush()
    return Page(title, segments, is_html, tree, blocks, junk_at)


INLINE_CODE = re.compile("\x02[^\x03]*\x03?")


def visible(text: str) -> str:
    """The text with inline code as it is shown."""
    return text.replace("\x02", "").replace("\x03", "") if "\x02" in text else text


def without_code(text: str) -> str:
    return INLINE_CODE.sub(" ", text) if "\x02" in text else text


def main_body(page: Page) -> tuple[str, list[int]]:
    """The page laid out as text without hidden parts and boilerplate, and the numbers of the blocks that the layout shows."""
    shown: set[int] = set()
    text = render(page.tree, page.junk, shown=shown)
    return text, [i + 1 for i, b in enumerate(page.blocks) if b[4] in shown]
