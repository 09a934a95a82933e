"""Problem 3: template residue, filler, error pages and script notices.

Method: the page is read layout-aware (``pages``); one multi-pattern automaton over error, filler
and script-required wording in nine languages marks sentences of the page's own content, and a
page is residue when the marked share of its own words is high. Unfilled placeholders in the title
or in visible text outside code decide by themselves.

Defined results: null, empty and non-HTML sources are read like any other; a page that has no own
text at all and no title beside its site's name is no residue unless its ``noscript`` notice says
so; repeated rows of one fetch give one row.
"""
from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

from skeinlake.llm.common import map_arrow
from skeinlake.llm.pages import Page, read_page, visible, without_code
from skeinlake.llm.stuffing import FUNCTION_WORDS

#: Share of the own words in marked sentences from which a page is residue.
COVERAGE = 0.5
# fixed values: wording that marks the sentence it stands in (lower case, digits as 0)
TRIGGERS = {
    "error": """
        we were unable to|we are unable to|we could not|we couldn't|we can't find|we cannot find|sorry, we can't|sorry, we cannot|the server cannot|the server could not
        it was not possible to|may have been moved or removed|has been moved or removed|the link may be old|the link may be broken|go back to the start page|return to the home page
        our team has been told|our team has been notified|contact the owner of this site|contact the site owner|contact the administrator|check the address and try again|check the url
        please come back in|please try again later|try again in|seconds before the next request|you do not have permission|you don't have permission|for legal reasons we cannot
        this post was deleted|this page was deleted|was removed by its owner|has been deleted by|java.lang.|exception at |uncaught exception|traceback (most recent call last)
        cannot modify header information|fatal error|your session has ended|your session has expired|please sign in again|the requested url|was not found on this server
        your address has been limited|this hosting account has been suspended|this account has been suspended|the domain is parked|this domain is parked|domain may be for sale|may be for sale
        could not connect to|connection refused|connection timed out|upstream timed out|no results for|no results found|nothing here yet|nothing found|nothing to see here
        error establishing a database connection|segmentation fault|stack trace|syntax error, unexpected|undefined variable|undefined index|mysql server has gone away
        reference #0|error id |error code |request id |incident id |ray id|page not found|internal server error|bad gateway|service unavailable|gateway timeout|temporarily unavailable|under maintenance|under construction|coming soon
        wurde entfernt|gibt es leider nicht mehr|versuchen sie es in|versuchen sie es später|keine rechte für|keine berechtigung|seite nicht gefunden|nicht gefunden|kein zugriff|zugriff verweigert|wartungsarbeiten|ist nicht erreichbar|sitzung abgelaufen|keine ergebnisse|interner serverfehler
        n'existe pas ou a été déplacée|n'existe plus ou a été|page introuvable|a été retiré|merci de revenir dans|merci de réessayer|vous n'avez pas le droit|accès refusé|accès interdit|site en maintenance|session expirée|aucun résultat|erreur interne
        página no encontrada|no se ha encontrado|no se pudo encontrar|acceso denegado|no tiene permiso|ha sido eliminado|ha sido retirado|sitio en mantenimiento|vuelva en|inténtelo de nuevo|la página solicitada|sin resultados|error interno
        página não encontrada|não foi encontrada|acesso negado|você não tem permissão|foi removido|site em manutenção|tente novamente|a página solicitada|sem resultados|erro interno
        pagina non trovata|non è stata trovata|accesso negato|non hai il permesso|è stato rimosso|sito in manutenzione|riprova più tardi|la pagina richiesta|nessun risultato|errore interno
        pagina niet gevonden|niet gevonden|toegang geweigerd|geen toestemming|is verwijderd|in onderhoud|probeer het later|de gevraagde pagina|geen resultaten|interne serverfout
        страница не найдена|доступ запрещ|была удалена|был удал|ведутся технические работы|попробуйте позже|запрошенная страница|ничего не найдено|внутренняя ошибка
        页面不存在|找不到页面|未找到|访问被拒绝|没有权限|已被删除|网站维护|请稍后再试|服务器错误|没有结果
    """,
    "script": """
        enable javascript|turn on javascript|activate javascript|allow javascript|enable scripts|turn on scripts|activate scripts|allow scripts|enable js|turn on js|activate js|allow js|enable cookies
        javascript is required|scripts is required|js is required|requires javascript|javascript is switched off|scripts is switched off|js is switched off|javascript is disabled|without javascript|without scripts|without js|doesn't work properly without|works better with javascript
        checking your browser|checking your visit|checking that you are|checking the security|verifying your|verifying that you are|verifying the security|validating your|validating that you are|validating the security|testing your browser|testing your visit|testing that you are|testing the security
        please stand by|please wait while|just a moment|loading…|loading...|loading 0%|this takes up to|if nothing happens|you are not a robot|you are human|are a human|complete the captcha|tick the box|redirecting|browser is not supported
        javascript aktivieren|aktivieren sie javascript|muss javascript erlaubt|javascript erlauben|skripte erlauben|benötigt javascript|ohne javascript|browser wird geprüft|besuch wird geprüft|bitte warten|wird geladen|einen moment|kein roboter
        activer javascript|activer les scripts|autoriser javascript|besoin de javascript|nécessite javascript|sans javascript|vérification de votre|veuillez patienter|chargement|un instant|pas un robot
        activar javascript|habilitar javascript|habilite javascript|active javascript|requiere javascript|necesita javascript|sin javascript|espere por favor|por favor espere|comprobando|cargando|no es un robot
        ativar o javascript|ative o javascript|habilite o javascript|requer javascript|precisa de javascript|aguarde|carregando|verificando seu|não é um robô
        attivare javascript|abilitare javascript|abilita javascript|richiede javascript|attendere|caricamento|verifica del browser|non sei un robot
        javascript inschakelen|schakel javascript|vereist javascript|even geduld|wordt geladen|wordt gecontroleerd|geen robot
        включите javascript|включить javascript|требуется javascript|подождите|загрузка|проверка браузера|не робот
        启用javascript|启用 javascript|需要javascript|请稍候|正在加载|正在检查|不是机器人
    """,
    "filler": """
        your text goes here|replace this text with your own|this is a sample paragraph|this is a sample page|describe your service in|add a short story about your team|placeholder copy|placeholder text|click to edit|just another site|just another wordpress|this is the second column|your title|your subtitle|insert text here|sample text|dummy text|hello world! welcome
        hier steht ihr text|ihr text hier|beispieltext|blindtext|platzhaltertext|votre texte ici|texte d'exemple|texte de remplissage|su texto aquí|tu texto aquí|texto de ejemplo|seu texto aqui|texto de exemplo|il tuo testo qui|testo di esempio|uw tekst hier|voorbeeldtekst|ваш текст здесь|пример текста|在此输入文字|示例文本
    """,
}
# fixed values: whole headings, titles or sentences of such pages (lower case, digits as 0, no end mark)
WHOLE = frozenset(
    x.strip()
    for x in """
    0|oops|gone|not found|access denied|forbidden|error|error 0|fehler 0|erreur 0|error 0 not found|0 not found|0 forbidden|0 gone|0 error|0 bad gateway|0 gateway timeout|0 service unavailable|0 internal server error|0 too many requests
    page not found|something went wrong|too many requests|unknown host|invalid request|bad request|we are sorry|database error|account suspended|session expired|service unavailable|internal server error|under maintenance|not available in your region|bad gateway|gateway timeout|unauthorized|page removed|site not found|parked domain|domain parked
    seite nicht gefunden|kein zugriff|wartungsarbeiten|zugriff verweigert|hoppla|fehler|page introuvable|accès refusé|site en maintenance|oups|erreur|página no encontrada|acceso denegado|en mantenimiento|página não encontrada|acesso negado|pagina non trovata|accesso negato|pagina niet gevonden|toegang geweigerd|страница не найдена|доступ запрещён|ошибка|页面不存在|访问被拒绝
    just a moment|one moment|loading|please wait|heading|your title|title|untitled|lorem ipsum|headline|subheading|sample page|nothing here
    """.replace("\n", "|").split("|")
    if x.strip()
)
# fixed values: words of the public blind text "Lorem ipsum" and of the passage of Cicero (de finibus 1.10.32) it comes from
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
    exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur
    sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
    perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto
    beatae vitae dicta explicabo nemo quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem adipisci
    numquam eius modi tempora quaerat minima nostrum exercitationem corporis suscipit laboriosam aliquid commodi autem vel eum iure quam nihil molestiae illum quo""".split()
)
#: Endings of Latin words that are rare in the words of the nine languages, and the share of such words from which a
#: sentence without any of their function words is blind text.
LATIN_ENDING = re.compile(r"[a-z]*(?:us|um|is|it|ae|am|em|nt|ur|or|que|a)\Z")
LATIN_SHARE, LATIN_WORDS = 0.7, 4
# fixed values: forms of unfilled placeholders
PLACEHOLDER = re.compile(
    r"\{\{[{#/^&]?\s*[\w.\-\[\]]+(?:\s*\|\s*[\w:\"' ,.()]+)?\s*\}?\}\}"  # {{ name }}, {{name|filter}}
    r"|\{%-?\s*(?:block|if|for|include|extends|endblock|endif|endfor|else|elif|set|trans|url|load|csrf_token|macro|raw)\b[^%{}]*-?%\}"
    r"|<%[=\-#!]?\s*[\w.()\[\]\"' ]+\s*-?%>|<\?(?:=|php\b)[^>]*\?>"
    r"|(?<![\w\\$])[$#]\{\s*[A-Za-z_][\w.]*\s*\}"
    r"|%%[A-Z][A-Z0-9_]*%%|@@[A-Z][A-Z0-9_]*@@|(?<![\w@])@\{[A-Za-z_][\w.]*\}"
    r"|\[(?:INSERT|ENTER|ADD|YOUR|PLACEHOLDER)\b[^\[\]\n]{0,60}\](?!\()|\[(?:[Yy]our|[Ii]nsert|[Ee]nter) [a-z][a-z ]{1,40}\](?![(\[])|\[\[(?:[A-Z_]+|[a-z]+_[a-z_]+)\]\]"
    r"|(?<![\w\\$#%@{}\]^)])\{[a-z][a-z0-9]{2,}(?:[_.][a-z0-9]+)*\}(?![}{])"
    r"|\b(?:TODO|FIXME|TBD|XXX):? (?:write|add|insert|fill|replace|put|describe|update|translate|complete)\b"
    r"|%(?:\([a-z_]+\)[sd])|\b__[A-Z]+_[A-Z_]+__\b|\*\|[A-Z_]+\|\*|\bundefined undefined\b|\[object Object\]|\bNaN%"
)
#: What every form of PLACEHOLDER holds at least one of.
_SIGNS = ("{", "%", "[", "<?", "@@", "__", "|*", "undefined", "TODO", "FIXME", "TBD", "XXX")
#: Ends of sentences, and the signs between the entries of a list in one line.
_SENTENCE = re.compile(r"[.!?…。！？]\s+|\n+|\s[|·•]\s+")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^\W\d_]+|[\u4e00-\u9fff]")
#: Title parts of a browser check; they count only where a page has no own text.
_CUT = re.compile(r"\s+[-–—|·]\s+")
_automaton = None
_LONGEST_WHOLE = max(map(len, WHOLE)) + 8
_OUTER = " \t\n\r\f\v.!?…:。！？|·•"
#: Texts of fewer words are always read sentence by sentence.
_FEW = 60
#: Every sign that can end a sentence, wherever it stands: a whole heading of ``WHOLE`` holds none of them inside.
_ENDS = re.compile(r"[.!?…。！？\n|·•]+")
#: Of ASCII text, the letters alone, and the signs of ``_ENDS`` as line ends.
_LETTERS = {i: chr(i) if chr(i).isalpha() else " " for i in range(128)}
_ENDED = {ord(x): "\n" for x in ".!?|"}
_BLANK = _OUTER + "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def automaton():
    """The automaton of all triggers, built once per worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, text in TRIGGERS.items():
            for line in text.split("\n"):
                for p in line.split("|"):
                    if p.strip():
                        a.add_word(p.strip() + (" " if p.endswith(" ") and p.strip().endswith("id") else ""), (len(p.strip()), kind))
        a.make_automaton()
        _automaton = a
    return _automaton


def fold(text: str) -> str:
    return _DIGITS.sub("0", text.lower().replace("’", "'").replace("‘", "'").replace("ｓ", "s"))


_NUMBER_ONLY = re.compile(r"[(#\[]?\s*(?:[\w.]+\s*:\s*0|0|[0a-f]{4,}|(?:reference|error id|ray|ticket|code|id)\s*#?\s*[0-9a-f]+)\s*[)\]]?\.?")
_MODERN = FUNCTION_WORDS - LATIN - frozenset("a per de si se ac at".split())


class _Latin(dict):
    """Whether a word is one of the public blind text or has a Latin ending, by word."""

    def __missing__(self, w):
        if len(self) > 1_000_000:
            self.clear()
        x = self[w] = w in LATIN or LATIN_ENDING.match(w) is not None
        return x


_latin = _Latin()


def is_blind_text(words: list[str]) -> bool:
    """Whether a sentence is Latin-like filler: words of the public blind text or of Latin endings, and none of living languages."""
    n = len(words)
    if n < 3 or not _MODERN.isdisjoint(words):
        return False
    return sum(map(_latin.__getitem__, words)) >= LATIN_SHARE * n if n >= LATIN_WORDS else sum(w in LATIN for w in words) >= LATIN_SHARE * n


def _words(folded: str) -> list[str]:
    return folded.translate(_LETTERS).split() if folded.isascii() else _WORDS.findall(folded)


def _may_be_whole(folded: str) -> bool:
    """Whether some sentence can be one of ``WHOLE``; never false where one is."""
    for x in folded.translate(_ENDED).split("\n") if folded.isascii() else _ENDS.split(folded):
        if len(x) <= _LONGEST_WHOLE and x.strip(_BLANK) in WHOLE:
            return True
    return False


def coverage(text: str) -> tuple[float, dict[str, int]]:
    """Share of the words of a text that stand in marked sentences, and the marked words by kind.

    The automaton runs once over the whole text; sentences are looked at only where the hits, whole
    headings and Latin-like words together can mark enough of it for ``COVERAGE``.
    """
    folded = fold(text)
    hits = list(automaton().iter(folded))
    every = _words(folded)
    few_latin = len(every) >= _FEW and sum(map(_latin.__getitem__, every)) / LATIN_SHARE < 0.8 * COVERAGE * len(every)
    if few_latin and not hits and not _may_be_whole(folded):
        return 0.0, {}
    spans, at = [], 0
    for m in _SENTENCE.finditer(folded):
        at, before = m.end(), at
        spans.append((before, at))
    spans.append((at, len(folded)))
    starts = [a for a, _ in spans]
    kind: dict[int, str] = {}
    for end, (size, k) in hits:
        if end < size or not folded[end - size].isalpha() or folded[end] > "\u2e80":
            kind.setdefault(bisect_right(starts, end - size + 1) - 1, k)
    whole = {i for i, (a, b) in enumerate(spans) if b - a <= _LONGEST_WHOLE and folded[a:b].strip(_OUTER) in WHOLE}
    if few_latin:
        most = sum(len(_words(folded[slice(*spans[i])])) for i in {*kind, *whole}) + sum(map(_latin.__getitem__, every)) / LATIN_SHARE
        if most < 0.8 * COVERAGE * len(every):
            return 0.0, {}
    total = marked = 0
    kinds: dict[str, int] = {}
    for i, (a, b) in enumerate(spans):
        s = folded[a:b]
        words = _words(s)
        n = len(words) or (1 if s.strip() else 0)
        if not n:
            continue
        total += n
        k = "error" if i in whole else kind.get(i, "")
        if not k:
            if is_blind_text(words):
                k = "filler"
            elif len(s.split()) <= 3 and _NUMBER_ONLY.fullmatch(s.strip()):
                total -= n  # a bare reference number says nothing either way
        if k:
            marked += n
            kinds[k] = kinds.get(k, 0) + n
    return (marked / total if total else 0.0), kinds


def _has_placeholder(text: str, signs=_SIGNS) -> bool:
    for sign in signs:
        if sign in text:
            return PLACEHOLDER.search(without_code(text)) is not None
    return False


def residue_kind(page: Page) -> tuple[str, float]:
    """``placeholder``, ``error``, ``script``, ``filler`` or "", with the marked share of the own words."""
    if _has_placeholder(page.title):
        return "placeholder", 1.0
    every = "\n".join([s.text for s in page.segments])
    signs = [x for x in _SIGNS if x in every]
    own, notice, listed = [], [], 0
    for s in page.segments:
        t = s.text
        if not t or s.hidden:
            continue
        if s.junk == "noscript":
            notice.append(t)
            continue
        if s.code:
            if not s.junk:
                own.append((s, "\x04"))
            continue
        if signs and _has_placeholder(t, signs):
            return "placeholder", 1.0
        if not s.junk:
            if s.links >= 0.8 * len(t):
                listed += 1
            else:
                own.append((s, visible(t)))
    if any(t == "\x04" for _, t in own):  # code samples are content
        own = [(s, t) for s, t in own if t != "\x04"]
        if not own:
            return "", 0.0
        code = 30
    else:
        code = 0
    # headings over lists of suggestions ("Most read") belong to the lists
    texts = [t for i, (s, t) in enumerate(own) if not (listed and s.tag in ("h2", "h3", "h4") and len(t) < 40)]
    if not any(_WORDS.search(t) or _DIGITS.search(t) for t in texts):
        texts = notice + [_CUT.split(page.title)[0]] if notice or page.title else []
        if not texts or listed > 3:
            return "", 0.0
    share, kinds = coverage("\n".join(texts))
    if code and share:
        words = sum(len(_WORDS.findall(t)) for t in texts)
        share *= words / (words + code)
    if share >= COVERAGE and kinds:
        return max(kinds, key=kinds.get), share
    return "", share


def residue(fetched: DataFrame) -> DataFrame:
    """``fetch_id, kind, coverage`` of the fetches that are residue, one row per fetch."""

    def rows(b):
        out = {"fetch_id": [], "kind": [], "coverage": []}
        for f, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            kind, share = residue_kind(read_page(h))
            if kind:
                out["fetch_id"].append(f)
                out["kind"].append(kind)
                out["coverage"].append(share)
        return out

    found = map_arrow(fetched.select("fetch_id", "html"), rows, "fetch_id long, kind string, coverage double")
    return found.groupBy("fetch_id").agg(F.min_by("kind", "kind").alias("kind"), F.max("coverage").alias("coverage"))


def without_residue(fetched: DataFrame) -> DataFrame:
    """The fetches without those that are residue; other columns stay as they are."""
    return fetched.join(residue(fetched).select("fetch_id"), "fetch_id", "left_anti")
